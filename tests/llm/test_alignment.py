import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import frame

from prefloom.llm.queries import tokenizer_path
from prefloom.llm.token_alignment import COMMON, Aligned, BytePairs, alignment, piece_bounds, token_groups
from prefloom.session import scratch_made

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
TEXTS = [
    "The quick brown fox, 12 of them.",
    None,
    "",
    " ",
    "  two  spaces\n\n\tand tabs ",
    "naïve café — “quoted” … 漢字 and \U0001f600!",
    "<|endoftext|> and <s> </s> <unk> <0x41>",
    "a ▁ piece mark",
    "the quick brown fox",
    "the quick brown fox",
    "x" * 3000 + " " + "ab " * 5000,
    "\x00\x1c nul",
]


def _tokens():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_path(A))
    one.encode_special_tokens = True
    two = SentencePieceProcessor(model_file=tokenizer_path(B))
    bytes_a = BytePairs(tokenizer_path(A)).bytes

    def piece(i):
        name = two.id_to_piece(i)
        return bytes([int(name[3:5], 16)]) if two.is_byte(i) else name.replace("▁", " ").encode()

    def both(text):
        whole = (" " + text).encode() if text else b""
        a = one.encode(" " + text, add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        left, right = [bytes_a[i] for i in a], [piece(i) for i in b]
        if b"".join(left) != whole or b"".join(right) != whole:
            return [], [], [], []
        return a, b, np.cumsum([len(x) for x in left]).tolist(), np.cumsum([len(x) for x in right]).tolist()

    return both


def _brute(texts):
    both, links, rows = _tokens(), [], []
    for text in texts:
        a, b, ends_a, ends_b = both(text)
        common = sorted(set(ends_a) & set(ends_b))
        groups, own, i, j = [], [], 0, 0
        for end in common:
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            own.append((a[x - 1], b[y - 1]))
            i, j = x, y
        links.append(own)
        rows.append([len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    count = Counter(p for own in links for p in own)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    return [
        (n_a, n_b, n_g, len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), sha)
        for (n_a, n_b, n_g, sha), own in zip(rows, links)
    ]


@pytest.mark.parametrize("slice_bytes, piece, at_once", [(1 << 20, 1 << 16, 1 << 20), (30, 3, 7)])
def test_alignment_agrees_with_brute_force(spark, slice_bytes, piece, at_once):
    ids = [7, None, 7, *range(20, 20 + len(TEXTS) - 3)]
    docs = frame(spark, TEXTS, ids).withColumnRenamed("size", "n_a").withColumnRenamed("block", "row")
    found = alignment(docs, tokenizer_path(A), tokenizer_path(B), slice_bytes=slice_bytes, piece=piece, pairs_at_once=at_once)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    expected = sorted([(i, *row) for i, row in zip(ids, _brute(TEXTS))], key=repr)
    assert sorted([tuple(r) for r in found.collect()], key=repr) == expected


def test_slices_stand_in_small_row_groups(spark):
    """What is read at once of the stored slices does not grow with the input of a task."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(200)]
    before = set(scratch_made())
    docs = frame(spark, texts).coalesce(1)
    found = alignment(docs, tokenizer_path(A), tokenizer_path(B), slice_bytes=4000, group_bytes=1 << 15)
    (path,) = [p for p in scratch_made() if p not in before and "prefloom-aligned-" in p]
    (file,) = [pq.ParquetFile(f) for f in Path(path.removeprefix("file:")).glob("*.parquet")]
    groups = [file.metadata.row_group(i) for i in range(file.num_row_groups)]
    assert len(groups) > 5 and max(g.total_byte_size for g in groups) < 5 << 15 < sum(g.total_byte_size for g in groups)
    assert sorted(tuple(r) for r in found.collect()) == [(i, *row) for i, row in enumerate(_brute(texts), 1)]


def test_groups_give_the_texts_back(spark):
    texts = ["the quick brown fox", None, "naïve — café", "", "ab " * 300]
    rows = token_groups(frame(spark, texts), tokenizer_path(A), tokenizer_path(B), slice_bytes=20, piece=5).collect()
    one = BytePairs(tokenizer_path(A)).bytes
    for i, text in enumerate(texts, 1):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["group_no"])
        assert [r["group_no"] for r in own] == list(range(len(own)))
        whole = (" " + text).encode() if text else b""
        assert b"".join(one[t] for r in own for t in r["a"]) == whole
        assert all(whole[r["start"] : r["end"]] == b"".join(one[t] for t in r["a"]) for r in own)


def test_no_rows(spark):
    docs = frame(spark, ["x"]).where("false")
    assert alignment(docs, tokenizer_path(A), tokenizer_path(B)).count() == 0


@pytest.mark.parametrize("piece", [1, 2, 7, 1000])
def test_pieces_are_of_equal_work_and_lose_no_overlap(piece):
    rng = np.random.default_rng(piece)
    for _ in range(30):
        n = int(rng.integers(1, 60))
        a, b = (np.append(np.flatnonzero(rng.random(n) < p), n) for p in (0.5, 0.3))
        at_a, at_b = piece_bounds(a, b, piece)
        assert all(np.diff(at_a + at_b)[:-1] == piece) and at_a[-1] == len(a) and at_b[-1] == len(b)
        own = Aligned(a, b, piece)
        starts = [np.concatenate([[-1], x[:-1]]) for x in (a, b)]
        overlapping = {(i, j) for i in range(len(a)) for j in range(len(b)) if max(starts[0][i], starts[1][j]) < min(a[i], b[j])}
        pairs = list(zip(own.overlap_a.tolist(), own.overlap_b.tolist()))
        assert len(pairs) == len(set(pairs)) and set(pairs) == overlapping
        assert a[own.link_a].tolist() == b[own.link_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_both_ways_to_encode_agree():
    one = BytePairs(tokenizer_path(A))
    assert one.ranked == 50256
    rng = random.Random(5)
    letters = "".join(map(chr, [*range(0, 28), *range(32, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC])) + " " * 60 + "aeiou" * 20
    for _ in range(300):
        text = "".join(rng.choices(letters, k=rng.randrange(60)))
        assert COMMON.fullmatch(text)
        slow = one.whole.encode(text, add_special_tokens=False).ids
        assert one.encode(text).tolist() == slow
