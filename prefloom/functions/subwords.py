"""Sub-word tokens: byte pairs merged by rank, over Arrow arrays.

A text is cut into words by a pattern, and the bytes of each word are merged pair by pair, the pair with the
smallest rank first (of equal ones the leftmost), until no pair is a token. A token's rank is its id, as in the
files of published byte-level vocabularies. Each word is merged once a task and looked up afterwards.

Since words do not influence each other, a prompt is cut to its budget without encoding its candidates one by
one: token counts of whole words add up, and only the word at the cut, the one before it and what follows the
cut are encoded again.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from prefloom.functions.text import BLANKS, Template
from prefloom.functions.tokens import IDS, SLICE_BYTES, CallableTokenizer, WordTokenizer, slices, text_sizes
from prefloom.schemas import EOS_TEXT, PAD_TEXT

# A word takes one blank before it; runs of other blanks are words of their own.
WORD_PATTERN = r" ?[^ \t\n\x0b\x0c\r]+|[ \t\n\x0b\x0c\r]+"
# What a task keeps of the words it met, in characters and ids; beyond that it starts anew.
CACHED_SIZE = 4_000_000
WORD_SIZE = 30  # what an entry takes besides, in the same measure
SHORT = 100  # characters; within so many all cuts are tried
FITTED = "struct<prompt: string, ids: array<bigint>>"
EXAMPLE = "struct<prompt: string, ids: array<bigint>, response_ids: array<bigint>, response_tokens: int, joint_ids: array<bigint>>"


def merge_pairs(word: bytes, ranks: Mapping[bytes, int]) -> list[int]:
    """Ids of the tokens that the bytes of a word are merged to, in n log n steps: pairs wait in a heap, and one that
    has changed since it was put there is passed over."""
    parts = [word[i : i + 1] for i in range(len(word))]
    after = list(range(1, len(parts) + 1))
    before = list(range(-1, len(parts) - 1))
    waiting: list[tuple[int, int, bytes]] = []

    def wait(i: int) -> None:
        if i >= 0 and after[i] < len(parts):
            pair = parts[i] + parts[after[i]]
            if pair in ranks:
                heappush(waiting, (ranks[pair], i, pair))

    for i in range(len(parts) - 1):
        wait(i)
    while waiting:
        _, i, pair = heappop(waiting)
        j = after[i]
        if not parts[i] or j >= len(parts) or parts[i] + parts[j] != pair:
            continue
        parts[i], parts[j] = pair, b""
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        wait(before[i])
        wait(i)
    return [ranks[p] for p in parts if p]


class Encoder:
    """What a task makes of a tokenizer: words and special texts of a text, and their ids."""

    def __init__(self, tokens: Sequence[bytes], specials: Mapping[str, int], pattern: str):
        import regex

        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.specials = dict(specials)
        self.special = re.compile("|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.pattern = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}
        self.known_size = 0
        self.longest = max(map(len, (*tokens, *(t.encode() for t in specials))))

    def spans(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        """Where the words and special texts of ``text`` from ``start`` on lie; characters that no word has go with none."""
        while start < len(text):
            mark = self.special.search(text, start) if self.special else None
            end = mark.start() if mark else len(text)
            for m in self.pattern.finditer(text, start, end):
                yield m.span()
            if not mark:
                return
            yield mark.span()
            start = mark.end()

    def word(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            own = self.specials.get(word)
            ids = [own] if own is not None else merge_pairs(word.encode(), self.ranks)
            self.known_size += WORD_SIZE + len(word) + len(ids)
            if self.known_size > CACHED_SIZE:
                self.known.clear()
                self.known_size = WORD_SIZE + len(word) + len(ids)
            self.known[word] = ids
        return ids

    def encode(self, text: str, start: int = 0) -> list[int]:
        out: list[int] = []
        for a, b in self.spans(text, start):
            out += self.word(text[a:b])
        return out

    def farthest(self, text: str, start: int, end: int, room: int) -> int:
        """The farthest place up to ``end`` that ``room`` tokens from ``start`` on might reach: the least tokens that
        make up a text are never more than those that its words are merged to."""
        marks = {m.encode() for m in self.specials}
        body, least = text[start:end].encode(), [0]
        reached = 0
        for i in range(1, len(body) + 1):
            some = [least[j] for j in range(max(0, i - self.longest), i) if body[j:i] in self.ranks or body[j:i] in marks]
            least.append(1 + min(some))
            if least[i] <= room:
                reached = i
            elif i - reached > self.longest:
                break
        return start + len(body[:reached].decode(errors="ignore"))

    def fit(self, head: str, body: str, tail: str, budget: int, cut_text: str) -> tuple[str, list[int]] | None:
        """The first candidate with at most ``budget`` tokens and its ids: ``body`` whole, then without its last
        lines, then without the last characters of its first line; None if even an empty body has too many."""
        text, first = head + body, len(head)
        ends, counts = [], [0]
        for a, b in self.spans(text):
            ends.append(b)
            counts.append(counts[-1] + len(self.word(text[a:b])))
        ends_of = [0, *ends]

        def tokens(end: int) -> list[int] | None:
            """Ids of text[:end] + tail from the word before the one at ``end`` on; None if the words before are too many."""
            settled = max(0, bisect_right(ends, end - 1) - 1) if end else 0
            if counts[settled] > budget:
                return None
            start = ends_of[settled]
            own = self.encode(text[start:end] + tail)
            return own if counts[settled] + len(own) <= budget else None

        def result(end: int) -> tuple[str, list[int]]:
            whole = text[:end] + tail
            return whole, self.encode(whole)

        def fits(end: int) -> bool:
            return tokens(end) is not None

        if fits(len(text)):
            return result(len(text))
        lines = [m.start() + first for m in re.finditer(re.escape(cut_text), body)] if cut_text else []
        # Words before a cut never become fewer, so all cuts beyond the word that breaks the budget fail.
        words = bisect_right(counts, budget)
        last = len(text) if words + 1 >= len(ends_of) else ends_of[words + 1]
        settled = max(0, words - 2)
        if last - ends_of[settled] > SHORT:
            last = self.farthest(text, ends_of[settled], last, budget - counts[settled])
        for end in reversed(lines[: bisect_right(lines, last)]):
            if fits(end):
                return result(end)
        line = lines[0] if lines else len(text)
        for end in range(min(line - (not lines), last), first - 1, -1):
            if fits(end):
                return result(end)
        return None


@dataclass(frozen=True)
class SubwordTokenizer:
    """A byte-level vocabulary: ``tokens[i]`` are the bytes of id i, all 256 single bytes among them."""

    tokens: tuple[bytes, ...]
    pad_id: int
    eos_id: int
    pad_text: str = PAD_TEXT
    eos_text: str = EOS_TEXT
    pattern: str = WORD_PATTERN
    more_specials: tuple[tuple[str, int], ...] = field(default=())

    def __post_init__(self):
        missing = {bytes([b]) for b in range(256)} - set(self.tokens)
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no token, {min(missing)!r} among them")
        if len(set(self.tokens)) < len(self.tokens):
            raise ValueError("two ids have the same bytes")
        clash = [i for i in self.specials.values() if 0 <= i < len(self.tokens)]
        if clash:
            raise ValueError(f"special texts need ids of their own; taken: {clash}")

    @classmethod
    def from_ranks(cls, path: str, **more) -> SubwordTokenizer:
        """From a file of lines "base64 of the bytes, blank, rank"; the two special texts get the ids behind the last."""
        with open(path, "rb") as file:
            ranks = {int(r): base64.b64decode(t) for t, r in map(bytes.split, file)}
        if sorted(ranks) != list(range(len(ranks))):
            raise ValueError(f"the ranks in {path} leave gaps")
        return cls(tuple(ranks[i] for i in range(len(ranks))), **{"eos_id": len(ranks), "pad_id": len(ranks) + 1, **more})

    @property
    def specials(self) -> dict[str, int]:
        return {self.eos_text: self.eos_id, self.pad_text: self.pad_id, **dict(self.more_specials)}

    def encoder(self) -> Encoder:
        return Encoder(self.tokens, self.specials, self.pattern)

    def encode(self, text: Column, limit: int | None = None) -> Column:
        """Token ids of the whole text, or of its first ``limit`` tokens; NULL for NULL."""
        make = self.encoder

        @F.arrow_udf(IDS)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = make()
            for batch in batches:
                for start, end in slices(text_sizes(batch), SLICE_BYTES):
                    texts = batch.slice(start, end - start).to_pylist()
                    ids = [None if t is None else own.encode(t)[:limit] for t in texts]
                    yield pa.array(ids, pa.list_(pa.int64()))

        return run(text)

    def count(self, text: Column) -> Column:
        return F.array_size(self.encode(text))

    def drop_specials(self, text: Column) -> Column:
        for special in self.specials:
            text = F.replace(text, F.lit(special), F.lit(""))
        return text

    def fit_prompt_ids(
        self,
        template: str,
        fields: Mapping[str, Column],
        budget: int,
        cut_field: str = "post",
        cut_text: str = "\n",
        null_text: str = "None",
    ) -> Column:
        """The prompt as ``WordTokenizer.fit_prompt`` cuts it, and its ids: a struct (prompt, ids), NULL where nothing fits.

        Counting takes each word once; each cut that is tried encodes two words and the rest of the template
        anew, and cuts are tried from the first on whose whole words are within the budget.
        """
        before, after = Template.parse(template).around(cut_field)
        make = self.encoder

        @F.arrow_udf(FITTED)
        def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            own = make()
            for parts in batches:
                for start, end in slices(sum(map(text_sizes, parts)), SLICE_BYTES):
                    rows = zip(*(part.slice(start, end - start).to_pylist() for part in parts))
                    found = [own.fit(*row, budget, cut_text) for row in rows]
                    texts = pa.array([f and f[0] for f in found], pa.string())
                    ids = pa.array([f and f[1] for f in found], pa.list_(pa.int64()))
                    none = pa.array([f is None for f in found])
                    yield pa.StructArray.from_arrays([texts, ids], ["prompt", "ids"], mask=none)

        body = F.coalesce(fields[cut_field].cast("string"), F.lit(null_text))
        return run(before.render(fields, null_text), body, after.render(fields, null_text))

    def fit_example(
        self,
        template: str,
        fields: Mapping[str, Column],
        response: Column,
        budget: int,
        width: int,
        cut_field: str = "post",
        cut_text: str = "\n",
        null_text: str = "None",
    ) -> Column:
        """``fit_prompt_ids`` and, by the same worker, the first ``width`` ids of the response and of the joined text, and
        the response's token count: a struct whose prompt, ids and joint_ids are NULL where nothing fits.

        The joined text is the prompt without special texts and without blanks at its ends, and the response.
        """
        before, after = Template.parse(template).around(cut_field)
        make, specials = self.encoder, tuple(self.specials)

        @F.arrow_udf(EXAMPLE)
        def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            own = make()

            def joint(prompt: str, response: str) -> list[int]:
                for special in specials:
                    prompt = prompt.replace(special, "")
                return own.encode(prompt.strip(BLANKS) + response)[:width]

            for parts in batches:
                for start, end in slices(sum(map(text_sizes, parts)), SLICE_BYTES):
                    prompts, ids, heads, counts, joints = [], [], [], [], []
                    for *prompt, text in zip(*(part.slice(start, end - start).to_pylist() for part in parts)):
                        found = own.fit(*prompt, budget, cut_text)
                        whole = None if text is None else own.encode(text)
                        prompts.append(found and found[0])
                        ids.append(found and found[1])
                        heads.append(whole if whole is None else whole[:width])
                        counts.append(whole if whole is None else len(whole))
                        joints.append(None if found is None or text is None else joint(found[0], text))
                    lists = [pa.array(x, pa.list_(pa.int64())) for x in (ids, heads, joints)]
                    columns = [pa.array(prompts, pa.string()), lists[0], lists[1], pa.array(counts, pa.int32()), lists[2]]
                    yield pa.StructArray.from_arrays(columns, ["prompt", "ids", "response_ids", "response_tokens", "joint_ids"])

        body = F.coalesce(fields[cut_field].cast("string"), F.lit(null_text))
        return run(before.render(fields, null_text), body, after.render(fields, null_text), response)

    def fit_prompt(self, template: str, fields: Mapping[str, Column], budget: int, *cut: str, **more: str) -> Column:
        return self.fit_prompt_ids(template, fields, budget, *cut, **more)["prompt"]

    def decode(self, ids: Column) -> Column:
        """The text of token ids, special and unknown ones left out. Bytes of one character may lie in several
        tokens; those that make no character become U+FFFD. NULL for NULL; NULL ids are left out."""
        tokens = self.tokens

        @F.arrow_udf("string")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            pieces = pa.array(tokens, pa.binary())
            for whole in batches:
                sizes = np.where(whole.is_valid().to_numpy(zero_copy_only=False), np.diff(whole.offsets.to_numpy()), 0)
                for start, end in slices(8 * sizes, SLICE_BYTES):
                    batch, length = whole.slice(start, end - start), sizes[start:end]
                    flat = batch.flatten()
                    place = flat.fill_null(-1).to_numpy(zero_copy_only=False)
                    known = (place >= 0) & (place < len(tokens))
                    edges = np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], np.cumsum(length)])]
                    own = pieces.take(pa.array(place[known]))
                    ends = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
                    body = memoryview(own.buffers()[2]) if own.buffers()[2] is not None else memoryview(b"")
                    cut = ends[edges].tolist() if len(own) else [0] * len(edges)
                    texts = [bytes(body[a:b]).decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]
                    yield pa.array(texts, pa.string(), mask=~batch.is_valid().to_numpy(zero_copy_only=False))

        return run(ids)


Tokenizer = WordTokenizer | CallableTokenizer | SubwordTokenizer
