"""Secret scans: candidate strings judged by a random forest that was trained on labelled findings.

A candidate is a long run of key characters, or the whole value that is assigned to a key word or stands quoted
beside one, of any length and alphabet. Its features are its length, its character transitions, how
much of it dictionary words cover, its path and the words beside it; the forest (MLlib) removes the false
positives. It is fitted on at most ``sample_rows`` labelled findings; everything else sees every row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefloom.llm.text import unused
from prefloom.session import cut_lineage

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KEYWORDS = re.compile(r"token|secret|passw|pwd|api|key|auth|bearer|credential", re.I)
ASSIGNED = re.compile(r"(?<![\w.-])([\w.-]++)[\"'`\])]*+[ \t]*+(?:=>|:=|==|=|:)[ \t]*+(?:(?:bearer|basic|token)[ \t]++)?", re.I)
OPEN = re.compile(r"[bru]{0,2}f?([\"'`])\1*", re.I)
OPEN_BESIDE = re.compile(r"(?<!\w)([\"'`])\1*")
BODY = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)++(?={q})") for q in "\"'`"}
BARE = re.compile(r"\S+")
ANY = re.compile(r".*", re.S)
PLACEHOLDERS = re.compile(r"example|sample|dummy|fake|test|placeholder|redacted", re.I)
DICTIONARY_WORDS = 2000
SAMPLE_ROWS = 20_000
BROADCAST_TEXTS = 500_000  # texts with secrets; their spans take some 50 bytes each
TREES, DEPTH, SEED = 20, 6, 17
FEATURES = (
    "length digits upper lower symbols entropy class_changes vowel_changes repeated dictionary "
    "path_depth path_digits path_placeholder assigned quoted keyword placeholder distance"
).split()


def _beside(text: str, at: int) -> str:
    return " ".join(text[max(0, at - 60) : at].split()[-4:])


def whole_values(text: str) -> Iterator[re.Match]:
    """Values assigned to a name with a key word, and quoted ones with a key word among the four words before.

    A quoted value ends at its quote, another one at the next blank.
    """
    if not KEYWORDS.search(text):
        return
    for m in ASSIGNED.finditer(text):
        if KEYWORDS.search(m.group(1)):
            quote = OPEN.match(text, m.end())
            if quote and quote.end() - quote.start(1) == 2:
                continue  # an empty value
            value = quote and BODY[quote.group(1)].match(text, quote.end()) or BARE.match(text, m.end())
            if value:
                yield value
    at = 0
    while quote := OPEN_BESIDE.search(text, at):
        value = BODY[quote.group(1)].match(text, quote.end()) if quote.end() - quote.start() != 2 else None
        at = value.end() + 1 if value else quote.end()
        if value and KEYWORDS.search(_beside(text, quote.start())):
            yield value


def candidates(text: str) -> Iterator[re.Match]:
    """Whole values beside key words (overlapping ones are one); in the rest, runs of key characters with a
    digit, or so long that no word is."""
    merged: list[list[int]] = []
    for start, end in sorted(m.span() for m in whole_values(text)):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    at = 0
    for start, end in [*merged, (len(text), len(text))]:
        for m in CANDIDATE.finditer(text, at, start):
            if m.end() - m.start() >= 24 or any(c.isdigit() for c in m.group()):
                yield m
        if start < end:
            yield ANY.match(text, start, end)
        at = end


def dictionary_coverage(value: str, dictionary: frozenset[str]) -> float:
    """Share of characters in dictionary words (three letters or more), the longest first from the left."""
    low, at, inside = value.lower(), 0, 0
    while at < len(low):
        n = next((n for n in range(min(12, len(low) - at), 2, -1) if low[at : at + n] in dictionary), 0)
        inside, at = inside + n, at + max(n, 1)
    return inside / len(low)


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def features(text: str, m: re.Match, path: str, dictionary: frozenset[str]) -> list[float]:
    value = m.group()
    n = len(value)
    kinds = [_kind(c) for c in value]
    counts = Counter(value)
    vowels = [c in "aeiouAEIOU" for c in value]
    before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 30]
    beside = " ".join(before.split()[-4:]), " ".join(after.split()[:2])
    keyword = [k.end() for k in KEYWORDS.finditer(before)]
    return [
        float(n),
        kinds.count(0) / n,
        kinds.count(1) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        -sum(c / n * math.log2(c / n) for c in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / max(n - 1, 1),
        sum(a != b for a, b in zip(vowels, vowels[1:])) / max(n - 1, 1),
        sum(a == b for a, b in zip(value, value[1:])) / max(n - 1, 1),
        dictionary_coverage(value, dictionary),
        float(path.count("/")),
        sum(c.isdigit() for c in path) / max(len(path), 1),
        float(bool(PLACEHOLDERS.search(path))),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))),
        float(before[-1:] in ("'", '"') and before[-1:] == after[:1]),
        float(bool(KEYWORDS.search(beside[0]))),
        float(bool(PLACEHOLDERS.search(" ".join(beside)) or PLACEHOLDERS.search(value))),
        float(len(before) - keyword[-1]) if keyword else 99.0,
    ]


def common_words(df: DataFrame, text_column: str = "text", n: int = DICTIONARY_WORDS) -> frozenset[str]:
    """The n words of three to twelve letters that most texts have (ties: alphabetical); n bounds what is collected."""
    words = F.array_distinct(F.split(F.lower(F.col(text_column)), r"[^\p{L}]+"))
    rows = df.select(F.explode(words).alias("w")).where(F.length("w").between(3, 12))
    top = rows.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(n)
    return frozenset(r["w"] for r in top.collect())


def text_key(text_column: str) -> Column:
    return F.xxhash64(F.col(text_column))


def find_candidates(
    df: DataFrame, dictionary: frozenset[str], id_column: str = "doc_id", text_column: str = "text", path_column: str = "source"
) -> DataFrame:
    """One row per candidate: ``id_column``, text_key, start, end (characters), value and features.

    NULL and empty texts have none; a NULL path counts as empty; repeated rows are searched each.
    """
    shared = df.sparkSession.sparkContext.broadcast(dictionary)
    kind = df.schema[id_column].dataType.simpleString()

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for batch in batches:
            rows, found = [], []
            for row, (text, path) in enumerate(zip(batch.column(2), batch.column(3))):
                text, path = text.as_py() or "", path.as_py() or ""
                for m in candidates(text):
                    rows.append(row)
                    found.append((m.start(), m.end(), m.group(), features(text, m, path, words)))
            take = pa.array(rows, pa.int32())
            start, end, value, own = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(take),
                    batch.column(1).take(take),
                    pa.array(start, pa.int32()),
                    pa.array(end, pa.int32()),
                    pa.array(value, pa.string()),
                    pa.array(own, pa.list_(pa.float64())),
                ],
                ["id", "text_key", "start", "end", "value", "features"],
            )

    read = df.select(id_column, text_key(text_column), text_column, F.col(path_column).cast("string").alias("path"))
    out = read.mapInArrow(search, f"id {kind}, text_key long, start int, end int, value string, features array<double>")
    return out.withColumnRenamed("id", id_column)


def weak_label() -> Column:
    """Labels for findings nobody reviewed: a quoted value assigned to a key word is a secret unless a
    placeholder stands beside it; a value without any of that is none; the rest stays unlabelled."""
    f = {name: F.col("features")[i] for i, name in enumerate(FEATURES)}
    assigned = (f["assigned"] == 1) & (f["keyword"] == 1) & (f["digits"] > 0)
    return (
        F.when(assigned & (f["placeholder"] == 0), 1.0)
        .when((f["assigned"] == 0) & (f["keyword"] == 0), 0.0)
        .when(f["placeholder"] == 1, 0.0)
    )


def judge(findings: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.5) -> DataFrame:
    """``findings`` with probability and is_secret, from a forest trained on ``labelled`` (features, label, value).

    Training rows are distinct (features, label) pairs, at most ``sample_rows`` of them by the order of a
    hash, so the fit does not depend on partitions. Where the labels are all alike, or there are none, no
    forest can be fitted: the probability is that label, or NULL, and then nothing is called a secret.
    """
    rows = labelled.where(F.col("label").isNotNull()).select("features", "label").distinct()
    rows = rows.orderBy(F.xxhash64("features", "label"), "features", "label").limit(sample_rows)
    rows = cut_lineage(rows.coalesce(1))
    kinds = sorted(r["label"] for r in rows.select("label").distinct().collect())
    if len(kinds) < 2:
        probability = F.lit(kinds[0] if kinds else None).cast("double")
        judged = findings.withColumn("probability", probability)
    else:
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="vector")
        ordered = rows.orderBy("features", "label").coalesce(1)
        model = forest.fit(ordered.withColumn("vector", array_to_vector("features")))
        scored = model.transform(findings.withColumn("vector", array_to_vector("features")))
        judged = scored.withColumn("probability", vector_to_array("probability")[1])
        judged = judged.drop("vector", "rawPrediction", "prediction")
    return judged.withColumn("is_secret", F.coalesce(F.col("probability") >= threshold, F.lit(False)))


def scan(
    df: DataFrame,
    labelled_ids: DataFrame | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    path_column: str = "source",
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """Judged findings of every text. Training takes the weak labels of the findings in ``labelled_ids``
    (all texts where that is None)."""
    findings = find_candidates(df, common_words(df, text_column), id_column, text_column, path_column)
    findings = cut_lineage(findings)
    labelled = findings.withColumn("label", weak_label())
    if labelled_ids is not None:
        labelled = labelled.join(labelled_ids.select(id_column).distinct(), id_column, "left_semi")
    return judge(findings, labelled, sample_rows)


def redact(df: DataFrame, judged: DataFrame, id_column: str = "doc_id", text_column: str = "text", mark: str = "<secret>") -> DataFrame:
    """``df`` with every secret in its text replaced by ``mark``; rows and other columns stay, whatever their names."""
    own_id, key, found = unused(df.columns, "id", "key", "spans")
    spans = judged.where("is_secret").select(
        F.col(id_column).alias(own_id), F.col("text_key").alias(key), F.struct("start", "end").alias("span")
    )
    spans = cut_lineage(spans.groupBy(own_id, key).agg(F.array_sort(F.collect_set("span")).alias(found)))
    if spans.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        spans = F.broadcast(spans)  # else texts and spans are joined by shuffle
    same = F.col(id_column).eqNullSafe(F.col(own_id)) & (text_key(text_column) == F.col(key))
    joined = df.join(spans, same, "left")
    text, spans = F.col(text_column), F.col(found)
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text)))
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    parts = F.zip_with(starts, ends, lambda a, b: F.substring(text, a + 1, b - a))
    clean = F.when(spans.isNull(), text).otherwise(F.array_join(parts, mark))
    return joined.withColumn(text_column, clean).drop(own_id, key, found)
