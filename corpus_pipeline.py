"""From raw documents to packed training sequences: five stages of the operators in ``prefloom.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents. Rows need no unique or known ids.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefloom.llm.benchmark_decontamination import contaminated, decontaminate
from prefloom.llm.best_fit_packing import pack
from prefloom.llm.jaccard_join import jaccard_classes
from prefloom.llm.quality_rules import COUNTS, FENCES, judge, sketches, with_metrics
from prefloom.llm.queries import table, tokenizer_path
from prefloom.llm.secret_scans import redact, scan
from prefloom.llm.text import unused
from prefloom.operators.skew import hot_keys, join_unique
from prefloom.session import cut_lineage, drop_scratch, scratch_made, scratch_path


def _apart(docs: DataFrame, results: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with its columns named like ``results`` renamed, and the columns that give them their names back."""
    names = {c: unused((*docs.columns, *results), c)[0] if c.lower() in results else c for c in docs.columns}
    return docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(f"`{n}`").alias(c) for c, n in names.items()]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    own, back = _apart(docs, (*COUNTS, *FENCES, "base_failed", "rows_behind", "kept"))
    metrics = with_metrics(own)
    return judge(metrics, sketches(metrics)).where("kept").select(back)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id (NULL last); texts without words all stay."""
    row, first = unused(docs.columns, "row", "first")
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    classes = cut_lineage(jaccard_classes(numbered, id_column=row)).where("n_shingles > 0")
    known = cut_lineage(classes.join(numbered.select(row, "doc_id"), row))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", row)
    kept = known.groupBy("component_id").agg(F.min_by(row, order).alias(first))
    copies = join_unique(known, kept, "component_id", hot_keys(known, "component_id"), [row])
    copies = copies.where(F.col(row) != F.col(first)).select(row)
    return numbered.join(copies, row, "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    own, back = _apart(docs, ("n_words", "n_hit", "items", "spans"))
    judged = decontaminate(own, table(spark, sf_dir, "benchmark"))
    return judged.where(~contaminated()).select(back)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; what the forest calls a secret is replaced by a mark, and n_chars follows the text."""
    clean = redact(docs, scan(docs, table(spark, sf_dir, "labels")))
    changed = F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")).alias("n_chars")
    return clean.select(*[changed if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path())


_earlier: list[str] = []  # scratch folders of the stage before


def _tidy(stage):
    """A stage that first drops the scratch of the one before, whose result was written and read again."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(spark, _earlier, docs)
        before = set(scratch_made())
        out = stage(spark, docs, sf_dir)
        _earlier[:] = [p for p in scratch_made() if p not in before]
        return out

    return run_stage


STAGES = [
    ("quality rules", _tidy(quality_rules)),
    ("n-gram Jaccard join", _tidy(jaccard_join)),
    ("benchmark decontamination", _tidy(benchmark_decontamination)),
    ("secret scans", _tidy(secret_scans)),
    ("best-fit packing", _tidy(best_fit_packing)),
]

# Tokenization and the forest have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
