"""Quality rules whose thresholds adapt to language and source, in DataFrame functions only.

1. Every text gets its counts and a few ratios in one projection, without a shuffle.
2. Each (language, source, metric) keeps a quantile sketch: counts of logarithmic buckets, which bound
   the relative error by 1/64 whatever the data. Sketches merge by adding counts, so small groups fall
   back on the merged sketch of their language, and that on the merged sketch of all.
3. Fences come from the quartiles of the sketches and are joined to the documents.

A hot source costs nothing: its rows are counted per bucket before anything is shuffled, and fences are
broadcast after their number was checked (else joined by shuffle, where adaptive execution splits it).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.text import unused
from prefloom.session import cut_lineage

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
# Metric: (direction, least distance of the fence from the quartile). Ratios count in 1/10000,
# the mean length of words in 1/1000 of a character.
FENCES = {
    "symbol_ratio": ("above", 300),
    "stutter_ratio": ("above", 1000),
    "dup_line_ratio": ("above", 4000),
    "long_words": ("above", 2500),
    "short_words": ("below", 1500),
}
SPREADS = 3  # a fence is that many interquartile ranges away, or further
LEAST_ROWS = 100  # smaller groups take the fences of the merged sketch
BROADCAST_ROWS = 100_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _windows(values: Column, n: Column, join) -> Column:
    """All windows of WINDOW = 8 values, by doubling: pairs, pairs of pairs, and those again. Each step is linear
    in the text; a slice per window would copy the whole array each time."""
    for step in (1, 2, 4):
        n = n - step
        values = F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(step + 1), n), join)
    return values


def _repeat_words(ordered: Column) -> Column:
    """Words covered by windows that equal a neighbour; ``ordered`` must be a column of its own, as an
    expression inside the lambda would be computed again for each element."""
    again = F.filter(
        ordered,
        lambda x, j: (F.get(ordered, j - 1)["w"] == x["w"]) | (F.get(ordered, j + 1)["w"] == x["w"]),
    )
    return F.aggregate(
        F.array_sort(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def with_metrics(df: DataFrame, text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with the counts, the ratios of FENCES and base_failed; same-named columns are replaced, others stay.

    A NULL text counts as empty: no words, so it fails the base rule. Ratios of nothing are 0. The rows are
    written to the shared folder once: a filter on a metric would else be pushed below the columns that it is
    made of, where the optimizer repeats their expressions inside each other's lambdas.
    """
    return cut_lineage(_measured(df, text_column) if keep_text else _measured(df, text_column).drop(text_column))


def _measured(df: DataFrame, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    added = [*COUNTS, *FENCES, "base_failed"]
    names = unused((*df.columns, *added), "words", "lines", "size", "hashes", "ordered", "stutter", "line_count", "text")
    words, lines, n, hashes, ordered = (F.col(c) for c in names[:5])
    stutter, line_count, kept_text = names[5:]
    out = df.withColumns(
        {
            kept_text: text,
            names[0]: F.array_remove(F.split(text, BLANKS), ""),
            names[1]: F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    out = out.drop(*(c for c in df.columns if c.lower() in added)).withColumn(names[2], F.size(words))
    text = F.col(kept_text)
    # Most texts have no two equal window hashes; the windows themselves are compared in those that have.
    hashed = _windows(F.transform(words, lambda x: F.xxhash64(x)), n, lambda a, b: F.xxhash64(a, b))
    out = out.withColumn(names[3], F.when(n > WINDOW, hashed).otherwise(F.array().cast("array<bigint>")))
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    joined = _windows(words, n, lambda a, b: F.concat_ws(" ", a, b))
    in_order = F.array_sort(F.transform(joined, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
    out = out.withColumn(names[4], F.when(repeated, in_order)).drop(names[3])
    stutters = F.size(F.filter(F.zip_with(words, F.slice(words, F.lit(2), n), lambda a, b: a == b), lambda x: x))
    out = out.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(_repeat_words(ordered), F.lit(0)).cast("long"),
            stutter: stutters.cast("long"),
            line_count: F.size(lines).cast("long"),
        }
    ).drop(names[0], names[1], names[2], names[4], kept_text)

    def ratio(part: str, whole: str, scale: int) -> Column:
        return F.when(F.col(whole) > 0, F.expr(f"{scale} * `{part}` div `{whole}`")).otherwise(F.lit(0).cast("long"))

    mean_length = ratio("word_chars", "n_words", 1000)
    return out.withColumns(
        {
            "symbol_ratio": ratio("n_symbols", "word_chars", 10000),
            "stutter_ratio": ratio(stutter, "n_words", 10000),
            "dup_line_ratio": ratio("n_dup_lines", line_count, 10000),
            "long_words": mean_length,
            "short_words": mean_length,
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    ).drop(stutter, line_count)


def sketches(metrics: DataFrame, group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Rows (language, source, metric, bucket, n) over the texts that pass the base rule; a bucket is
    named by its lowest value and has the upper seven bits of the values in common."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in FENCES])
    rows = metrics.where(~F.col("base_failed")).select(
        F.col(group[0]).cast("string").alias("lang"), F.col(group[1]).cast("string").alias("source"), F.inline(values)
    )
    spare = F.expr("greatest(length(bin(value)) - 7, 0)")
    rows = rows.withColumn("spare", spare).withColumn("bucket", F.expr("shiftleft(shiftright(value, spare), spare)"))
    return rows.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of fewer keys: counts of equal buckets added."""
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its rows and, for each metric, the fence that a value must not pass."""
    own = Window.partitionBy(*keys, "metric")
    upto = F.sum("n").over(own.orderBy("bucket"))
    placed = sketch.withColumns({"upto": upto, "total": F.sum("n").over(own)})

    def quantile(part: int) -> Column:
        return F.min(F.when(4 * F.col("upto") >= part * F.col("total"), F.col("bucket")))

    quartiles = placed.groupBy(*keys, "metric").agg(
        F.max("total").alias("rows"), quantile(1).alias("q1"), quantile(3).alias("q3")
    )
    least = F.create_map(*[x for m, (_, d) in FENCES.items() for x in (F.lit(m), F.lit(d))])
    width = F.greatest(SPREADS * (F.col("q3") - F.col("q1")), least[F.col("metric")].cast("long"))
    fence = F.when(F.col("metric") == "short_words", F.col("q1") - width).otherwise(F.col("q3") + width)
    per = quartiles.withColumn("fence", fence)
    out = per.groupBy(*keys).agg(
        F.max("rows").alias("rows"),
        *[F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(f"fence_{m}") for m in FENCES],
    )
    return out


def judge(metrics: DataFrame, sketch: DataFrame, group: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``metrics`` with rows_behind (of the sketch used) and kept, which replace columns of these names. A NULL language or source is a group
    like any other; a text whose group has no sketch (all its texts fail the base rule) is not kept anyway.
    """
    sketch = cut_lineage(sketch)
    names = [f"fence_{m}" for m in FENCES]
    by_source = fences(sketch, ["lang", "source"])
    by_lang = fences(merged(sketch, ["lang"]), ["lang"]).select(
        F.col("lang").alias("l"), F.col("rows").alias("l_rows"), *[F.col(x).alias(f"l_{x}") for x in names]
    )
    # One row, read here as five constants of the plan.
    everything = fences(merged(sketch, []).withColumn("one", F.lit(1)), ["one"]).first()
    table = by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    large, lang_large = F.col("rows") >= LEAST_ROWS, F.col("l_rows") >= LEAST_ROWS
    chosen = [F.when(large, F.col(x)).when(lang_large, F.col(f"l_{x}")).otherwise(F.lit(everything[x] if everything else None)).alias(x) for x in names]
    replaced = ("rows_behind", "kept")
    lang, source, found = unused((*metrics.columns, *replaced), "lang", "source", "found")
    table = cut_lineage(
        table.select(F.col("lang").alias(lang), F.col("source").alias(source), F.struct(F.col("rows").alias("rows_behind"), *chosen).alias(found))
    )
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    same = F.col(group[0]).cast("string").eqNullSafe(F.col(lang)) & F.col(group[1]).cast("string").eqNullSafe(F.col(source))
    inside = [
        F.col(m) <= F.col(f"{found}.fence_{m}") if side == "above" else F.col(m) >= F.col(f"{found}.fence_{m}")
        for m, (side, _) in FENCES.items()
    ]
    kept = ~F.col("base_failed") & F.coalesce(reduce(Column.__and__, inside), F.lit(False))
    others = [F.col(f"`{c}`") for c in metrics.columns if c.lower() not in replaced]
    judged = metrics.join(table, same, "left")
    return judged.select(*others, F.col(f"{found}.rows_behind").alias("rows_behind"), kept.alias("kept"))
