"""Sources, sinks, routing and joins over comparison and rating records."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.catalog import views as v
from prefloom.catalog.registry import query
from prefloom.catalog.views import TOKENIZER, joined, rounded, sql_joined, sql_round, sql_words, with_views
from prefloom.operators import pairs as pr
from prefloom.operators import records as rec
from prefloom.operators.scoring import attach_scores, centre_scores, unscored
from prefloom.schemas import SftParams
from prefloom.session import scratch_path
from prefloom.sources import feedback, tables
from prefloom.sources.published import publish, published, read_published

ROUTED = """CASE split WHEN 'train' THEN 'train' ELSE 'validation' END"""
AXIS_ROUTED = """CASE split WHEN 'test' THEN 'test' ELSE 'validation' END"""


def comparison_files(spark, d) -> str:
    """The comparison records as JSON lines in the shared folder."""
    path = scratch_path(spark, "comparisons")
    v.comparisons(spark, d).write.json(path)
    return path


def axis_files(spark, d) -> str:
    path = scratch_path(spark, "axis")
    v.axis_evals(spark, d).write.json(path)
    return path


@query(
    "read_comparisons",
    with_views(" SELECT id, post, subreddit, text0, text1, choice, worker, batch, split, confidence FROM v_comparisons", "v_comparisons"),
)
def read_comparisons_query(spark, d):
    rows = feedback.read_comparisons(spark, comparison_files(spark, d))
    return rows.select(
        "info.id",
        "info.post",
        "info.subreddit",
        F.get("summaries", 0)["text"].alias("text0"),
        F.get("summaries", 1)["text"].alias("text1"),
        "choice",
        "worker",
        "batch",
        "split",
        "extra.confidence",
    )


@query(
    "read_axis_evals",
    with_views(" SELECT id, title, summary, overall, accuracy, coverage, coherence, compatible, batch, split FROM v_axis", "v_axis"),
)
def read_axis_evals_query(spark, d):
    rows = feedback.read_axis_evals(spark, axis_files(spark, d))
    return rows.select("info.id", "info.title", F.col("summary.text").alias("summary"), "summary.axes.*", "batch", "split")


@query(
    "read_feedback",
    with_views(
        " SELECT 'comparisons' AS kind, split, count(*) AS n FROM v_comparisons GROUP BY split "
        "UNION ALL SELECT 'axis', split, count(*) FROM v_axis GROUP BY split",
        "v_comparisons",
        "v_axis",
    ),
)
def read_feedback_query(spark, d):
    kinds = {"comparisons": comparison_files(spark, d), "axis": axis_files(spark, d)}
    parts = [
        feedback.read_feedback(spark, kind, path).groupBy("split").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "split", "n")
        for kind, path in kinds.items()
    ]
    return parts[0].unionByName(parts[1])


_NULLABLE = ("overall", "accuracy", "coverage", "coherence", "compatible", "subreddit", "title", "post")


@query(
    "null_defaults",
    with_views(
        " SELECT split, count(*) AS n, "
        + ", ".join(f"(count(*) - count({c})) AS no_{c}" for c in _NULLABLE)
        + ", count(*) AS no_site FROM v_axis GROUP BY split",
        "v_axis",
    ),
)
def null_defaults_query(spark, d):
    rows = feedback.read_axis_evals(spark, axis_files(spark, d)).select("split", "info.*", "summary.axes.*")
    missing = [F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in (*_NULLABLE, "site")]
    return rows.groupBy("split").agg(F.count("*").alias("n"), *missing)


@query(
    "read_table",
    with_views(f" SELECT id, {ROUTED} AS split, text0, text1, choice FROM v_comparisons WHERE split <> 'train'", "v_comparisons"),
)
def read_table_query(spark, d):
    path = scratch_path(spark, "table")
    rows = rec.route_split(v.comparisons(spark, d))
    flat = rows.select(
        "info.id", "split", F.get("summaries", 0)["text"].alias("text0"), F.get("summaries", 1)["text"].alias("text1"), "choice"
    )
    flat.write.partitionBy("split").parquet(path)
    return tables.read_table(spark, path, "validation")


@query("write_versioned", with_views(f" SELECT id, {AXIS_ROUTED} AS split, post AS summary FROM v_axis", "v_axis"))
def write_versioned_query(spark, d):
    rows = rec.route_split(v.axis_evals(spark, d), rec.AXIS_SPLITS)
    flat = rows.select("info.id", "split", F.col("info.post").alias("summary"))
    return spark.read.schema(flat.schema).parquet(tables.write_versioned(flat, scratch_path(spark, "versioned"), "20240101_000000"))


@query(
    "publish",
    with_views(
        f" SELECT id, {AXIS_ROUTED} AS split, summary, count(*) OVER (PARTITION BY {AXIS_ROUTED}) AS logged_rows, "
        "'20240102_000000' AS version FROM v_axis",
        "v_axis",
    ),
)
def publish_query(spark, d):
    """Two versions are published and the current one is read, beside the row counts of its log."""
    base = scratch_path(spark, "table")
    rows = rec.route_split(v.axis_evals(spark, d), rec.AXIS_SPLITS)
    flat = rows.select("info.id", "split", F.col("summary.text").alias("summary"))
    for version in ("20240101_000000", "20240102_000000"):
        publish(flat, base, version, SftParams(), "documents")
    log = published(spark, base).orderBy(F.desc("version")).limit(1).select("version", F.inline("splits"))
    return read_published(spark, base).join(F.broadcast(log), "split").withColumnRenamed("n_rows", "logged_rows")


@query(
    "write_manifest",
    with_views(
        f", s AS (SELECT {AXIS_ROUTED} AS split FROM v_axis) "
        "SELECT 'documents' AS source, split, count(*) AS n_rows, 3 AS n_columns, 512 AS budget FROM s GROUP BY split",
        "v_axis",
    ),
)
def write_manifest_query(spark, d):
    rows = rec.route_split(v.axis_evals(spark, d), rec.AXIS_SPLITS).select("info.id", "split", F.col("summary.text").alias("summary"))
    described = tables.with_comments(rows, {"id": "document the summary is of", "summary": "rated summary"})
    path = tables.write_manifest(described, scratch_path(spark, "described"), SftParams(), "documents")
    schema = "source string, columns string, params string, splits array<struct<split:string,n_rows:bigint>>"
    row = spark.read.schema(schema).json(path).withColumn("s", F.explode("splits"))
    return row.select(
        "source",
        "s.split",
        "s.n_rows",
        F.json_array_length("columns").alias("n_columns"),
        F.get_json_object("params", "$.budget").cast("int").alias("budget"),
    )


@query(
    "write_with_scores",
    f"SELECT doc_id, n_chars, {sql_round('n_chars / 1000.0::DOUBLE')} AS reward FROM documents",
)
def write_with_scores_query(spark, d):
    rows = v.table(spark, d, "documents").select("doc_id", "n_chars")
    path = tables.write_with_scores(rows, scratch_path(spark, "scored"), F.col("n_chars") / F.lit(1000.0))
    return spark.read.parquet(path).select("doc_id", "n_chars", rounded("reward").alias("reward"))


@query(
    "write_text_report",
    "SELECT turn::INT AS step, 'Reward: ' || printf('%.4f', conv_id / 4.0::DOUBLE) AS reward_line, text || chr(10) || repeat('=', 100) AS body FROM conversations",
)
def write_text_report_query(spark, d):
    path = scratch_path(spark, "report")
    rows = v.table(spark, d, "conversations").withColumn("reward", F.col("conv_id") / F.lit(4.0))
    tables.write_text_report(rows, path, "turn", "reward", "text")
    # Records end with the rule line, so the report splits back into records there.
    rule = "=" * 100 + "\n"
    lines = spark.read.option("lineSep", rule).text(path)
    first_break = F.instr("value", "\n")
    return lines.select(
        "step",
        F.left("value", first_break - 1).alias("reward_line"),
        F.concat(F.substr("value", first_break + 1), F.lit(rule[:-1])).alias("body"),
    )


@query(
    "append_metrics",
    "SELECT event_type AS run, event_id AS step, metric, round(value + 1e-9, 6) + 0.0 AS value FROM ("
    "SELECT event_type, event_id, 'train_loss' AS metric, value FROM events UNION ALL "
    "SELECT event_type, event_id, 'learning_rate', value / 2 FROM events)",
)
def append_metrics_query(spark, d):
    path = scratch_path(spark, "metrics")
    wide = v.table(spark, d, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("train_loss"), (F.col("value") / 2).alias("learning_rate")
    )
    tables.append_metrics(wide, path, "train_loss", "learning_rate")
    return spark.read.parquet(path).withColumn("value", rounded("value"))


@query("route_split", with_views(f" SELECT id, turn, split AS source_split, {ROUTED} AS split FROM v_comparisons", "v_comparisons"))
def route_split_query(spark, d):
    rows = rec.route_split(v.comparisons(spark, d).withColumn("source_split", F.col("split")))
    return rows.select("info.id", F.substr("worker", F.lit(2)).cast("bigint").alias("turn"), "source_split", "split")


@query(
    "exclude_batches",
    with_views(
        f", r AS (SELECT id, worker, {ROUTED} AS split, CASE WHEN conv_id % 7 <> 0 THEN batch END AS batch FROM v_comparisons) "
        "SELECT * FROM r WHERE split = 'train' OR batch IS NULL OR batch NOT IN ('batch0_cnndm', 'cnndm0', 'cnndm2')",
        "v_comparisons",
    ),
)
def exclude_batches_query(spark, d):
    rows = rec.route_split(v.comparisons(spark, d)).withColumn("batch", F.when(F.col("info.id").cast("bigint") % 7 != 0, F.col("batch")))
    return rec.exclude_batches(rows).select("info.id", "worker", "split", "batch")


_PICKED = "CASE choice WHEN 0 THEN text0 ELSE text1 END AS chosen, CASE choice WHEN 0 THEN text1 ELSE text0 END AS rejected"


@query("pick_chosen_rejected", with_views(f" SELECT id, worker, {_PICKED} FROM v_comparisons", "v_comparisons"))
def pick_chosen_rejected_query(spark, d):
    return rec.pick_chosen_rejected(v.comparisons(spark, d)).select("info.id", "worker", "chosen", "rejected")


@query(
    "response_length_stats",
    with_views(
        f", r AS (SELECT {ROUTED} AS split, unnest([text0, text1]) AS t FROM v_comparisons), "
        f"n AS (SELECT split, len({sql_words('t')}) + 1 AS l FROM r) "
        f"SELECT split, count(*) AS n_responses, max(l)::INT AS max_length, {sql_round('avg(l)')} AS mean_length, {sql_round('quantile_cont(l, 0.99)')} AS p99_length FROM n GROUP BY split",
        "v_comparisons",
    ),
)
def response_length_stats_query(spark, d):
    stats = rec.response_length_stats(rec.route_split(v.comparisons(spark, d)), TOKENIZER)
    return stats.withColumns({c: rounded(c) for c in ("mean_length", "p99_length")})


@query("split_counts", with_views(f" SELECT {ROUTED} AS split, count(*) AS n FROM v_comparisons GROUP BY 1", "v_comparisons"))
def split_counts_query(spark, d):
    return rec.split_counts(rec.route_split(v.comparisons(spark, d)))


@query(
    "stack_pairs",
    with_views(
        f" SELECT pair_id, 'chosen' AS side, {sql_round('chosen')} AS score FROM v_pairs "
        f"UNION ALL SELECT pair_id, 'rejected', {sql_round('rejected')} FROM v_pairs",
        "v_pairs",
    ),
)
def stack_pairs_query(spark, d):
    stacked = pr.stack_pairs(v.pairs(spark, d), ["pair_id"], score=("chosen", "rejected"))
    return stacked.withColumn("score", rounded("score"))


@query(
    "unstack_pairs",
    with_views(f" SELECT pair_id, {sql_round('chosen')} AS chosen, {sql_round('rejected')} AS rejected FROM v_pairs", "v_pairs"),
)
def unstack_pairs_query(spark, d):
    wide = pr.unstack_pairs(v.pair_sides(spark, d), ["pair_id"], "score")
    return wide.select("pair_id", rounded("chosen").alias("chosen"), rounded("rejected").alias("rejected"))


@query(
    "attach_scores",
    "SELECT d.doc_id, d.n_chars, coalesce(l.quality, -1) AS score, l.doc_id IS NULL AS unscored FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def attach_scores_query(spark, d):
    documents = v.table(spark, d, "documents").select("doc_id", "n_chars")
    scores = v.table(spark, d, "labels").select("doc_id", F.col("quality").alias("score"))
    missing = unscored(documents, scores, "doc_id").select("doc_id", F.lit(True).alias("unscored"))
    both = attach_scores(attach_scores(documents, scores, "doc_id"), missing, "doc_id", "unscored")
    return both.select("doc_id", "n_chars", F.coalesce("score", F.lit(-1)).alias("score"), F.coalesce("unscored", F.lit(False)).alias("unscored"))


@query(
    "align_policy_reference",
    with_views(
        " SELECT vec_id, "
        + ", ".join(
            f"{sql_round(f'(SELECT sum(x) FROM (SELECT unnest({c}_log_probs) AS x))')} AS {c}_sum, {sql_round(f'{c}_log_probs[1]')} AS {c}_first"
            for c in ("policy", "old", "ref")
        )
        + " FROM v_aligned",
        "v_aligned",
    ),
)
def align_policy_reference_query(spark, d):
    aligned = pr.align_policy_reference(v.token_log(spark, d), v.old_log(spark, d), v.reference_log(spark, d), "vec_id")
    out = ["vec_id"]
    for c in ("policy", "old", "ref"):
        values = F.col(f"{c}_log_probs")
        out.append(rounded(F.aggregate(values, F.lit(0.0), lambda s, x: s + x)).alias(f"{c}_sum"))
        out.append(rounded(F.get(values, 0)).alias(f"{c}_first"))
    return aligned.select(*out)


@query(
    "centre_scores",
    f"SELECT event_id, {sql_round('value - (SELECT avg(value) FROM events)')} AS centred_score FROM events",
)
def centre_scores_query(spark, d):
    centred = centre_scores(v.table(spark, d, "events"), "value")
    return centred.select("event_id", rounded("centred_score").alias("centred_score"))


@query(
    "assemble_splits",
    with_views(
        f" SELECT id, worker, {_PICKED}, {ROUTED} AS split FROM v_comparisons "
        "WHERE split = 'train' OR batch <> 'cnndm0'",
        "v_comparisons",
    ),
)
def assemble_splits_query(spark, d):
    rows = rec.pick_chosen_rejected(rec.exclude_batches(rec.route_split(v.comparisons(spark, d))))
    flat = rows.select("info.id", "worker", "chosen", "rejected", "split")
    return rec.assemble_splits(**{name: flat.where(F.col("split") == name) for name in ("train", "validation")})


@query(
    "project_for",
    with_views(f" SELECT id, {sql_joined('tokens')} AS query_tokens FROM (SELECT id, {v.sql_ids('post')} AS tokens FROM v_posts)", "v_posts"),
)
def project_for_query(spark, d):
    rows = v.posts(spark, d).withColumn("query_tokens", TOKENIZER.encode(F.col("post")))
    needed = rec.project_for(rows, "rollout", keys=["id"])
    return needed.withColumn("query_tokens", joined("query_tokens"))
