"""Groups, shuffles, batches and step-keyed metrics over the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefloom.catalog import views as v
from prefloom.catalog.registry import query
from prefloom.catalog.views import rounded, sql_round, with_views
from prefloom.functions.sequences import attention_mask
from prefloom.operators import groups as gr
from prefloom.operators import metrics as mt
from prefloom.operators import ordering as od

GROUPED = (
    "SELECT event_id, prompt_id, score - avg(score) OVER g AS centred, "
    "coalesce((score - avg(score) OVER g) / (stddev_samp(score) OVER g + 1e-7), 0) AS advantage, n_tokens "
    "FROM v_rollouts WINDOW g AS (PARTITION BY prompt_id)"
)


def events(spark, d, *columns):
    return v.table(spark, d, "events").select("event_id", *columns)


def sql_key(seed: int, epoch: str) -> str:
    return f"md5('{seed}:' || {epoch} || ':' || event_id)"


@query("check_group_size", with_views(" SELECT prompt_id, count(*) AS n FROM v_rollouts GROUP BY prompt_id", "v_rollouts"))
def check_group_size_query(spark, d):
    return gr.check_group_size(v.rollouts(spark, d), "prompt_id", 8)


def advantages(spark, d, normalize):
    rows = v.rollouts(spark, d).select("event_id", "prompt_id", "score")
    out = gr.group_advantage(rows, "prompt_id", normalize=normalize)
    return out.select("event_id", "prompt_id", rounded("advantage").alias("advantage"))


@query(
    "group_advantage",
    with_views(f", g AS ({GROUPED}) SELECT event_id, prompt_id, {sql_round('advantage')} AS advantage FROM g", "v_rollouts"),
)
def group_advantage_query(spark, d):
    return advantages(spark, d, normalize=True)


@query(
    "group_advantage_centred",
    with_views(f", g AS ({GROUPED}) SELECT event_id, prompt_id, {sql_round('centred')} AS advantage FROM g", "v_rollouts"),
)
def group_advantage_centred_query(spark, d):
    return advantages(spark, d, normalize=False)


@query(
    "broadcast_advantage",
    with_views(
        f", g AS ({GROUPED}) SELECT event_id, 64 AS width, n_tokens AS n_set, {sql_round('advantage * n_tokens')} AS total FROM g",
        "v_rollouts",
    ),
)
def broadcast_advantage_query(spark, d):
    rows = gr.group_advantage(v.rollouts(spark, d), "prompt_id").withColumn("mask", attention_mask(F.col("response_tokens"), 0))
    spread = gr.broadcast_advantage(rows, "mask")
    return spread.select(
        "event_id",
        F.size("advantages").alias("width"),
        F.size(F.array_remove("mask", F.lit(False))).alias("n_set"),
        rounded(F.aggregate("advantages", F.lit(0.0), lambda s, x: s + x)).alias("total"),
    )


@query("assign_groups", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 8 AS group_id FROM events")
def assign_groups_query(spark, d):
    return od.assign_groups(events(spark, d), 8, "event_id")


@query(
    "best_so_far",
    with_views(
        ", b AS (SELECT *, min(eval_loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM v_metrics) "
        "SELECT run, step, eval_loss FROM b WHERE best IS NULL OR eval_loss < best",
        "v_metrics",
    ),
)
def best_so_far_query(spark, d):
    return mt.best_so_far(v.metrics(spark, d), "eval_loss").select("run", "step", "eval_loss")


@query(
    "is_cadence_step",
    with_views(
        " SELECT step, (step + 1) % 100 = 0 AS eval_step, step % 100 = 0 OR step >= (SELECT max(step) FROM v_metrics) AS eval_or_last FROM v_metrics "
        "WHERE (step + 1) % 100 = 0 OR step % 100 = 0 OR step >= (SELECT max(step) FROM v_metrics)",
        "v_metrics",
    ),
)
def is_cadence_step_query(spark, d):
    metrics = v.metrics(spark, d)
    last = metrics.agg(F.max("step")).scalar()
    flags = metrics.select(
        "step",
        mt.is_cadence_step(F.col("step"), 100).alias("eval_step"),
        mt.is_cadence_step(F.col("step"), 100, offset=0, last_step=last).alias("eval_or_last"),
    )
    return flags.where("eval_step or eval_or_last")


@query(
    "seeded_shuffle",
    f"SELECT event_id, {sql_key(42, '1')} AS shuffle_key, row_number() OVER (ORDER BY {sql_key(42, '1')}, event_id) - 1 AS position FROM events",
)
def seeded_shuffle_query(spark, d):
    keyed = od.shuffled_positions(events(spark, d), "event_id", seed=42, epoch=1)
    return od.seeded_shuffle(keyed, "event_id", seed=42, epoch=1)


def sql_batches(order: str) -> str:
    return (
        f"WITH p AS (SELECT event_id, row_number() OVER (ORDER BY {order}) - 1 AS position FROM events) "
        "SELECT *, position // 24 AS batch_id FROM p"
    )


@query("assign_batches", sql_batches("event_id"))
def assign_batches_query(spark, d):
    return od.assign_batches(events(spark, d), 24, "event_id")


@query("assign_batches_shuffled", sql_batches(f"{sql_key(7, '0')}, event_id"))
def assign_batches_shuffled_query(spark, d):
    return od.assign_batches(events(spark, d), 24, "event_id", seed=7)


@query(
    "assign_minibatches",
    ", ".join(["WITH u AS (SELECT event_id, u::INT AS \"update\" FROM events CROSS JOIN range(3) AS r(u))"])
    + f", p AS (SELECT *, row_number() OVER (PARTITION BY \"update\" ORDER BY {sql_key(11, chr(34) + 'update' + chr(34))}, event_id) - 1 AS position FROM u) "
    'SELECT event_id, "update", position, position // 64 AS mini_batch, (position % 64) // 8 AS micro_batch FROM p',
)
def assign_minibatches_query(spark, d):
    return od.assign_minibatches(events(spark, d), "event_id", updates=3, mini_size=64, micro_size=8, seed=11)


@query("take_first", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 1000")
def take_first_query(spark, d):
    return od.take_first(events(spark, d, "value"), 1000, "event_id")
