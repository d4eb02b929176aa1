"""Advantages of response groups in a stream: a group is emitted once all its responses are there.

The state of a group is its responses so far (at most ``size`` - 1 of them); afterwards one mark, by which late
responses are known for a while. So neither a busy group nor a long stream lets it grow. The groups of a bucket
are read and stored together, once a micro-batch. Time is the
clock's when a row's micro-batch began: with the events' own times Spark would drop rows behind the watermark,
and here no row may be lost.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from prefloom.operators.groups import STD_EPSILON

RESULT = Row("group_key", "member", "score", "advantage", "status")
# Groups share the state of their bucket, so that a micro-batch costs few messages between Python and the JVM.
BUCKETS = 65_536
# The groups of a bucket: what is held of each, the time it was done (NULL while it is open) and when it is looked at next.
# Names are pickled, as values of some types come back from the state as others.
GROUPS = "groups array<struct<name: binary, members: array<bigint>, scores: array<double>, closed: bigint, due: bigint>>, timer bigint"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _same(name):
    """A group's name as a key of a dictionary, equal where Spark groups names together."""
    if isinstance(name, (list, tuple)):
        return tuple(map(_same, name))
    if isinstance(name, bytearray):
        return bytes(name)
    return name if name == name else "nan"


class GroupCompletion(StatefulProcessor):
    """Rows (group_key, member, score, at) of a bucket to rows (group_key, member, score, advantage, status)."""

    def __init__(self, size: int, wait_ms: int, remember_ms: int, normalize: bool):
        self.size, self.wait_ms, self.remember_ms, self.normalize = size, wait_ms, remember_ms, normalize

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bucket", GROUPS)

    def _load(self) -> tuple[dict, int | None]:
        """The groups of the bucket, each [name, held, closed, due], and its timer."""
        groups, timer = self.state.get() or ((), None)
        loaded = [[pickle.loads(g[0]), dict(zip(g[1], g[2])), g[3], g[4]] for g in groups]
        return {_same(g[0]): g for g in loaded}, timer

    def _store(self, groups: dict, timer: int | None) -> None:
        """Keep the groups, with one timer for the first of them to be looked at; ``timer`` is the one set so far."""
        if not groups:
            self.state.clear()
            return
        due = min(g[3] for g in groups.values())
        rows = [(pickle.dumps(name), list(held), list(held.values()), *times) for name, held, *times in groups.values()]
        self.state.update((rows, due))
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def advantages(self, scores: list[float | None]) -> list[float | None]:
        """As ``operators.groups.group_advantage``: NULL scores count in the size of the group only."""
        known = [s for s in scores if s is not None]
        mean = math.fsum(known) / len(known) if known else 0.0
        scale = 1.0
        if self.normalize:
            spread = math.fsum((s - mean) ** 2 for s in known)
            scale = (math.sqrt(spread / (len(known) - 1)) if len(known) > 1 else 0.0) + STD_EPSILON
        return [None if s is None else (s - mean) / scale for s in scores]

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        groups, timer = self._load()
        changed = False
        for row in rows:
            now, name = int(row.at.timestamp() * 1000), _same(row.group_key)
            group = groups.get(name)
            if group and group[2] is not None:
                if now - group[2] <= self.remember_ms:
                    yield RESULT(row.group_key, row.member, row.score, None, "late")
                    continue
                group = None  # to be forgotten with this micro-batch
            if group is None:
                group = groups[name] = [row.group_key, {}, None, now + self.wait_ms]
            held = group[1]
            if row.member in held:
                yield RESULT(row.group_key, row.member, row.score, None, "repeated")
                continue
            held[row.member], changed = row.score, True
            if len(held) == self.size:
                members = sorted(held)
                for member, advantage in zip(members, self.advantages([held[m] for m in members])):
                    yield RESULT(group[0], member, held[member], advantage, "complete")
                group[1:] = {}, now, now + self.remember_ms
        if changed:
            self._store(groups, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        groups, _ = self._load()
        now, expired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        for same, (name, held, closed, due) in list(groups.items()):
            if due > now:
                continue
            if closed is not None:
                del groups[same]
                continue
            for member in sorted(held):
                yield RESULT(name, member, held[member], None, "incomplete")
            groups[same][1:] = {}, now, max(now + self.remember_ms, expired + 1)
        self._store(groups, None)  # the expired timer goes by itself

    def close(self) -> None:
        pass


def complete_groups(
    stream: DataFrame,
    group: str,
    member: str,
    score: str,
    size: int,
    wait: timedelta = timedelta(hours=1),
    remember: timedelta = timedelta(days=1),
    skew: timedelta = timedelta(minutes=10),
    normalize: bool = True,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Columns ``group``, ``member`` (a whole number), ``score``, advantage, status: each response of a stream once.

    "complete": its group of ``size`` was complete when it was emitted, advantage as ``group_advantage`` has it.
    "incomplete": the others did not come within ``wait`` after the group's first response. "repeated": the group
    already holds that member. "late": its group is done; marks of done groups are kept for ``remember``, after
    which the same key is a new group. Only complete rows have an advantage (a NULL score has none). Waiting ends
    with a micro-batch ``skew`` after its time; so much may the clock go back when the query starts elsewhere. Rows without a group or member belong to no group and are left out.
    Groups share the state of one of ``buckets`` buckets, which a query keeps for as long as its checkpoint.
    Sets the session's state store to the one that such state needs; queries that run already keep theirs.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    milliseconds = [int(t.total_seconds() * 1000) for t in (wait, remember)]
    kind = stream.schema[group].dataType.simpleString()
    rows = stream.select(
        F.col(group).alias("group_key"),
        F.col(member).cast("long").alias("member"),
        F.col(score).cast("double").alias("score"),
        F.current_timestamp().alias("at"),
    ).where("group_key IS NOT NULL AND member IS NOT NULL")
    rows = rows.withWatermark("at", f"{int(skew.total_seconds() * 1000)} milliseconds")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("group_key"), F.lit(buckets)))
    done = rows.groupBy("bucket").transformWithState(
        GroupCompletion(size, *milliseconds, normalize),
        outputStructType=f"group_key {kind}, member long, score double, advantage double, status string",
        outputMode="append",
        timeMode="EventTime",
    )
    return done.select(F.col("group_key").alias(group), F.col("member").alias(member), F.col("score").alias(score), "advantage", "status")
