"""Exact self-join of shingle sets under Jaccard distance, region by region around pivots.

1. Sets are put in one order, rarer shingles first. Two linked sets share at least ``overlap`` of their
   first elements (their prefixes), so blocks ask for their prefix elements (see ``exchange``) and learn
   which of them other sets have too, and the pivot of each: the set with the smallest digest that has it.
2. The sets that have elements of a pivot form its region: a set belongs to the pivots of most of its
   elements and is replicated to as many further ones as a link could need (see ``kept_pivots``).
3. A region is joined recursively: the distances to its first set split it into a ball, whose members are
   linked through that set, and the rest. By the triangle inequality a set outside can only be linked to
   members in a window of distances; the rest is joined by itself in the same way.
4. Regions of more than HOT sets are thinned first: the members of the ball that no outside set can reach
   are settled by their distance to the pivot. What remains is joined in blocks of bounded size.
5. Links join classes of equal sets; components come from rounds of star contractions.

Distances to a bounded sample of pivots could not make regions here: texts with no shingle in common are all
at distance 1 from each other and from the sample, so every window would hold nearly every text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm import exchange
from prefloom.llm.text import LOWER, Spans, blocks, mixed, released, words
from prefloom.operators.skew import SLICES, hot_keys, is_one_of, join_unique
from prefloom.session import cut_lineage, scratch_path

WIDTH, LEAST_PERCENT = 4, 85
FREQUENT = 1_000_000  # at most so many frequent shingles are known to all tasks (16 bytes each)
HOT = 1024
PART_BYTES = 2 << 20
LEAST_TASKS = 64
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def needed(size, percent: int):
    """The least number of elements that a set of ``size`` has in common with a linked one."""
    return (percent * size + 99) // 100


def overlap(size):
    """How many prefix elements linked sets share at least, the smaller one counting."""
    return 1 + size // 20


class Sets:
    """The shingle sets of consecutive texts, ordered within each: ``flat`` from ``first[i]`` to ``first[i + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int, frequent: tuple[np.ndarray, np.ndarray] | None):
        own = words(LOWER[data], offsets)
        count = np.diff(own.first)
        spans = Spans(own.hash)
        start = np.arange(len(own.hash))
        doc = own.text
        whole = start + width <= own.first[1:][doc] if len(doc) else np.zeros(0, bool)
        whole |= (start == own.first[:-1][doc]) & (count[doc] < width)
        start, doc = start[whole], doc[whole]
        end = np.minimum(start + width, own.first[1:][doc])
        value = spans.of(start, end)
        rank = np.zeros(len(value), dtype=np.int64)
        if frequent is not None and len(frequent[0]) and len(value):
            at = np.minimum(np.searchsorted(frequent[0], value), len(frequent[0]) - 1)
            rank = np.where(frequent[0][at] == value, frequent[1][at], 0)
        order = np.lexsort((value, rank, doc))
        value, doc = value[order], doc[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]) if len(value) else np.zeros(0, bool)
        self.flat, self.doc = value[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        self.size = np.diff(self.first)
        sums = [np.zeros(len(self.flat) + 1, dtype=np.uint64) for _ in range(2)]
        np.cumsum(mixed(self.flat), out=sums[0][1:])
        np.cumsum(mixed(self.flat * _SECOND), out=sums[1][1:])
        self.one, self.two = (mixed(s[self.first[1:]] - s[self.first[:-1]]) | np.uint64(1) for s in sums)

    def prefixes(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Elements of the prefixes and the text of each."""
        length = np.where(self.size > 0, self.size - needed(self.size, percent) + overlap(self.size), 0)
        length = np.minimum(length, self.size)
        inside = np.arange(len(self.flat)) - self.first[:-1][self.doc] < length[self.doc]
        return self.flat[inside], self.doc[inside]


def sets_of(batch: pa.RecordBatch, width: int, frequent) -> Iterator[tuple[int, Sets]]:
    row = 0
    for block in blocks([batch], "text", PART_BYTES):
        yield row, Sets(block.data, block.offsets, width, frequent)
        row += block.rows.num_rows


def kept_pivots(pivots: np.ndarray, size: int, percent: int) -> np.ndarray:
    """The regions a set must be in, given the pivot of each shared prefix element.

    A linked set is no smaller than ``needed(size)``, so the two share overlap(needed(size)) elements at least.
    Each may leave out pivots with less than half of that: one shared element then has a pivot both keep.
    """
    least = overlap(needed(size, percent))
    if len(pivots) < least:
        return pivots[:0]
    value, count = np.unique(pivots, return_counts=True)
    order = np.argsort(count, kind="stable")
    out = np.cumsum(count[order]) <= (least - 1) // 2
    return value[order][~out]


def region_links(flat: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among sorted sets."""
    n = len(flat)
    size = np.array([len(f) for f in flat])
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []

    def common(one: int, others: np.ndarray) -> np.ndarray:
        joined = np.concatenate([flat[i] for i in others])
        at = np.minimum(np.searchsorted(flat[one], joined), size[one] - 1)
        edges = np.concatenate([[0], np.cumsum(size[others])[:-1]])
        return np.add.reduceat((flat[one][at] == joined).astype(np.int64), edges)

    def linked(one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = common(one, others)
        union = size[one] + size[others] - both
        close = 100 * both >= percent * union
        for i in others[close]:
            a, b = find(one), find(int(i))
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((one, int(i)))
        return close, 1 - both / union

    reach = 1 - percent / 100 + 1e-9
    left = np.arange(n)
    while len(left) > 1:
        pivot, left = int(left[0]), left[1:]
        fits = (percent * size[left] <= 100 * size[pivot]) & (percent * size[pivot] <= 100 * size[left])
        if not fits.any():
            continue
        close = np.zeros(len(left), dtype=bool)
        distance = np.full(len(left), 2.0)
        # Sets of other sizes cannot be linked to the pivot, but may be to members of its ball.
        near = (percent * percent * size[left] <= 10000 * size[pivot]) & (percent * percent * size[pivot] <= 10000 * size[left])
        close[near], distance[near] = linked(pivot, left[near])
        ball, at = left[close], distance[close]
        for i in np.flatnonzero(~close & (distance <= 2 * reach)):
            if len(ball) == 0:
                break
            outside = int(left[i])
            window = ball[at >= distance[i] - reach]
            if len(window) and find(outside) != find(pivot):
                linked(outside, window)
        left = left[~close]
    return links



LINK = "a1 long, a2 long, b1 long, b2 long"


def join_regions(table: pa.Table, percent: int) -> pa.Table:
    """Links in all regions of a task; equal sets of a region count once."""
    keys = [table.column(c).to_numpy() for c in ("region", "one", "two")]
    order = np.lexsort(keys[::-1])
    region, one, two = (k[order] for k in keys)
    new = np.concatenate([[True], (region[1:] != region[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    order, region, one, two = order[new], region[new], one[new], two[new]
    edges = [0, *(np.flatnonzero(region[1:] != region[:-1]) + 1).tolist(), len(region)]
    body = table.column("elements")
    rows = []
    for first, last in zip(edges, edges[1:]):
        if last - first > 1:
            flat = [np.sort(np.frombuffer(body[int(i)].as_buffer(), np.uint64)) for i in order[first:last]]
            for a, b in region_links(flat, percent):
                rows.append((one[first + a], two[first + a], one[first + b], two[first + b]))
    columns = list(zip(*rows)) or [()] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["a1", "a2", "b1", "b2"])


def _joined(rows: DataFrame, percent: int, tasks: int) -> DataFrame:
    dealt = rows.withColumn("share", F.pmod(F.xxhash64("region"), F.lit(tasks)))
    return dealt.groupBy("share").applyInArrow(lambda t: join_regions(t, percent), LINK)


def _hot_links(rows: DataFrame, percent: int, tasks: int) -> DataFrame:
    """Regions of many sets: the ball around a pivot is linked row by row; only what an outside set can reach goes on."""
    reach = 1 - percent / 100 + 1e-9
    centre = rows.groupBy("region").agg(F.min_by(F.struct("one", "two", "elements"), F.struct("one", "two")).alias("centre"))
    measured = rows.dropDuplicates(["region", "one", "two"]).join(cut_lineage(centre), "region")

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = []
            for own, pivot in zip(batch.column("elements"), batch.column("centre")):
                pivot = np.frombuffer(pivot["elements"].as_buffer(), np.uint64)
                common.append(len(np.intersect1d(np.frombuffer(own.as_buffer(), np.uint64), pivot, assume_unique=True)))
            centres = [batch.column("centre").field(c) for c in (0, 1)]
            union = [
                len(o.as_buffer()) // 8 + len(p["elements"].as_buffer()) // 8 - c
                for o, p, c in zip(batch.column("elements"), batch.column("centre"), common)
            ]
            out = batch.drop_columns(["centre"]).append_column("c1", centres[0]).append_column("c2", centres[1])
            out = out.append_column("common", pa.array(common, pa.int64()))
            yield out.append_column("whole", pa.array(union, pa.int64()))

    schema = "region long, one long, two long, elements binary, c1 long, c2 long, common long, whole long"
    measured = cut_lineage(measured.select("region", "one", "two", "elements", "centre").mapInArrow(measure, schema))
    close = F.expr(f"100 * common >= {percent} * whole")
    distance = 1 - F.col("common") / F.col("whole")
    links = measured.where(close).where("one != c1 or two != c2").select(F.col("c1").alias("a1"), F.col("c2").alias("a2"), F.col("one").alias("b1"), F.col("two").alias("b2"))
    outer = measured.where(~close).groupBy("region").agg(F.min(distance).alias("nearest"))
    left = measured.join(outer, "region").where(~close | (distance >= F.col("nearest") - reach)).drop("nearest")
    left = cut_lineage(left.select("region", "one", "two", "elements"))
    blocks_of = left.groupBy("region").agg(F.ceil(F.count("*") / (HOT // 2)).cast("int").alias("parts"))
    left = left.join(blocks_of, "region").withColumn("i", F.expr("cast(pmod(xxhash64(one, two), parts) as int)"))
    left = left.withColumn("j", F.explode(F.expr("sequence(0, parts - 1)")))
    block = F.xxhash64("region", F.least("i", "j"), F.greatest("i", "j"))
    return links.unionByName(_joined(left.select(block.alias("region"), "one", "two", "elements"), percent, tasks))


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) of all nodes of ``links`` (u, v long): root is the smallest node reachable.

    Alternating star contractions; a round joins and aggregates the links, whose number does not grow.
    """
    edges = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut_lineage(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u != v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = cut_lineage(small.select("e.u", "e.v").where("u != v").distinct())
        if after.count() == edges.count() and after.exceptAll(edges).isEmpty():
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        edges = after


def jaccard_classes(
    df: DataFrame, width: int = WIDTH, percent: int = LEAST_PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Columns ``id_column``, n_shingles, component_id, and is_first: whether the row stands for its component.

    Two texts are linked when their Jaccard similarity is ``percent`` / 100 or more. component_id is the
    smallest id reachable (NULL if all of them are NULL); of rows with that id one is first. Texts without
    words, empty and NULL ones are linked with nothing. Other columns are ignored; no rows give no rows.
    """
    spark = df.sparkSession
    stored = exchange.write_blocks(df, id_column, text_column)
    kind = df.schema[id_column].dataType.simpleString()

    def often(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                found = []
                for _, own in sets_of(exchange.unpacked(payload.as_py()), width, None):
                    _, leader = np.unique(own.one, return_index=True)
                    chosen = np.zeros(len(own.size), dtype=bool)
                    chosen[leader] = True
                    found.append(own.flat[chosen[own.doc]])
                key, count = np.unique(np.concatenate(found), return_counts=True)
                many = count >= 3
                yield pa.RecordBatch.from_arrays([pa.array(key[many].astype(np.int64)), pa.array(count[many].astype(np.int64))], ["key", "n"])

    counts = stored.mapInArrow(released(often), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 32")
    known = counts.orderBy(F.desc("n"), "key").limit(FREQUENT).toArrow()
    keys = known.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], known.column("n").to_numpy()[order]))

    def request(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        element, digest = [], []
        for _, own in sets_of(batch, width, shared.value):
            flat, doc = own.prefixes(percent)
            element.append(flat)
            digest.append(own.one[doc])
        element, digest = np.concatenate(element), np.concatenate(digest)
        order = np.lexsort((digest, element))
        element, digest = element[order], digest[order]
        new = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]])) if len(element) else np.zeros(0, np.int64)
        if not len(new):
            return element, digest, np.zeros(0, np.uint8)
        several = (np.maximum.reduceat(digest, new) != digest[new]).astype(np.uint8)
        return element[new], digest[new], several

    def merge(requests: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
        key, digest, several = (np.concatenate([r[i] for r in requests]) for i in range(3))
        order = np.argsort(key, kind="stable")
        key, digest, several = key[order], digest[order], several[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        head, group = np.flatnonzero(new), np.cumsum(new) - 1
        least = np.minimum.reduceat(digest, head)
        alone = (np.maximum.reduceat(digest, head) == least) & (np.maximum.reduceat(several, head) == 0)
        out = np.empty(len(key), dtype=np.uint64)
        out[order] = np.where(alone, np.uint64(0), least)[group]
        return np.split(out, np.cumsum([len(r[0]) for r in requests])[:-1])

    ranges = exchange.ranges_for(stored, exchange.BLOCK_BYTES // 30)
    replies = exchange.ask(stored, request, merge, ("uint64", "uint8"), "uint64", ranges)
    names = ["id", "row", "size", "region", "one", "two", "elements"]
    schema = f"id {kind}, row long, size long, region long, one long, two long, elements binary"

    def regions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, parts in zip(batch.column("block"), batch.column("payload"), batch.column("parts")):
                docs = exchange.unpacked(payload.as_py())
                asked = request(docs)[0]
                pivot = exchange.joined(parts, "uint64") if parts.is_valid else np.zeros(0, np.uint64)
                sent: set[tuple[int, int]] = set()
                for base, own in sets_of(docs, width, shared.value):
                    n = len(own.size)
                    one, two = own.one.astype(np.int64), own.two.astype(np.int64)
                    row = exchange.row_numbers(block.as_py(), base, n)
                    empty = pa.nulls(n, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [docs.column(0).slice(base, n), pa.array(row), pa.array(own.size), empty, pa.array(one), pa.array(two), pa.nulls(n, pa.binary())],
                        names,
                    )
                    flat, doc = own.prefixes(percent)
                    to = pivot[np.searchsorted(asked, flat)] if len(asked) else flat
                    flat, doc, to = flat[to > 0], doc[to > 0], to[to > 0]
                    edges = np.searchsorted(doc, np.arange(n + 1))
                    rows = []
                    for d in np.flatnonzero(np.diff(edges)):
                        mark = (int(one[d]), int(two[d]))
                        if mark in sent:
                            continue
                        sent.add(mark)
                        body = None
                        for region in kept_pivots(to[edges[d] : edges[d + 1]], int(own.size[d]), percent).astype(np.int64):
                            body = body or own.flat[own.first[d] : own.first[d + 1]].tobytes()
                            rows.append((int(region), *mark, body))
                    if rows:
                        r, a, b, e = zip(*rows)
                        none = pa.nulls(len(rows), pa.int64())
                        arrays = [pa.nulls(len(rows), docs.column(0).type), none, none]
                        arrays += [pa.array(x, pa.int64()) for x in (r, a, b)] + [pa.array(e, pa.binary())]
                        yield pa.RecordBatch.from_arrays(arrays, names)

    path = scratch_path(spark, "regions")
    stored.join(replies, "block", "left").mapInArrow(released(regions), schema).write.parquet(path)
    noted = spark.read.parquet(path)
    rows = noted.where(F.col("region").isNull()).select("id", "row", "size", "one", "two")
    members = noted.where(F.col("region").isNotNull()).select("region", "one", "two", "elements")
    sizes = members.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    sizes = cut_lineage(sizes)
    tasks = max(LEAST_TASKS, members.count() // 20_000)
    links = _joined(members.join(sizes.where(F.col("n") <= HOT).select("region"), "region", "left_semi"), percent, tasks)
    hot = sizes.where(F.col("n") > HOT).select("region")
    if not hot.isEmpty():
        links = links.unionByName(_hot_links(members.join(hot, "region", "left_semi"), percent, tasks))
    links = cut_lineage(links)
    # Equal sets are one node, named after the first row that has the set.
    nodes = rows.where("size > 0").groupBy("one", "two").agg(F.min("row").alias("node"))
    nodes = cut_lineage(nodes)
    named = links.join(nodes.select(F.col("one").alias("a1"), F.col("two").alias("a2"), F.col("node").alias("u")), ["a1", "a2"])
    named = named.join(nodes.select(F.col("one").alias("b1"), F.col("two").alias("b2"), F.col("node").alias("v")), ["b1", "b2"])
    roots = nodes.join(components(named.select("u", "v")), "node", "left")
    roots = roots.select("one", "two", F.coalesce("root", "node").alias("root"))
    # A set or a component that many rows have is joined in slices: its one answer row is repeated for each.
    is_hot = is_one_of(F.col("one"), hot_keys(rows, "one"))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(SLICES - 1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("slice", F.when(is_hot, F.pmod(F.xxhash64("row"), F.lit(SLICES)).cast("int")).otherwise(F.lit(0)))
    placed = rows.join(roots.withColumn("slice", F.explode(copies)), ["one", "two", "slice"], "left")
    placed = cut_lineage(placed.select("id", "row", "size", F.when(F.col("size") > 0, F.col("root")).otherwise(F.col("row")).alias("root")))
    least = placed.groupBy("root").agg(
        F.min("id").alias("least"), F.min_by("row", F.struct(F.col("id").isNull(), "id", "row")).alias("first")
    )
    return join_unique(placed, least, "root", hot_keys(placed, "root"), ["row"]).select(
        F.col("id").alias(id_column),
        F.col("size").alias("n_shingles"),
        F.col("least").alias("component_id"),
        (F.col("row") == F.col("first")).alias("is_first"),
    )
