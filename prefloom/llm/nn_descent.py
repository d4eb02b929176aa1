"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours.

1. Equal vectors become one node. Nodes are sorted by the signs of random projections, several times over, and
   every window of the order gives first neighbours.
2. A round: each node sends its vector to some of its neighbours, new ones first; those that meet at a node are
   neighbours of a neighbour and are compared there; what is nearer than a list's last entry goes to that list.
   A list that is saturated, all its entries being links, is enlarged from K to at most K_MAX entries.
3. The audit: a sample of nodes is compared with all nodes, once. Rounds go on until few new links appear; if by
   then the lists hold less of the sample's links than asked for, further projections are added.
4. The threshold edges of the lists stay, those near the threshold after a comparison of the whole vectors.
   Links of a node whose list is saturated even at K_MAX are counted within its component: members within half
   the threshold's angle of the component's mean direction are all linked with each other and need no
   comparison; what else there is is compared in blocks, which give sums and no pairs.

Lists and messages carry unit vectors of 16-bit numbers; their error is below SLACK, and only links further from
the threshold than that are taken without the whole vectors.
"""

from __future__ import annotations

import hashlib
import math
import warnings
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefloom.llm.exchange import BLOCK_BITS, ROW_BITS
from prefloom.llm.jaccard_join import components
from prefloom.llm.text import mixed
from prefloom.operators.skew import hot_keys, join_unique
from prefloom.session import cut_lineage, scratch_path

K, K_MAX = 16, 128
TREES, CODE_BITS, WINDOW = 4, 62, 512
SENT_NEW, SENT_OLD = 8, 4
MEETING = 64  # vectors that are compared at once where they meet
MAX_ROUNDS = 12
FEW_NEW = 0.005  # the audit comes when a round has found no more than this share of the links
RECALL = 0.97
AUDITED = 2048
SLACK = 2e-3
BLOCK = 1024
STEP_BYTES = 16 << 20
GRAPH = "node long, x binary, near array<long>, sim array<float>, fresh array<boolean>"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Length of each list and all values."""
    return np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)


def _list_array(lengths: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


def _by_dim(column: pa.Array, kind: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrices of vectors of one dimension, some megabytes at a time; rows keep their order."""
    width = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1])
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        step = max(MEETING, STEP_BYTES // max(1, int(w)))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            body = b"".join(column.take(pa.array(own)).to_pylist())
            yield own, np.frombuffer(body, dtype=kind).reshape(len(own), -1)


def _chance(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """A number in [0, 1) that depends on both ids, the same whenever a task runs again."""
    x = mixed(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) + np.uint64(salt << 32))
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _units(values: np.ndarray) -> np.ndarray:
    scaled = values / np.abs(values).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def read_vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """Rows (row, id, key, v): v the float64 unit vector, key a digest of the values; both NULL where nothing can be linked."""
    kind = df.schema[id_column].dataType.simpleString()

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << (BLOCK_BITS + ROW_BITS)
        for batch in batches:
            vectors = batch.column("v")
            n, missing = _lists(vectors)[0], vectors.is_null().to_numpy(zero_copy_only=False)
            values = vectors.flatten()
            absent = values.is_null().to_numpy(zero_copy_only=False)
            values = values.fill_null(0).to_numpy() + 0.0
            n = np.where(missing, 0, n)
            doubtful = np.concatenate([[0], np.cumsum(absent | ~np.isfinite(values))])
            filled = np.concatenate([[0], np.cumsum(values != 0)])
            edge = np.concatenate([[0], np.cumsum(n)])
            good = (doubtful[edge[1:]] == doubtful[edge[:-1]]) & (filled[edge[1:]] > filled[edge[:-1]])
            keys, bodies = [], []
            for i in range(batch.num_rows):
                own = values[edge[i] : edge[i + 1]]
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if good[i] else None)
                bodies.append(_units(own[None]).tobytes() if good[i] else None)
            rows = pa.array(number + np.arange(batch.num_rows))
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, batch.column("id"), pa.array(keys, pa.binary()), pa.array(bodies, pa.binary())], ["row", "id", "key", "v"])

    path = scratch_path(df.sparkSession, "vectors")
    vectors = df.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    vectors.mapInArrow(read, f"row long, id {kind}, key binary, v binary").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def distinct_nodes(rows: DataFrame) -> DataFrame:
    """Rows (node, key, n, least, v): one for each different vector, with its number of rows and smallest id."""
    each = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.first("v").alias("v"))
    numbered = cut_lineage(each)
    return cut_lineage(numbered.select(F.monotonically_increasing_id().alias("node"), "key", "n", "least", "v"))


def merged(table: pa.Table, limit: float) -> pa.RecordBatch:
    """One row for each node of GRAPH rows: its nearest K, or all links up to K_MAX (beyond, K_MAX of them by chance)."""
    rows = table.combine_chunks().to_batches()[0]
    node = rows.column("node").to_numpy()
    n, near = _lists(rows.column("near"))
    sim, fresh = _lists(rows.column("sim"))[1], _lists(rows.column("fresh"))[1]
    own = np.repeat(node, n)
    order = np.lexsort((fresh, near, own))  # of the same neighbour the entry that is known already
    own, near, sim, fresh = own[order], near[order], sim[order], fresh[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (near[1:] != near[:-1])
    own, near, sim, fresh = own[new], near[new], sim[new], fresh[new]
    linked = sim >= limit
    order = np.lexsort((-np.where(linked, 2 + _chance(own, near), sim), own))
    own, near, sim, fresh, linked = own[order], near[order], sim[order], fresh[order], linked[order]
    nodes = np.unique(node)
    rank = np.arange(len(own)) - np.searchsorted(own, own)
    kept = (rank < K) | linked & (rank < K_MAX)
    own = own[kept]
    lengths = np.searchsorted(own, nodes, side="right") - np.searchsorted(own, nodes)
    has = np.flatnonzero(rows.column("x").is_valid().to_numpy(zero_copy_only=False))
    place = np.full(len(nodes), -1)
    place[np.searchsorted(nodes, node[has])] = has
    x = rows.column("x").take(pa.array(place, mask=place < 0))
    values = ((near[kept], pa.int64()), (sim[kept], pa.float32()), (fresh[kept], pa.bool_()))
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes), x, *(_list_array(lengths, v, kind) for v, kind in values)], ["node", "x", "near", "sim", "fresh"]
    )


def merge_lists(parts: DataFrame, limit: float) -> DataFrame:
    """GRAPH rows with one row a node; a node's rows pass one task, never more than a batch of them at once."""

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            out = merged(table, limit)
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
            held = pa.Table.from_batches([out.slice(out.num_rows - 1)])
        if held is not None:
            yield from held.to_batches()

    path = scratch_path(parts.sparkSession, "graph")
    parts.repartition("node").sortWithinPartitions("node").mapInArrow(merge, GRAPH).write.parquet(path)
    return parts.sparkSession.read.parquet(path)


def _candidates(node: np.ndarray, near: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    """GRAPH rows without vectors for pairs; equal pairs once."""
    order = np.lexsort((near, node))
    node, near, sim = node[order], near[order], sim[order]
    new = np.ones(len(node), dtype=bool)
    new[1:] = (node[1:] != node[:-1]) | (near[1:] != near[:-1])
    node, near, sim = node[new], near[new], sim[new]
    nodes, lengths = np.unique(node, return_counts=True)
    lists = [_list_array(lengths, near, pa.int64()), _list_array(lengths, sim, pa.float32()), _list_array(lengths, np.ones(len(near), bool), pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(nodes), pa.nulls(len(nodes), pa.binary()), *lists], ["node", "x", "near", "sim", "fresh"])


def first_neighbours(nodes: DataFrame, limit: float, seed: int) -> DataFrame:
    """GRAPH rows without vectors: each node's nearest in windows of TREES orders by signs of projections."""

    def codes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, v in _by_dim(batch.column("v"), np.float64):
                planes = np.random.default_rng((seed, v.shape[1])).standard_normal((v.shape[1], TREES * CODE_BITS))
                bits = ((v @ planes) > 0).reshape(len(v), TREES, CODE_BITS).astype(np.int64)
                code = (bits << np.arange(CODE_BITS - 1, -1, -1)).sum(axis=2)
                x = pa.array([r.tobytes() for r in v.astype(np.float16)], pa.binary())
                for tree in range(TREES):
                    key = pa.array(np.full(len(v), tree * (1 << 32) + v.shape[1]))
                    yield pa.RecordBatch.from_arrays([key, pa.array(code[:, tree]), batch.column("node").take(pa.array(own)), x], ["tree", "code", "node", "x"])

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, node = batch.column("tree").to_numpy(), batch.column("node").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(tree)) + 1, [len(tree)]])
            for start, end in zip(edges, edges[1:]):
                at = np.append(np.arange(start, end, WINDOW), end)
                if len(at) > 2 and end - at[-2] < WINDOW // 4:
                    at = np.delete(at, -2)  # a short rest goes with the window before
                for low, high in zip(at, at[1:]):
                    own, m = node[low:high], high - low
                    x = np.frombuffer(b"".join(batch.column("x").slice(low, m).to_pylist()), np.float16).reshape(m, -1).astype(np.float32)
                    sim = x @ x.T
                    linked = sim >= limit
                    worth = np.where(linked, 2 + _chance(*np.broadcast_arrays(own[:, None], own)), sim)
                    np.fill_diagonal(worth, -9)
                    top = min(K_MAX, m - 1)
                    if not top:
                        continue
                    best = np.argpartition(-worth, top - 1, axis=1)[:, :top]
                    value = np.take_along_axis(worth, best, 1)
                    best = np.take_along_axis(best, np.argsort(-value, axis=1), 1)
                    kept = (np.arange(top) < K) | np.take_along_axis(linked, best, 1)
                    i, j = np.nonzero(kept)
                    yield _candidates(own[i], own[best[i, j]], sim[i, best[i, j]])

    coded = cut_lineage(nodes.select("node", "v").mapInArrow(codes, "tree long, code long, node long, x binary"))
    return coded.repartitionByRange("tree", "code").sortWithinPartitions("tree", "code").mapInArrow(windows, GRAPH)


def _sent(node: np.ndarray, n: np.ndarray, near: np.ndarray, fresh: np.ndarray, turn: int) -> np.ndarray:
    """Which entries of the lists are sent in this round: SENT_NEW fresh ones and SENT_OLD others of each."""
    own = np.repeat(node, n)
    order = np.lexsort((_chance(own, near, turn), fresh, own))
    group = own[order] * 2 + fresh[order]
    rank = np.arange(len(own)) - np.searchsorted(group, group)
    out = np.zeros(len(own), dtype=bool)
    out[order] = rank < np.where(fresh[order], SENT_NEW, SENT_OLD)
    return out


def one_round(graph: DataFrame, limit: float, turn: int) -> DataFrame:
    """GRAPH after neighbours of neighbours have met; ``fresh`` marks entries that have not been sent yet."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            n, near = _lists(batch.column("near"))
            sim, fresh = _lists(batch.column("sim"))[1], _lists(batch.column("fresh"))[1]
            row = np.repeat(np.arange(len(node)), n)
            links = np.bincount(row, sim >= limit, minlength=len(node))
            last = np.full(len(node), 2.0)
            np.minimum.at(last, row, sim)
            # What an entry needs to get into the list.
            reach = np.where(links >= K_MAX, 2.0, np.where(links >= K, limit, np.where(n >= K, last, -2.0)))
            chosen = _sent(node, n, near, fresh, turn)
            to = np.concatenate([near[chosen], node])
            by = np.concatenate([row[chosen], np.arange(len(node))])
            old = np.concatenate([~fresh[chosen], np.zeros(len(node), bool)])
            arrays = [pa.array(to), batch.column("node").take(pa.array(by)), batch.column("x").take(pa.array(by))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(reach[by].astype(np.float32)), pa.array(old)], ["to", "node", "x", "reach", "old"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _by_dim(batch.column("x"), np.float16):
                x = x.astype(np.float32)
                to, node = batch.column("to").to_numpy()[rows], batch.column("node").to_numpy()[rows]
                reach, old = batch.column("reach").to_numpy()[rows], batch.column("old").to_numpy(zero_copy_only=False)[rows]
                start = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                place = np.arange(len(to)) - np.repeat(start, np.diff(np.append(start, len(to))))
                meeting = np.cumsum(place % MEETING == 0)  # a node that many point at holds several meetings
                found = []
                for step in range(1, MEETING):
                    i = np.flatnonzero(meeting[step:] == meeting[:-step])
                    if not len(i):
                        break
                    i = i[~(old[i] & old[i + step]) & (node[i] != node[i + step])]
                    sim = np.einsum("ij,ij->i", x[i], x[i + step])
                    for a, b in ((i, i + step), (i + step, i)):
                        near = sim > reach[a]
                        found.append((node[a[near]], node[b[near]], sim[near]))
                if any(len(f[0]) for f in found):
                    yield _candidates(*(np.concatenate(f) for f in zip(*found)))

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, near = _lists(batch.column("near"))
            fresh = _lists(batch.column("fresh"))[1]
            fresh = fresh & ~_sent(batch.column("node").to_numpy(), n, near, fresh, turn)
            place = batch.schema.get_field_index("fresh")
            yield batch.set_column(place, "fresh", _list_array(n, fresh, pa.bool_()))

    sent = graph.mapInArrow(send, "to long, node long, x binary, reach float, old boolean")
    found = sent.repartition("to").sortWithinPartitions("to").mapInArrow(meet, GRAPH)
    return merge_lists(graph.mapInArrow(settle, GRAPH).unionByName(found), limit)


def audit(nodes: DataFrame, threshold: float, sample: int = AUDITED) -> DataFrame:
    """Rows (node, links): for a sample of nodes the number of nodes linked with them, by comparison with all."""
    chosen = nodes.select("node", "v").orderBy(F.xxhash64("node"), "node").limit(sample).toArrow().combine_chunks()
    shared = nodes.sparkSession.sparkContext.broadcast(
        {m.shape[1]: (chosen.column("node").to_numpy()[own], m) for own, m in _by_dim_whole(chosen.column("v"))} if chosen.num_rows else {}
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            node = batch.column("node").to_numpy()
            for own, v in _by_dim(batch.column("v"), np.float64):
                if v.shape[1] in shared.value:
                    ids, m = shared.value[v.shape[1]]
                    for at in range(0, len(v), 1024):
                        near = (v[at : at + 1024] @ m.T >= threshold) & (node[own[at : at + 1024], None] != ids)
                        sums[v.shape[1]] = sums.get(v.shape[1], 0) + near.sum(axis=0)
        for dim, links in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(shared.value[dim][0]), pa.array(links.astype(np.int64))], ["node", "links"])

    found = nodes.select("node", "v").mapInArrow(compare, "node long, links long")
    return cut_lineage(found.groupBy("node").agg(F.sum("links").alias("links")))


def _by_dim_whole(column: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    bodies = column.to_pylist()
    width = np.array([len(b) for b in bodies])
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        yield own, np.frombuffer(b"".join([bodies[i] for i in own]), np.float64).reshape(len(own), -1)


def neighbour_graph(nodes: DataFrame, threshold: float, recall: float = RECALL, rounds: int = MAX_ROUNDS) -> DataFrame:
    """GRAPH of ``nodes`` (node, v), refined until few new links appear and the audit is content."""
    limit = threshold - SLACK
    truth = audit(nodes, threshold)

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, v in _by_dim(batch.column("v"), np.float64):
                none = np.zeros(len(own), np.int64)
                lists = [_list_array(none, np.zeros(0), kind) for kind in (pa.int64(), pa.float32(), pa.bool_())]
                x = pa.array([r.tobytes() for r in v.astype(np.float16)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(own)), x, *lists], ["node", "x", "near", "sim", "fresh"])

    graph = merge_lists(nodes.select("node", "v").mapInArrow(vectors, GRAPH).unionByName(first_neighbours(nodes, limit, 0)), limit)
    held = 0
    for turn in range(1, rounds + 1):
        graph = one_round(graph, limit, turn)
        state = graph.select("node", F.size(F.filter("sim", lambda s: s >= limit)).alias("held"))
        before, held = held, state.agg(F.sum("held")).first()[0] or 0
        if held - before > FEW_NEW * held:
            continue
        seen = state.join(F.broadcast(truth), "node").agg(
            F.sum(F.least("held", F.lit(K_MAX), "links")).alias("held"), F.sum(F.least("links", F.lit(K_MAX))).alias("links")
        ).first()
        if (seen["held"] or 0) >= recall * (seen["links"] or 0):
            return graph
        graph = merge_lists(graph.unionByName(first_neighbours(nodes, limit, turn)), limit)
    warnings.warn(f"the audit still asks for links after {rounds} rounds", stacklevel=2)
    return graph


def threshold_edges(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Rows (u, v), u < v: pairs in the lists whose cosine is ``threshold`` or more."""
    entry = graph.select("node", F.explode(F.filter(F.arrays_zip("near", "sim"), lambda e: e["sim"] >= threshold - SLACK)).alias("e"))
    pairs = entry.groupBy(F.least("node", "e.near").alias("u"), F.greatest("node", "e.near").alias("v")).agg(F.max("e.sim").alias("sim"))
    pairs = cut_lineage(pairs)
    sure = pairs.where(F.col("sim") >= threshold + SLACK).select("u", "v")
    close = pairs.where(F.col("sim") < threshold + SLACK).select("u", "v")
    if close.isEmpty():
        return sure

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("one").to_pylist(), batch.column("two").to_pylist())
            cosine = np.array([np.frombuffer(a, np.float64) @ np.frombuffer(b, np.float64) for a, b in both])
            yield batch.select(["u", "v"]).filter(pa.array(cosine >= threshold))

    ends = close.join(nodes.select(F.col("node").alias("u"), F.col("v").alias("one")), "u")
    ends = ends.join(nodes.select(F.col("node").alias("v"), F.col("v").alias("two")), "v")
    return sure.unionByName(ends.select("u", "v", "one", "two").mapInArrow(check, "u long, v long"))


def dense_links(members: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, links): for the ``full`` ones of ``members`` (root, node, n, full, v) the rows of other nodes of
    their root linked with them."""
    angle = math.acos(threshold)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root = batch.column("root").to_numpy()
            for own, v in _by_dim(batch.column("v"), np.float64):
                roots, back = np.unique(root[own], return_inverse=True)
                total = np.zeros((len(roots), v.shape[1]))
                np.add.at(total, back, v)
                yield pa.RecordBatch.from_arrays([pa.array(roots), pa.array([t.tobytes() for t in total], pa.binary())], ["root", "mean"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), np.float64) for b in table.column("mean"))
        return pa.table({"root": table.column("root").slice(0, 1), "mean": pa.array([total.tobytes()], pa.binary())})

    part = members.select("root", "v").mapInArrow(sums, "root long, mean binary")
    # Partial sums of one root are added in up to 64 tasks before they meet.
    part = part.groupBy("root", F.spark_partition_id() % 64).applyInArrow(add, "root long, mean binary")
    mean = cut_lineage(part.groupBy("root").applyInArrow(add, "root long, mean binary"))

    def placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inner = np.zeros(batch.num_rows, dtype=bool)
            middle = batch.column("mean")
            for own, v in _by_dim(batch.column("v"), np.float64):
                m = np.frombuffer(b"".join(middle.take(pa.array(own)).to_pylist()), np.float64).reshape(len(own), -1)
                cosine = (v * m).sum(axis=1) / np.maximum(np.sqrt((m * m).sum(axis=1)), 1e-300)
                inner[own] = cosine >= math.cos(angle / 2) + 1e-12
            out = batch.select(["root", "node", "n", "full", "v"])
            yield out.append_column("inner", pa.array(inner))

    joined = join_unique(members, mean, "root", hot_keys(members, "root"), ["node"])
    each = cut_lineage(joined.select("root", "node", "n", "full", "v", "mean").mapInArrow(placed, "root long, node long, n long, full boolean, v binary, inner boolean"))
    # Inner members are linked with all inner ones; the others are compared: those asked with all, inner ones with the outer.
    count = lambda what: F.sum(F.when(what, F.col("n")).otherwise(0))
    size = each.groupBy("root").agg(
        count(F.col("inner")).alias("inside"),
        F.count_if(~F.col("inner")).alias("outer"),
        F.count_if(F.col("full") & F.col("inner")).alias("ask_inner"),
        F.count_if(F.col("full") & ~F.col("inner")).alias("ask_outer"),
        F.count("*").alias("all"),
    )
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    size = cut_lineage(size.select("root", "inside", *(blocks(c).alias(c) for c in ("outer", "ask_inner", "ask_outer", "all"))))
    rows = cut_lineage(join_unique(each, size, "root", hot_keys(each, "root"), ["node"]))
    known = rows.where("full").select("node", F.when(F.col("inner"), F.col("inside") - F.col("n")).otherwise(0).alias("links"))
    compared = rows.where("outer > 0")

    def dealt(of: DataFrame, asks: bool, job: int, own: str, other: str) -> DataFrame:
        """Rows of one side of a comparison, in a block of their own and once for each block of the other side."""
        mine = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
        copy = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        placed = of.where((F.col(own) > 0) & (F.col(other) > 0)).select("root", "node", "n", "v", mine.alias("mine"), copy.alias("theirs"))
        ask, told = ("mine", "theirs") if asks else ("theirs", "mine")
        return placed.select("root", F.lit(job).alias("job"), F.col(ask).alias("p"), F.col(told).alias("q"), "node", "n", "v", F.lit(asks).alias("asks"))

    parts = [
        dealt(compared.where("full AND inner"), True, 0, "ask_inner", "outer"),
        dealt(compared.where("NOT inner"), False, 0, "outer", "ask_inner"),
        dealt(compared.where("full AND NOT inner"), True, 1, "ask_outer", "all"),
        dealt(compared, False, 1, "all", "ask_outer"),
    ]

    def count_block(table: pa.Table) -> pa.Table:
        rows = table.combine_chunks().to_batches()[0]
        v = np.frombuffer(b"".join(rows.column("v").to_pylist()), np.float64).reshape(rows.num_rows, -1)
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        near = (v[asks] @ v[~asks].T >= threshold) & (node[asks][:, None] != node[~asks])
        return pa.table({"node": node[asks], "links": near @ n[~asks]})

    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)
    found = met.groupBy("root", "job", "p", "q").applyInArrow(count_block, "node long, links long")
    return known.unionByName(found).groupBy("node").agg(F.sum("links").alias("links"))


def near_duplicates(
    df: DataFrame, threshold: float = 0.9, id_column: str = "vec_id", vector_column: str = "embedding", recall: float = RECALL
) -> DataFrame:
    """Columns ``id_column``, n_links, component_id, kept: one row per row of ``df``.

    Two rows are linked when the cosine of their vectors is ``threshold`` or more (between 0 and 1); every link
    counted is one, but the graph search may miss some (``recall`` is what the audit asks of the lists). Equal
    vectors are always linked. NULL vectors, zero ones, and those with a NULL, NaN or infinite component are linked
    with nothing, nor are vectors of different lengths. component_id is the smallest id reachable (NULL ids do not
    count unless there are no others); kept: whether the row has that id, so rows that repeat it are all kept.
    Other columns are ignored; no rows give no rows.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    rows = read_vectors(df, id_column, vector_column)
    nodes = distinct_nodes(rows)
    graph = neighbour_graph(nodes, threshold, recall)
    edges = cut_lineage(threshold_edges(graph, nodes, threshold))
    held = F.size(F.filter("sim", lambda s: s >= threshold - SLACK))
    full = graph.where(held >= K_MAX).select("node")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    plain = nodes.select(F.col("node").alias("v"), "n")
    listed = both.join(plain, "v").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    roots = cut_lineage(components(edges))
    links = listed
    full = cut_lineage(full.join(roots, "node"))
    if not full.isEmpty():
        dense = roots.join(full.select("root").distinct(), "root", "left_semi")
        members = dense.join(nodes.select("node", "n", "v"), "node").join(full.select("node", F.lit(True).alias("full")), "node", "left")
        members = cut_lineage(members.select("root", "node", "n", F.coalesce("full", F.lit(False)).alias("full"), "v"))
        counted = dense_links(members, threshold)
        links = listed.join(counted.withColumnRenamed("links", "counted"), "node", "full").select(
            "node", F.coalesce("counted", "links").alias("links")
        )
    placed = cut_lineage(roots.join(nodes.select("node", "least"), "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    placed = join_unique(placed, least, "root", hot_keys(placed, "root"), ["node"]).select("node", "component")
    facts = nodes.select("node", "key", "n", "least").join(links, "node", "left").join(placed, "node", "left")
    facts = cut_lineage(
        facts.select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    )
    own = rows.select("row", "id", "key")
    found = join_unique(own, facts, "key", hot_keys(own, "key"), ["row"], "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
