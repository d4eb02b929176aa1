import math

import numpy as np
import pytest
from brute import reach

from prefloom.llm import nn_descent
from prefloom.llm.nn_descent import merged, near_duplicates, neighbour_graph, distinct_nodes, read_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node string, key string, n long, links int"


def _frame(spark, vectors, ids=None, parts=3):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], 1, "a", "b", 2, 3) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def _brute(vectors, ids, threshold=0.9):
    good = []
    for v in vectors:
        fine = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        good.append(np.asarray(np.asarray(v, dtype=np.float32), dtype=float) if fine else None)
    n = len(vectors)
    edges = []
    for i in range(n):
        for j in range(i):
            a, b = good[i], good[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                edges.append((i, j))
    root = reach(edges)
    links = [sum(i in e for e in edges) for i in range(n)]
    out = []
    for i in range(n):
        own = [ids[j] for j in range(n) if root.get(j, j) == root.get(i, i) and ids[j] is not None]
        component = min(own, default=None)
        out.append((ids[i], links[i], component, ids[i] == component))
    return sorted(out, key=repr)


def _clusters(seed, sizes, noise, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        centre = rng.standard_normal(dim)
        out += list(centre + noise * np.linalg.norm(centre) / math.sqrt(dim) * rng.standard_normal((n, dim)))
    return out


def test_odd_vectors(spark):
    v = [1.0, 2.0, 0.5, -1.0]
    vectors = [v, v, [2 * x for x in v], None, [], [0.0] * 4, [1.0, None, 2.0, 3.0], [1.0, math.nan, 0.0, 1.0], [math.inf, 0, 0, 1.0]]
    vectors += [v + [0.0], [-x for x in v], [1e-30 * x for x in v], [3e38, 3e38, 0.0, 0.0], [3e38, 3e38, 1.0, 0.0], [0.0, -0.0, 0.0, 1.0], [0.0, 0.0, 0.0, 1.0], v]
    ids = [5, 5, None, 1, 2, 3, 4, 6, 7, 8, 9, 10, None, None, 12, 11, 4]
    found = near_duplicates(_frame(spark, vectors, ids))
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    rows = sorted([tuple(r) for r in found.collect()], key=repr)
    expected = _brute(vectors, ids)
    # A row with nothing to link is its own component even without an id.
    assert [r[:3] for r in rows] == [r[:3] for r in expected]
    assert all(r[3] == (r[0] == r[2]) for r in rows)


@pytest.mark.parametrize("k, k_max, block, window", [(16, 128, 1024, 512), (3, 6, 5, 16)])
def test_links_and_components_agree_with_brute_force(spark, monkeypatch, k, k_max, block, window):
    for name, value in (("K", k), ("K_MAX", k_max), ("BLOCK", block), ("WINDOW", window)):
        monkeypatch.setattr(nn_descent, name, value)
    vectors = _clusters(1, [60, 9, 4, 2, 2] + [1] * 60, 0.2) + _clusters(2, [40], 0.45)
    vectors += [vectors[3]] * 20 + [vectors[-1]] * 5
    ids = np.random.default_rng(4).permutation(len(vectors)).tolist()
    rows = sorted([tuple(r) for r in near_duplicates(_frame(spark, vectors, ids)).collect()], key=repr)
    expected = _brute(vectors, ids)
    assert len(rows) == len(expected)
    found, true = sum(r[1] for r in rows), sum(r[1] for r in expected)
    assert all(r[1] <= e[1] for r, e in zip(rows, expected)) and found >= 0.97 * true
    if k == 16:
        assert rows == expected


def test_rounds_find_what_the_first_windows_miss(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "WINDOW", 24)
    monkeypatch.setattr(nn_descent, "TREES", 1)
    vectors = _clusters(7, [5] * 120 + [1] * 300, 0.2, 24)
    nodes = distinct_nodes(read_vectors(_frame(spark, vectors), "vec_id", "embedding"))
    first = nn_descent.first_neighbours(nodes, 0.9, 0)
    held = lambda g: sum(s >= 0.9 for r in g.select("sim").collect() for s in r["sim"])
    before, after = held(first), held(neighbour_graph(nodes, 0.9))
    true = sum(n for _, n, _, _ in _brute(vectors, list(range(len(vectors)))))
    assert before < 0.9 * true <= 0.97 * true <= after <= true + 10


def test_text_ids_and_no_rows(spark):
    rows = [("b", [1.0, 0.0]), ("a", [1.0, 0.1]), ("c", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    found = {tuple(r) for r in near_duplicates(df).collect()}
    assert found == {("b", 1, "a", False), ("a", 1, "a", True), ("c", 0, "c", True)}
    assert near_duplicates(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="threshold"):
        near_duplicates(df, 1.0)


def test_merging_in_parts_is_merging_at_once():
    rng = np.random.default_rng(2)
    node, near = np.sort(rng.integers(0, 5, 400)), rng.integers(10, 90, 400)
    sim = np.round(rng.random(90), 3)[near].astype(np.float32)
    rows = nn_descent._candidates(node, near, sim)
    import pyarrow as pa

    whole = merged(pa.Table.from_batches([rows]), 0.9)
    halves = [nn_descent._candidates(node[i::2], near[i::2], sim[i::2]) for i in range(2)]
    parts = merged(pa.Table.from_batches(halves), 0.9)
    assert whole.equals(parts)
    for lists in whole.column("sim").to_pylist():
        linked = sum(s >= 0.9 for s in lists)
        assert len(lists) == max(nn_descent.K, linked)
