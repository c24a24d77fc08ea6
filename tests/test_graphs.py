"""Components, assignment and clustering against small brute force."""

from itertools import permutations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from emberscan.operators import assignment
from emberscan.operators import cluster as cl
from emberscan.operators import coincidence as co
from emberscan.operators.assignment import assign_one_to_one
from emberscan.operators.components import component_labels
from tests_support import labels_of


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = np.random.default_rng(1)
    n = 300
    edges = {"random": rng.integers(0, n, (220, 2)).tolist(), "path": [[i + 1, i] for i in range(n - 1)],
             "star": [[n - 1, i] for i in range(n - 1)], "none": []}[shape]
    df = spark.createDataFrame(pd.DataFrame(edges, columns=["src", "dst"], dtype="int64") if edges else
                               pd.DataFrame({"src": pd.Series(dtype="int64"), "dst": pd.Series(dtype="int64")}), "src long, dst long")
    got = component_labels(df).toPandas().set_index("vertex").component
    want = labels_of(n, edges)
    on_edge = {v for a, b in edges if a != b for v in (a, b)}
    assert set(got.index) == on_edge and all(got[v] == want[v] for v in on_edge)


def test_hubs_take_the_broadcast_way(spark, monkeypatch):
    from emberscan.operators import components
    monkeypatch.setattr(components, "HUB_ROWS", 20)
    rng = np.random.default_rng(3)
    n = 400
    edges = [[0, i] for i in range(1, 200)] + [[i, 399] for i in range(200, 399)] + rng.integers(200, n, (50, 2)).tolist()
    df = spark.createDataFrame(pd.DataFrame(edges, columns=["src", "dst"]))
    got = component_labels(df).toPandas().set_index("vertex").component
    want = labels_of(n, edges)
    assert all(got[v] == want[v] for v in got.index) and len(got) == n


def test_dense_graphs_are_contracted_before_they_are_written(spark, monkeypatch):
    from emberscan.operators import components
    written, cut = [], components.cut_lineage

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out
    monkeypatch.setattr(components, "cut_lineage", counted)
    n = 400
    a = spark.range(n).withColumnRenamed("id", "src")
    edges = a.crossJoin(spark.range(n).withColumnRenamed("id", "dst")).where("src % 2 = dst % 2").repartition(3)
    got = components.component_labels(edges).toPandas().set_index("vertex").component
    assert len(got) == n and all(got[v] == v % 2 for v in range(n))
    assert written[0] <= 3 * n


def test_links_are_handed_on_when_they_no_longer_fit(monkeypatch):
    import pyarrow as pa

    from emberscan.operators import components
    monkeypatch.setattr(components, "FOREST_EDGES", 50)
    monkeypatch.setattr(components, "FOREST_LINKS", 120)
    rng = np.random.default_rng(8)
    edges = rng.integers(0, 400, (900, 2))
    batches = [pa.RecordBatch.from_arrays([pa.array(part[:, 0]), pa.array(part[:, 1])], ["u", "v"]) for part in np.array_split(edges, 30)]
    links = [pair for batch in components._spanned(iter(batches)) for pair in zip(*(c.to_pylist() for c in batch.columns))]
    assert labels_of(400, links) == labels_of(400, edges.tolist()) and all(u > v for u, v in links)


def best_by_force(edges):
    left, right = sorted({e[0] for e in edges}), sorted({e[1] for e in edges})
    cost = {(a, b): c for a, b, c in edges}
    slots = [*right, *([None] * len(left))]
    best = (1, 0.0)
    for choice in set(permutations(slots, len(left))):
        used = [(a, b) for a, b in zip(left, choice) if b is not None]
        if all(p in cost for p in used):
            best = min(best, (-len(used), sum(cost[p] for p in used)))
    return -best[0], best[1]


@pytest.mark.parametrize("local_edges", [5000, 0])
def test_assignment_is_largest_then_cheapest(spark, local_edges):
    rng = np.random.default_rng(11)
    rows, want = [], {}
    for g in range(3 if local_edges == 0 else 12):
        n = 4
        edges = [(g * 100 + a, g * 100 + b, float(np.round(rng.uniform(0, 5), 3))) for a in range(n) for b in range(n) if rng.random() < 0.6]
        if edges:
            rows += [(g, *e) for e in edges]
            want[g] = best_by_force(edges)
    df = spark.createDataFrame(rows, "g long, l long, r long, c double")
    got = assign_one_to_one(df, ["g"], "l", "r", "c", local_edges=local_edges).toPandas()
    assert not got.duplicated(["g", "l"]).any() and not got.duplicated(["g", "r"]).any()
    for g, (count, cost) in want.items():
        mine = got[got.g == g]
        assert len(mine) == count and mine.c.sum() == pytest.approx(cost)


def test_percolation_equals_pairwise_adjacency(spark):
    rng = np.random.default_rng(2)
    n = 250
    level = rng.integers(0, 5, n)
    lo = np.round(rng.uniform(0, 60, n), 3)
    t = pd.DataFrame(dict(tile_id=np.arange(n), t_lo=lo, t_hi=lo + 2.0 ** -level, f_lo=2.0 ** level, f_hi=2.0 ** (level + 1.0)))
    t.loc[level == 0, "f_lo"] = 0.0
    got = cl.percolate(spark.createDataFrame(t), 0.2, "tile_id").toPandas().sort_values("tile_id").cluster_id.to_list()
    a = lambda c: t[c].to_numpy()
    touch = ((a("t_lo")[:, None] <= a("t_hi")[None] + 0.2) & (a("t_lo")[None] <= a("t_hi")[:, None] + 0.2)
             & (a("f_lo")[:, None] <= a("f_hi")[None]) & (a("f_lo")[None] <= a("f_hi")[:, None]))
    assert got == labels_of(n, zip(*np.nonzero(touch)))


def points(n=400, seed=4):
    rng = np.random.default_rng(seed)
    blob = rng.normal([[0, 0]] * (n // 3), 0.25)
    line = np.column_stack([np.linspace(2, 12, n // 3), rng.normal(0, 0.1, n // 3)])
    rest = rng.uniform(-10, 25, (n - 2 * (n // 3), 2))
    xy = np.vstack([blob, line, rest])
    return pd.DataFrame(dict(id=np.arange(n), ifo="A", x=xy[:, 0], y=xy[:, 1]))


@pytest.mark.parametrize("min_samples", [2, 5])
def test_dbscan(spark, min_samples):
    p = points()
    got = cl.dbscan(spark.createDataFrame(p), [F.col("x"), F.col("y")], "id", min_samples).toPandas().sort_values("id")
    d = (p.x.to_numpy()[:, None] - p.x.to_numpy()[None]) ** 2 + (p.y.to_numpy()[:, None] - p.y.to_numpy()[None]) ** 2 <= 1.0
    core = d.sum(1) >= min_samples
    lab = labels_of(len(p), [(i, j) for i, j in zip(*np.nonzero(d)) if core[i] and core[j]])
    want = [lab[i] if core[i] else min([lab[j] for j in np.flatnonzero(d[i]) if core[j]], default=-1) for i in range(len(p))]
    assert got.is_core.to_list() == core.tolist() and got.cluster_id.to_list() == want


def test_greedy_follows_the_sequential_rule(spark):
    rng = np.random.default_rng(8)
    t = pd.DataFrame(dict(id=np.arange(500), ifo=rng.choice(["A", "B"], 500), gps=np.round(rng.uniform(0, 900, 500), 4), f=rng.uniform(0, 100, 500)))
    got = cl.greedy(spark.createDataFrame(t), "gps", "f", "id", 3.0, 15.0, min_samples=2).toPandas().set_index("id").cluster_id
    for _, d in t.groupby("ifo"):
        groups = []
        for i, when, f in d.sort_values("gps")[["id", "gps", "f"]].itertuples(index=False):
            for g in groups:
                if abs(when - g[0]) <= 3.0 and abs(f - g[1]) <= 15.0:
                    g[0], g[1] = when, f
                    g[2].append(i)
                    break
            else:
                groups.append([when, f, [i]])
        for *_, members in groups:
            want = members[0] if len(members) >= 2 else -1
            assert all(got[m] == want for m in members)


@pytest.mark.parametrize("n", [2, 3, 4])
def test_ties_go_to_the_same_pairs_at_every_size(spark, n):
    rng = np.random.default_rng(n)
    rows = [(g, i, j, float(rng.integers(1, 3)) if g else 1.0) for g in range(3) for i in range(n) for j in range(n + 1) if g < 2 or rng.random() < 0.7]
    df = spark.createDataFrame(rows, "g long, l long, r long, c double")
    chosen = [sorted(map(tuple, assign_one_to_one(df, ["g"], "l", "r", "c", local_edges=k).select("g", "l", "r").collect())) for k in (0, 3, 5000)]
    assert chosen[0] == chosen[1] == chosen[2]


@pytest.mark.parametrize("n,reach,block,most", [(40, 1.5, 60, 4000), (7, 1.2, 9, 9)])
def test_blocks_of_an_axis_choose_the_pairs_of_the_whole(spark, monkeypatch, n, reach, block, most):
    rng = np.random.default_rng(n)
    # More left ends than right ones to the left, the other way round elsewhere; costs tie; a pair comes twice, an end is NULL.
    x, y = np.r_[np.linspace(0, n / 8, n // 2), np.linspace(n / 8, n / 2, n - n // 2)], np.linspace(0, n / 2, n)
    rows = [(1, i, j, float(x[i]), float(y[j]), float(rng.integers(0, 4))) for i in range(n) for j in range(n) if abs(x[i] - y[j]) <= reach]
    rows += [(*rows[0][:5], 9.0), (1, None, 1, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g long, l long, r long, x double, y double, c double")
    want = sorted(map(tuple, assign_one_to_one(df, ["g"], "l", "r", "c", local_edges=10**6).collect()))
    left_over, augment = [], assignment._augment_on_cluster

    def counted(*given):
        left_over.append(given[-1].count())
        return augment(*given)
    monkeypatch.setattr(assignment, "LEAST_EDGES", 1)
    monkeypatch.setattr(assignment, "_augment_on_cluster", counted)
    got = assign_one_to_one(df, ["g"], "l", "r", "c", places=("x", "y"), block_edges=block, most_edges=most)
    assert sorted(map(tuple, got.collect())) == want
    # Only what no block can tell is left to the joins.
    assert sum(left_over) == 0 if most > len(rows) else 0 < sum(left_over) < n


def test_a_dense_lump_of_events_is_paired_without_a_join_per_pair(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("one phase of joins a pair")
    monkeypatch.setattr(assignment, "_augment_on_cluster", refuse)
    rng = np.random.default_rng(3)
    side = lambda first, n: spark.createDataFrame(
        [(first + k, t, t - 5.0, 10.0, 0.5, 10.0, 20.0, 30.0, 5.0) for k, t in enumerate(map(float, rng.uniform(0, 8, n)))],
        "id long, gpsPeak double, gpsStart double, duration double, tSpread double, freqMin double, freqMean double, freqMax double, EnWDF double")
    found = co.one_to_one_candidates(side(0, 90), side(1000, 75), co.CoincidenceConfig(light_travel_time_s=4.0)).toPandas()
    assert len(found) == found.id_a.nunique() == found.id_b.nunique() == 75


def test_density_clusters_write_no_pairs_of_boxes(spark, monkeypatch):
    rng = np.random.default_rng(11)
    # A dense lump, two strands that touch at points only, and strays.
    x = np.vstack([rng.random((300, 3)) * 2.5, np.c_[10 + 0.45 * np.arange(40), np.zeros((40, 2))],
                   np.c_[10 + 0.45 * np.arange(40), np.full(40, 1.02), np.zeros(40)], 40 + 30 * rng.random((30, 3))])
    near = ((x[:, None] - x[None]) ** 2).sum(axis=2) <= 1.0
    core = near.sum(axis=1) >= 3
    root = labels_of(len(x), [(a, b) for a, b in np.argwhere(near) if core[a] and core[b]])
    want = [root[k] if core[k] else min((root[j] for j in np.flatnonzero(near[k] & core)), default=-1) for k in range(len(x))]
    written, write = [], cl.cut_lineage

    def counted(df):
        out = write(df)
        written.append(out.count())
        return out
    monkeypatch.setattr(cl, "cut_lineage", counted)
    points = spark.createDataFrame([(k, "a", *map(float, p)) for k, p in enumerate(x)], "id long, ifo string, x double, y double, z double")
    got = {r.id: (r.cluster_id, r.is_core) for r in cl.dbscan(points, [F.col(c) for c in "xyz"], "id", 3).collect()}
    assert [got[k] for k in range(len(x))] == [(w, bool(c)) for w, c in zip(want, core)]
    assert max(written) <= len(x)
