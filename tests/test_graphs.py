import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmere.functions.frames import frame_of
from quillmere.operators import distances, graphs
from quillmere.operators.spectral import constant_axis, spectral_embedding

RNG = np.random.default_rng(11)


def frame(spark, x):
    return frame_of(spark, np.arange(len(x)), np.asarray(x, float))


def line(spark, *x):
    return frame(spark, np.array(x, float)[:, None])


def edges(df):
    return sorted((r.a, r.b, round(r.weight, 9)) for r in df.collect())


def near(df, i):
    return [r.neighbour for r in df.where(F.col("id") == i).orderBy("rank").collect()]


@pytest.mark.parametrize("find", [distances.nearest, distances.nearest_sql])
def test_order_and_ties(spark, find):
    n = find(line(spark, 0, 10, 1, 3, 6), 3)
    assert near(n, 0) == [2, 3, 4] and near(n, 1) == [4, 3, 2]
    cross = find(frame(spark, [[0, 0], [1, 0], [0, 1], [-1, 0]]), 2)
    assert near(cross, 0) == [1, 2]
    for bad in (0, 5):
        with pytest.raises(ValueError):
            find(line(spark, 0, 10, 1, 3, 6), bad)


def test_blocks_give_the_same_rows(spark):
    f = frame(spark, RNG.normal(0, 1, (90, 3)).round(1))
    one = {tuple(r) for r in distances.nearest(f, 4).collect()}
    assert one == {tuple(r) for r in distances.nearest(f, 4, block_cells=60).collect()} == {tuple(r) for r in distances.nearest_sql(f, 4).collect()}


def test_neighbour_graph(spark):
    x = np.concatenate([RNG.normal(c, 1.1, (30, 3)) for c in (0, 8, 16)])
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    a = np.zeros((90, 90))
    for i in range(90):
        a[i, np.argsort(d[i], kind="stable")[:6]] = 1
    w = (a + a.T) / 2
    expected = [(i, j, w[i, j]) for i in range(90) for j in range(i + 1, 90) if w[i, j]]
    f = frame(spark, x)
    g = graphs.neighbour_graph(f, 6)
    assert edges(g) == expected
    for s in (0.0, 1.0):
        deg = w.sum(1) + s
        e = (w + s * np.eye(90)) / np.sqrt(deg[:, None] * deg[None, :]) @ x
        got = {r.id: r.x for r in graphs.propagate(f.select("id"), g, f, 3, s).collect()}
        np.testing.assert_allclose([got[i] for i in range(90)], e, atol=1e-12)


def test_by_distance_and_blocked(spark):
    f = line(spark, 0, 1, 3, 7)
    assert edges(graphs.neighbour_graph_by_distance(f, 1)) == [(0, 1, 1.0), (1, 2, 2.0), (2, 3, 4.0)]
    assert edges(graphs.neighbour_graph_by_distance(f, 1, 2.0)) == [(0, 1, 1.0), (1, 2, 2.0)]
    assert edges(graphs.neighbour_graph_by_distance(f, 1, blocked=(F.col("a") == 1) & (F.col("b") == 2))) == [(0, 1, 1.0), (2, 3, 4.0)]
    assert edges(graphs.neighbour_graph_by_distance(f, 1, blocked=spark.createDataFrame([(2, 1)], "a long, b long"))) == [(0, 1, 1.0), (2, 3, 4.0)]
    assert edges(graphs.neighbour_graph_by_distance(line(spark, 0, 0, 5), 1)) == [(0, 2, 5.0)]


def test_graph_tools(spark):
    g = graphs.from_edges(spark.createDataFrame([(2, 1, 1.0), (1, 2, 3.0), (3, 4, 0.0), (5, 5, 1.0), (4, 5, 2.0)], "a long, b long, weight double"))
    assert edges(g) == [(1, 2, 3.0), (4, 5, 2.0)]
    nodes = spark.range(7)
    assert {r.id: r.degree for r in graphs.degrees(nodes, g).collect()} == {0: 0, 1: 3, 2: 3, 3: 0, 4: 2, 5: 2, 6: 0}
    for local in (True, False, None):
        assert {r.id: r.component for r in graphs.connected_components(nodes, g, local=local).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6}
    assert graphs.connected_components(nodes, g.limit(0)).where("id <> component").count() == 0
    assert edges(graphs.reweight(g, F.lit(1.0))) == [(1, 2, 1.0), (4, 5, 1.0)]
    assert {r.id: r.neighbours for r in graphs.adjacent(g).collect()} == {1: [2], 2: [1], 4: [5], 5: [4]}


def test_long_chain_and_shortest_paths(spark):
    chain = graphs.from_edges(spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    for local in (True, False):
        assert graphs.connected_components(spark.range(41), chain, local=local).select("component").distinct().count() == 1
    detour = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (3, 4, 1.0)], "a long, b long, weight double")
    paths = graphs.shortest_paths(spark.range(5), detour, [0]).cache()
    assert {r.id: r.cost for r in paths.collect()} == {0: 0.0, 1: 1.0, 2: 2.0, 3: None, 4: None}
    assert graphs.route(paths, 2) == [0, 1, 2] and graphs.route(paths, 4) == []


def test_polygons(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    rows = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0)], "x double, y double")
    assert [r.i for r in rows.orderBy("x").select(graphs.inside_polygon(F.col("x"), F.col("y"), square).alias("i")).collect()] == [True, False]
    rows = [(-1.0, 1.0, 3.0, 1.5, True), (-1.0, 2.0, 3.0, 2.0, False), (3.0, 0.0, 3.0, 5.0, False), (0.0, 0.0, 2.0, 2.0, True), (-1.0, 1.0, 1.0, 3.0, False), (0.5, 0.5, 1.5, 1.0, True), (9.0, 9.5, 11.0, 9.5, True)]
    s = spark.createDataFrame(rows, "a double, b double, c double, d double, e boolean")
    both = graphs.Obstacles([square, [(9.0, 9.0), (10.0, 9.0), (10.0, 10.0), (9.0, 10.0), (9.0, 9.0)]], 1e-9)
    assert s.where(both.blocks(*map(F.col, "abcd")) != F.col("e")).count() == 0
    near = spark.createDataFrame([(1.0, 1.0, True), (0.05, 1.0, False), (0.2, 1.0, True), (2.0, 1.0, False), (9.5, 9.5, True)], "x double, y double, e boolean")
    assert near.where(graphs.Obstacles(both.polygons, 0.1).contains(F.col("x"), F.col("y")) != F.col("e")).count() == 0
    assert spark.range(1).select(graphs.Obstacles([]).blocks(*[F.lit(0.0)] * 4).alias("b")).first().b is False
    for bad in ([(0, 0), (1, 1)], [(0, 0), (0, 0), (1, 1), (1, 1)], [(0, 0), (1, float("nan")), (1, 1)]):
        with pytest.raises(ValueError):
            graphs.Obstacles([bad])


def test_a_way_round_a_wall(spark):
    """A grid of nine by nine with a wall: the way touches the wall's corners."""
    side = 9
    spots = {r * side + c: (float(c), float(r)) for r in range(side) for c in range(side)}
    frame = spark.createDataFrame([(k, list(x)) for k, x in spots.items()], "id long, x array<double>")
    wall = graphs.Obstacles([[(3.5, -1.0), (5.5, -1.0), (5.5, 6.5), (3.5, 6.5)]], 1e-9)
    inside = wall.contains(F.get("x", F.lit(0)), F.get("x", F.lit(1)))
    enclosed = {r.id for r in frame.where(inside).collect()}
    assert len(enclosed) == 14

    def open_ways(edges):
        for end in "ab":
            edges = edges.join(frame.select(F.col("id").alias(end), F.get("x", F.lit(0)).alias(f"{end}x"), F.get("x", F.lit(1)).alias(f"{end}y"), inside.alias(f"{end}in")), end)
        return edges.where(~(F.col("ain") | F.col("bin") | wall.blocks(*map(F.col, ("ax", "ay", "bx", "by"))))).select("a", "b", "weight")

    edges = graphs.neighbour_graph_by_distance(frame, 8, 1.5, open_ways).cache()
    assert not {v for e in edges.collect() for v in (e.a, e.b)} & enclosed
    paths = graphs.shortest_paths(frame.select("id"), edges, [4 * side]).cache()
    assert paths.where(F.col("id") == 4 * side + 8).first().cost == pytest.approx(2 + 6 * 2**0.5, abs=1e-9)
    assert len(graphs.route(paths, 4 * side + 8)) == 9


@pytest.mark.parametrize("local", [True, False])
def test_cliques_with_a_bridge(spark, local):
    pairs = [(i, j, 100.0) for o in (0, 5) for i in range(o, o + 5) for j in range(i + 1, o + 5)] + [(4, 5, 1.0)]
    g = spark.createDataFrame(pairs, "a long, b long, weight double")
    r = spectral_embedding(spark.range(11), g, 2, local=local, tolerance=1e-8)
    assert r.placed.tolist() == [True] * 10 + [False] and r.graph_components == 1 and r.converged
    second = r.coordinates[:10, 1]
    assert np.ptp(second[:4]) < 1e-3 and np.ptp(second[6:]) < 1e-3 and abs(second[0] - second[9]) > 0.01
    total = sum(w for *_, w in pairs) * 2
    np.testing.assert_allclose(np.abs(r.coordinates[:10, 0]), 1 / np.sqrt(total), rtol=1e-6)
    assert (r.coordinates[10] == 0).all() and abs(r.eigenvalues[0]) < 1e-6
    closed = {x.id: x.x for x in constant_axis(spark.range(11), g).collect()}
    assert closed[10] == 0 and abs(closed[0] - 1 / np.sqrt(total)) < 1e-12


def test_nearest_of_hard_values(spark):
    """Ties by the thousand, far offsets, huge and repeated values: the same rows as a plain search."""
    cases = [
        RNG.integers(0, 3, (300, 2)).astype(float),
        RNG.normal(0, 1, (200, 3)) + 1e9,
        RNG.normal(0, 1, (60, 2)) * 1e200,
        np.repeat(RNG.normal(0, 1, (20, 4)), 10, axis=0),
    ]
    for x in cases:
        with np.errstate(over="ignore"):
            d = distances.squared_block(x, x)
        np.fill_diagonal(d, np.inf)
        want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:5] if np.isfinite(d[i, j])}
        for found in (distances.nearest(frame(spark, x), 5), distances.nearest(frame(spark, x), 5, block_cells=x.size // 3)):
            assert {(r.id, r.neighbour) for r in found.collect()} == want


@pytest.mark.parametrize("tile", [4096, 16])
def test_all_pairs(spark, tile):
    x = RNG.normal(0, 1, (90, 3))
    got = {(r.i, r.j): (r.d2, r.d) for r in distances.pairs(frame(spark, x), tile).collect()}
    want = distances.squared_block(x, x)
    assert got == {(i, j): (want[i, j], np.sqrt(want[i, j])) for i in range(90) for j in range(i + 1, 90)}
    assert distances.pairs(frame(spark, x).limit(0)).count() == 0


def test_all_pairs_without_a_shuffle(spark):
    x = np.concatenate([RNG.normal(0, 1, (70, 3))] * 3)
    x[5], x[75] = 0.0, -0.0
    ids = np.concatenate([np.arange(209), [208]])  # the last id twice
    rows = spark.createDataFrame([(int(i), list(map(float, v))) for i, v in zip(ids, x)], "id long, x array<double>")
    want = sorted((int(ids[i]), int(ids[j]), *map(float, (d := distances.squared_block(x[i : i + 1], x[j : j + 1])[0, 0], np.sqrt(d)))) for i in range(210) for j in range(210) if ids[i] < ids[j])
    kept = distances.pairs(rows, 64)
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    for found in (kept, distances.pairs(rows, 64, block_cells=1)):
        assert sorted(map(tuple, found.collect())) == want
    # equal samples stand side by side: rows of their pairs repeat at once
    d = np.array([r.d for r in distances.pairs(rows.where("id < 70 or id between 140 and 207")).collect()])
    assert len(set(d[:134].tolist())) < 75


def test_pairs_of_equal_samples_are_stored_small(spark):
    x = np.concatenate([np.random.default_rng(12).normal(0, 1, (1000, 8))] * 2)
    d = distances.pairs(frame(spark, x)).select("d").toArrow().column("d").to_numpy()
    assert len(d) == 2000 * 1999 // 2
    # pages as Parquet makes them; a distance occurs four times, so that two bytes a row are the least
    pages = [len(pa.compress(d[k : k + 20_000].tobytes(), "snappy", asbytes=True)) for k in range(0, len(d), 20_000)]
    assert sum(pages) < 2.6 * len(d)


def test_blocked_by_a_function(spark):
    f = line(spark, 0, 1, 3, 7)
    assert edges(graphs.neighbour_graph_by_distance(f, 1, blocked=lambda e: e.where("a <> 1 or b <> 2"))) == [(0, 1, 1.0), (2, 3, 4.0)]
