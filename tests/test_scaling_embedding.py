import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmere.functions.frames import frame_of
from quillmere.operators import distances, scaling
from quillmere.operators.embedding import AutoMethod, EmbeddingMethod, EmbeddingOutcome, EmbeddingQuery, EmbedOptions, PrincipalComponentsMethod, ScalingMethod, SpectralMethod, embed

RNG = np.random.default_rng(5)


def frame(spark, x):
    return frame_of(spark, np.arange(len(x)), np.asarray(x, float))


def cells(spark, d):
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(np.asarray(d, float))], "i long, j long, d double")


def apart(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


RECTANGLE = apart(np.array([[0.0, 0], [3, 0], [3, 4], [0, 4]]))


def test_rectangle_table(spark):
    r = scaling.from_distances(cells(spark, RECTANGLE))
    np.testing.assert_allclose(apart(r.coordinates), RECTANGLE, atol=1e-8)
    assert r.stress < 1e-8 and not r.notes and abs(r.retained - 1) < 1e-8 and r.distortion.max() < 1e-8


def test_star_is_not_flat(spark):
    d = np.full((5, 5), 2.0)
    d[0, :] = d[:, 0] = 1
    np.fill_diagonal(d, 0)
    r = scaling.from_distances(cells(spark, d))
    assert r.most_negative_eigenvalue < -1e-3 and r.stress > 1e-3 and any("flat" in n.text for n in r.notes)


@pytest.mark.parametrize("local", [True, False])
def test_refinement_never_raises_stress(spark, local):
    x = RNG.uniform(0, 1, (40, 6))
    r = scaling.from_features(frame(spark, x), local=local)
    plain = scaling.from_features(frame(spark, x), scaling.ScalingOptions(refine=False), local=local)
    assert r.stress <= plain.stress == r.classical_stress and math.isnan(r.most_negative_eigenvalue)
    again = scaling.from_features(frame(spark, x * 1000), local=local)
    assert abs(again.stress - r.stress) < 1e-6
    want, got = apart(x), apart(r.coordinates)
    assert abs(r.stress - math.sqrt(((want - got) ** 2).sum() / (want**2).sum())) < 1e-9
    np.testing.assert_allclose(r.distortion, np.sqrt(((want - got) ** 2).sum(1) / (want**2).sum(1)), atol=1e-9)


def test_collinear_and_identical(spark):
    i = np.arange(6.0)
    r = scaling.from_features(frame(spark, np.column_stack([i, 2 * i, -i])))
    assert (r.coordinates[:, 1] == 0).all() and any("no structure" in n.text for n in r.notes)
    assert scaling.from_distances(cells(spark, np.zeros((4, 4)))).most_negative_eigenvalue == 0
    assert any("rotates" in n.text for n in scaling.from_features(frame(spark, RNG.normal(0, 1, (9, 2)))).notes)


def test_refusals(spark):
    for d in ([[0, 1], [2, 0]], [[1, 1], [1, 0]], [[0, -1], [-1, 0]], [[0, math.nan], [math.nan, 0]]):
        with pytest.raises(ValueError):
            scaling.from_distances(cells(spark, d), scaling.ScalingOptions(dimensions=1))
    with pytest.raises(ValueError):
        scaling.from_distances(cells(spark, RECTANGLE).where("i <> 2 or j <> 1"))
    for bad in (dict(dimensions=0), dict(dimensions=4), dict(maximum_iterations=0), dict(tolerance=0)):
        with pytest.raises(ValueError):
            scaling.from_distances(cells(spark, RECTANGLE), scaling.ScalingOptions(**bad))


def ribbon():
    i = np.arange(40.0)
    t = i / 39
    return np.column_stack([10 * t, 4 * t + 0.3 * np.sin(7 * i), 0.1 * np.cos(5 * i)])


def test_embed_by_components(spark):
    x = ribbon()
    r = embed(EmbeddingQuery(frame(spark, x)), PrincipalComponentsMethod())
    z = (x - x.mean(0)) / x.std(0)
    _, _, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    np.testing.assert_allclose(np.abs(r.coordinates), np.abs(z @ vt[:2].T), atol=1e-8)
    lines = r.report(["along", "up", "side"])
    assert any("along" in x for x in lines) and any(x.startswith("Axis 2") for x in lines) and any(x.startswith("Retained") for x in lines)


def test_constant_column_keeps_its_place(spark):
    x = np.insert(ribbon()[:, :2], 1, 7, axis=1)
    r = embed(EmbeddingQuery(frame(spark, x)), PrincipalComponentsMethod())
    assert r.kept_columns == (0, 2) and (r.outcome.axes[:, 1] == 0).all() and "1" in r.notes[0].text
    with pytest.raises(ValueError):
        embed(EmbeddingQuery(frame(spark, np.ones((5, 2)))))


def test_automatic_choice(spark):
    path = spark.range(39).selectExpr("id as a", "id + 1 as b")
    r = embed(EmbeddingQuery(nodes=spark.range(40), edges=path))
    assert "Spectral" in r.outcome.rationale and r.coordinates.shape == (40, 2)
    s = embed(EmbeddingQuery(frame(spark, ribbon())))
    assert "scaling" in s.outcome.rationale and s.outcome.distortion is not None


def test_spectral_ignores_given_weights_and_reports_pieces(spark):
    edges = spark.createDataFrame([(0, 1, 100.0), (1, 2, 1.0), (3, 4, 5.0)], "a long, b long, weight double")
    r = embed(EmbeddingQuery(nodes=spark.range(6), edges=edges), SpectralMethod())
    texts = " ".join(n.text for n in r.notes)
    assert "pieces of the graph: 2" in texts and "Without any edge" in texts
    assert any("as given" in x for x in r.report())
    assert embed(EmbeddingQuery(frame(spark, ribbon())), SpectralMethod(neighbours=5)).coordinates.shape == (40, 2)


def test_own_method_and_refusals(spark):
    class First(EmbeddingMethod):
        name = "First columns"

        def fit(self, query, extent, dimensions):
            from quillmere.functions.frames import matrix

            ids, x = matrix(query.require_data())
            return EmbeddingOutcome(ids, x[:, :dimensions], "as it is")

    assert embed(EmbeddingQuery(frame(spark, ribbon())), First(), EmbedOptions(standardise=False)).coordinates.shape == (40, 2)
    with pytest.raises(ValueError):
        EmbeddingQuery()
    with pytest.raises(ValueError):
        embed(EmbeddingQuery(frame(spark, ribbon())), options=EmbedOptions(dimensions=0))
    with pytest.raises(ValueError):
        embed(EmbeddingQuery(frame(spark, ribbon())[["id", "x"]].limit(2)), options=EmbedOptions(dimensions=2))
    with pytest.raises(ValueError):
        embed(EmbeddingQuery(nodes=spark.range(3), edges=spark.createDataFrame([(0, 1)], "a long, b long")), ScalingMethod())
    with pytest.raises(ValueError):
        embed(EmbeddingQuery(frame(spark, ribbon()), spark.range(3), spark.createDataFrame([(0, 1)], "a long, b long")))
    assert AutoMethod().describe() == "Automatic"


def test_tables_of_many_tiles(spark):
    x = RNG.normal(0, 1, (50, 3))
    d, ids = apart(x), RNG.permutation(50) * 7 - 100
    rows = spark.createDataFrame([(int(ids[i]), int(ids[j]), float(v)) for (i, j), v in np.ndenumerate(d)], "i long, j long, d double").repartition(5)
    whole = scaling.from_distances(rows, scaling.ScalingOptions(3), local=True)
    table = scaling.DistanceTable.of(rows, 16)
    order = np.argsort(ids)
    np.testing.assert_array_equal(table.matrix(), (d + d.T)[np.ix_(order, order)] / 2)
    assert {(r.i, r.j): r.d for r in table.cells().collect()} == {(ids[i], ids[j]): v for (i, j), v in np.ndenumerate(d)}
    s = d * d
    b = -0.5 * (s - s.mean(1)[:, None] - s.mean(0)[None] + s.mean())
    got = {(r.i, r.j): r.b for r in scaling.double_centre(table).collect()}
    plain = {(r.i, r.j): r.b for r in scaling.double_centre(rows).collect()}
    for (i, j), v in np.ndenumerate(b):
        assert abs(got[ids[i], ids[j]] - v) < 1e-12 and abs(plain[ids[i], ids[j]] - v) < 1e-12
    spread = scaling.from_distances(table, scaling.ScalingOptions(3), local=False)
    np.testing.assert_allclose(spread.coordinates, whole.coordinates, atol=1e-7)
    np.testing.assert_allclose(apart(spread.coordinates), d[np.ix_(order, order)], atol=1e-7)
    for wrong in (rows.where("i <> j or i < 0"), rows.unionByName(rows.limit(1)), rows.where(f"j <> {int(ids[0])}"), rows.withColumn("d", F.when(F.col("i") < F.col("j"), F.col("d") * 2).otherwise(F.col("d")))):
        with pytest.raises(ValueError):
            scaling.DistanceTable.of(wrong, 16)


def test_tables_worked_out_from_samples(spark):
    for width in (1, 3):
        x = np.concatenate([RNG.normal(0, 1, (30, width))] * 2)
        ids = RNG.permutation(60) * 5 - 90
        rows = spark.createDataFrame([(int(i), list(map(float, v))) for i, v in zip(ids, x)], "id long, x array<double>").repartition(3)
        d = {(int(i), int(j)): float(np.sqrt(distances.squared_block(x[a : a + 1], x[b : b + 1])[0, 0])) for a, i in enumerate(ids) for b, j in enumerate(ids)}
        table = scaling.DistanceTable.between(rows, 16)
        assert {(r.i, r.j): r.d for r in table.cells().collect()} == d
        np.testing.assert_array_equal(table.matrix(), [[d[i, j] for j in table.ids.tolist()] for i in table.ids.tolist()])
        centred = scaling.double_centre(table)
        plan = centred._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "FileScan" not in plan
        cells = spark.createDataFrame([(i, j, v) for (i, j), v in d.items()], "i long, j long, d double")
        want = {(r.i, r.j): r.b for r in scaling.double_centre(cells).collect()}
        got = {(r.i, r.j): r.b for r in centred.collect()}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12
    for wrong in (rows.limit(0), rows.unionByName(rows.limit(1)), rows.withColumn("x", F.array(F.lit(math.nan)))):
        with pytest.raises(ValueError):
            scaling.DistanceTable.between(wrong)


def test_maps_of_tables_worked_out_from_samples(spark, monkeypatch):
    x = np.concatenate([RNG.normal(0, 9, (40, 1))] * 3)
    rows = frame(spark, x).repartition(3)
    monkeypatch.setattr(scaling, "stored", None)  # no cell is written
    for local in (True, False):
        r = scaling.from_distances(scaling.DistanceTable.between(rows, 16), scaling.ScalingOptions(1), local=local)
        np.testing.assert_array_equal(r.ids, np.arange(120))
        np.testing.assert_allclose(apart(r.coordinates), apart(x), atol=1e-7)
        # equal samples share one place, to the last digit
        assert len(np.unique(r.coordinates)) == 40


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no tables")
def test_centring_stores_and_shuffles_no_cells(spark):
    from quillmere.plans.queries import QUERIES

    plan = QUERIES["mds_double_centre"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FileScan" not in plan


def test_dense_ids_are_a_bijection(spark):
    from quillmere.functions.frames import dense_ids

    before = spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for adaptive, n in (("false", 20_000), ("true", 2_000_000)):
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            ids = spark.range(n).select((F.col("id") * 3 - 7).alias("id")).repartition(7)
            got = dense_ids(ids).select("id", "index").agg(F.count_distinct("index").alias("n"), F.max("index").alias("most"), F.bool_and(F.col("id") == F.col("index") * 3 - 7).alias("right")).first()
            assert (got.n, got.most, got.right) == (n, n - 1, True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
