import numpy as np
import pytest
from pyspark.errors import PySparkException

from quillmere.functions.frames import frame_of, matrix, measure, samples
from quillmere.operators.preprocessing import FeaturePipeline

RNG = np.random.default_rng(5)


def frame(spark, x):
    return frame_of(spark, np.arange(len(x)), np.asarray(x, float))


def values(df):
    return matrix(df)[1]


def test_standardises_with_population_deviation(spark):
    x = RNG.normal(3, 2, (50, 3))
    z = values(FeaturePipeline.fit(frame(spark, x)).transform(frame(spark, x)))
    np.testing.assert_allclose(z, (x - x.mean(0)) / x.std(0), atol=1e-10)


def test_row_norm_then_log(spark):
    x = np.abs(RNG.normal(3, 2, (40, 3)))
    x[0] = 0
    p = FeaturePipeline.fit(frame(spark, x), log_transform=True, normalise_rows=True)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    s = np.log(1 + np.where(n > 0, x / np.where(n > 0, n, 1), x))
    np.testing.assert_allclose(values(p.transform(frame(spark, x))), (s - s.mean(0)) / s.std(0), atol=1e-10)


def test_constant_and_weightless_columns_go_and_come_back_as_centre(spark):
    x = np.column_stack([RNG.normal(0, 1, 30), np.full(30, 7.0), RNG.normal(5, 1, 30), RNG.normal(2, 3, 30)])
    p = FeaturePipeline.fit(frame(spark, x), weights=[1, 1, 0, 2])
    assert p.kept_columns == (0, 3) and p.dropped == (1, 2)
    back = values(p.inverse_transform(p.transform(frame(spark, x))))
    np.testing.assert_allclose(back[:, [0, 3]], x[:, [0, 3]], atol=1e-10)
    np.testing.assert_allclose(back[:, 1], 7)
    np.testing.assert_allclose(back[:, 2], x[:, 2].mean())


def test_inverse_of_log(spark):
    x = np.abs(RNG.normal(3, 2, (20, 2)))
    p = FeaturePipeline.fit(frame(spark, x), log_transform=True)
    np.testing.assert_allclose(values(p.inverse_transform(p.transform(frame(spark, x)))), x, atol=1e-9)


def test_refusals(spark):
    with pytest.raises(ValueError):
        FeaturePipeline.fit(frame(spark, [[1.0, 2], [3, 4]]), weights=[1])
    with pytest.raises(RuntimeError):
        FeaturePipeline.fit(frame(spark, [[1.0, 2], [1, 2]]))
    with pytest.raises(PySparkException):
        FeaturePipeline.fit(frame(spark, [[-1.0, 2], [3, 4]]), log_transform=True)
    p = FeaturePipeline.fit(frame(spark, [[1.0, 2], [3, 4]]), log_transform=True)
    with pytest.raises(PySparkException):
        p.transform(frame(spark, [[-1.0, 2]])).collect()
    with pytest.raises(PySparkException):
        p.transform(frame(spark, [[1.0, 2, 3]])).collect()
    with pytest.raises(PySparkException):
        p.inverse_transform(frame(spark, [[1.0, 2, 3]])).collect()


def test_frames(spark):
    assert measure(frame(spark, [[1.0, 2], [3, 4]])).width == 2
    for bad in ([(1, [1.0, float("nan")])], [(1, [1.0]), (2, [1.0, 2.0])], [(None, [1.0])], [(1, [None])], [(1, None)]):
        with pytest.raises(ValueError):
            measure(spark.createDataFrame(bad, "id long, x array<double>"))
    with pytest.raises(ValueError):
        measure(spark.createDataFrame([(1, [1.0]), (1, [2.0])], "id long, x array<double>"), check_ids=True)
    wide = spark.createDataFrame([(2, 1, 2.5)], "k int, a int, b double")
    assert samples(wide, "k", ["a", "b"]).first().x == [1.0, 2.5]
