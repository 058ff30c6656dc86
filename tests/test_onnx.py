import os
from datetime import UTC, datetime

import numpy as np
import pytest
from pyspark.errors import PySparkException

from quillmere.sources.onnx_metadata import JSON_SCHEMA, DataInfo, InvalidModelData, ModelMetadata, Trainer, humanise
from quillmere.sources.onnx_model import OnnxModel, read_models, score
from quillmere.sources.onnx_writer import Message, OnnxGraph, TreeEnsemble, TreeNode, expect_classes, expect_values, float32_below, write_model

X = np.array([[10.0, 0.5, 1], [20, 0.75, 2], [14, 1, 0], [0, 0, 0], [13.9, 0.7, 3], [-5, 2, 1]])
NAMES = ("span", "sag", "rest_factor")
REGRESSION = ModelMetadata("regression", NAMES, "deflection")
CLASSES = ModelMetadata("classification", NAMES, "kind", ("soft", "stiff"), "3", Trainer("trainer", "1.2", "gradientBoosting"), datetime(2024, 5, 6, tzinfo=UTC), DataInfo(320, 4, ("g2",)), {"meanError": 0.25})


def linear():
    g = OnnxGraph(3)
    z = g.standardise(g.input, [1.0, 2, 3], [2.0, 4, 5])
    return g, g.dense(z, np.array([[1.0], [2], [3]]), [0.5])


def test_linear_round_trip(tmp_path):
    g, y = linear()
    g.value_output(g.rescale(y, 7.0, 2.0))
    expected = (((X - [1, 2, 3]) / [2, 4, 5]) @ [1, 2, 3] + 0.5) * 2 + 7
    path = str(tmp_path / "m.onnx")
    write_model(g.to_bytes(REGRESSION), path, lambda m: expect_values(m, X, expected))
    m = OnnxModel.load(path)
    assert m.task == "regression" and m.feature_names == NAMES and m.last_write is not None
    np.testing.assert_allclose(m.predict(X).values, expected, atol=1e-4)
    assert os.listdir(tmp_path) == ["m.onnx"] and len(m.predict(np.zeros((0, 3))).values) == 0


def test_disagreement_leaves_nothing(tmp_path):
    g, y = linear()
    g.value_output(y)
    for wrong in (np.zeros(6), np.full(6, np.nan)):
        with pytest.raises(ValueError):
            write_model(g.to_bytes(REGRESSION), str(tmp_path / "m.onnx"), lambda m, w=wrong: expect_values(m, X, w))
    assert os.listdir(tmp_path) == []


def test_softmax_and_sigmoid(tmp_path):
    w = np.array([[0.1, -0.2, 0.3], [1, 0, -1], [0.5, 0.5, 0]])
    g = OnnxGraph(3)
    g.classification_outputs(g.softmax(g.relu(g.dense(g.input, w, [0.0, 0.1, 0.2]))), 3)
    z = np.maximum(X @ w + [0, 0.1, 0.2], 0)
    p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
    meta = ModelMetadata("classification", NAMES, "kind", ("a", "b", "c"))
    write_model(g.to_bytes(meta), str(tmp_path / "s.onnx"), lambda m: expect_classes(m, X, p.argmax(1), p))
    with pytest.raises(ValueError):
        expect_classes(OnnxModel.load(str(tmp_path / "s.onnx")), X, p.argmin(1), p)
    with pytest.raises(ValueError):
        expect_classes(OnnxModel.load(str(tmp_path / "s.onnx")), X, p.argmax(1), p * np.nan)
    g, y = linear()
    g.classification_outputs(g.sigmoid_pair(y), 2)
    got = OnnxModel(g.to_bytes(CLASSES)).predict(X)
    s = 1 / (1 + np.exp(-(((X - [1, 2, 3]) / [2, 4, 5]) @ [1, 2, 3] + 0.5)))
    np.testing.assert_allclose(got.probabilities, np.column_stack([1 - s, s]), atol=1e-5)
    assert got.labels == tuple("soft" if v <= 0.5 else "stiff" for v in s)
    np.testing.assert_allclose(got.confidence, np.maximum(s, 1 - s), atol=1e-5)


def stump(feature, threshold, *leaves):
    return (TreeNode.branch(feature, threshold, 2, 1), TreeNode.leaf(*leaves[1]), TreeNode.leaf(*leaves[0]))


@pytest.mark.parametrize("average", [False, True])
def test_trees(average):
    e = TreeEnsemble((stump(0, 14.0, [1.0], [2.0]), stump(1, 0.75, [10.0], [20.0])), base_values=(100.0,), average=average)
    g = OnnxGraph(3)
    g.value_output(g.tree_ensemble(g.input, e))
    np.testing.assert_allclose(OnnxModel(g.to_bytes(REGRESSION)).predict(X).values, e.predict(X).ravel(), atol=1e-5)
    many = TreeEnsemble((stump(0, 14.0, [1.0, 0, 2], [0.0, 1, 1]),), targets=3)
    g = OnnxGraph(3)
    g.classification_outputs(g.softmax(g.tree_ensemble(g.input, many)), 3)
    assert OnnxModel(g.to_bytes()).predict(X).label_index.tolist() == many.predict(X).argmax(1).tolist()


def test_thresholds_round_down():
    assert float32_below(0.1) <= 0.1 and float32_below(0.5) == 0.5 and float32_below(-0.1) <= -0.1
    with pytest.raises(ValueError):
        float32_below(float("inf"))


@pytest.mark.parametrize("tree", [(), (TreeNode.branch(9, 1.0, 1, 2), TreeNode.leaf(1.0), TreeNode.leaf(2.0)), (TreeNode.branch(0, 1.0, 1, 5), TreeNode.leaf(1.0)), (TreeNode.branch(0, 1.0, 1, 1), TreeNode.leaf(1.0)), (TreeNode.leaf(1.0, 2.0),)])
def test_bad_trees(tree):
    with pytest.raises(ValueError):
        TreeEnsemble((tree,)).validate(3)


def test_graph_refusals():
    g, y = linear()
    for bad in (lambda: g.standardise(g.input, [0.0] * 3, [1.0, 0, 1]), lambda: g.node("Relu", ["nothing"]), lambda: g.constant("c", [1.0, 2], [3]), lambda: g.to_bytes(), lambda: g.constant("features", [1.0]), lambda: g.dense(y, np.ones((1, 2)), [1.0])):
        with pytest.raises(ValueError):
            bad()
    g.value_output(y)
    with pytest.raises(ValueError):
        g.value_output(y)
    with pytest.raises(ValueError):
        g.to_bytes(CLASSES)
    with pytest.raises(ValueError):
        g.to_bytes(ModelMetadata("regression", ("a",), "b"))
    assert bytes(Message().integer(1, -1).body) == b"\x08" + b"\xff" * 9 + b"\x01"


def test_record_round_trip_and_report(spark):
    assert ModelMetadata.from_json(CLASSES.to_json()) == CLASSES
    assert "null" not in REGRESSION.to_json() and '"extractorVersion"' in CLASSES.to_json()
    assert humanise("meanAbsoluteError") == "mean absolute error"
    lines = CLASSES.describe()
    assert lines[0] == "Classifies kind into soft, stiff" and "Trained on 2024-05-06" in lines and "mean error: 0.25" in lines and any("gradient boosting" in x for x in lines)
    row = spark.createDataFrame([(CLASSES.to_json(),)], "j string").selectExpr(f"from_json(j, '{JSON_SCHEMA}') as m").first().m
    assert row.classes == ["soft", "stiff"] and row.score == {"meanError": 0.25} and row.data.rows == 320


@pytest.mark.parametrize("bad", [dict(format=2), dict(features=()), dict(features=("a", " ")), dict(features=("a", "A")), dict(target=""), dict(classes=("x",)), dict(classes=("x", "x")), dict(task="regression"), dict(task="other"), dict(data=DataInfo(0, 1))])
def test_bad_records(bad):
    from dataclasses import replace

    with pytest.raises(InvalidModelData):
        replace(CLASSES, **bad).validate()
    with pytest.raises(InvalidModelData):
        ModelMetadata.from_json("{")
    with pytest.raises(InvalidModelData):
        ModelMetadata.from_json("{}")


def test_models_without_record_and_bad_files(tmp_path):
    g, y = linear()
    g.value_output(y)
    m = OnnxModel(g.to_bytes())
    assert not m.has_metadata and m.task == "regression" and m.feature_count == 3 and m.describe()
    assert OnnxModel(g.to_bytes(REGRESSION, key="other"), key="other").has_metadata
    with pytest.raises(FileNotFoundError):
        OnnxModel.load(str(tmp_path / "none.onnx"))
    (tmp_path / "bad.onnx").write_bytes(b"nonsense")
    with pytest.raises(InvalidModelData):
        OnnxModel.load(str(tmp_path / "bad.onnx"))
    for rows in (np.zeros((2, 2)), np.array([[np.nan, 1, 2]])):
        with pytest.raises(ValueError):
            m.predict(rows)


def test_scoring_frames_streams_and_folders(spark, tmp_path):
    g, y = linear()
    g.classification_outputs(g.sigmoid_pair(y), 2)
    m = OnnxModel(g.to_bytes(CLASSES))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(X)], "id long, x array<double>")
    rows = score(df, m).orderBy("id").collect()
    assert tuple(r.label for r in rows) == m.predict(X).labels and len(rows[0].probabilities) == 2
    wide = spark.createDataFrame([(1, 2.0, 3.0)], "span int, sag double, rest_factor double")
    assert score(wide, m, list(NAMES)).first().label in CLASSES.classes
    assert score(df.limit(0), m).count() == 0
    with pytest.raises(ValueError):
        score(df.withColumnRenamed("id", "label"), m)
    with pytest.raises(PySparkException):
        score(spark.createDataFrame([([1.0],)], "x array<double>"), m).collect()
    write_model(m.data, str(tmp_path / "a.onnx"))
    listed = read_models(spark, str(tmp_path)).collect()
    assert len(listed) == 1 and listed[0].target == "kind" and listed[0].features == list(NAMES)

    from quillmere.operators.preprocessing import FeaturePipeline
    from quillmere.streaming.apply import prepared, read_folder, scored, write_folder

    df.write.parquet(str(tmp_path / "in"))
    pipeline = FeaturePipeline.fit(df)
    stream = prepared(scored(read_folder(spark, str(tmp_path / "in"), "id long, x array<double>"), m), pipeline)
    write_folder(stream, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(60)
    got = {r.id: (r.label, r.x) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.id: r.x for r in pipeline.transform(df).collect()}
    assert {k: v[1] for k, v in got.items()} == want and {k: v[0] for k, v in got.items()} == {r.id: r.label for r in rows}
