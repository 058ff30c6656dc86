"""Write ONNX models without the onnx package: a graph builder, its wire format, and a checked file sink."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

from .onnx_metadata import METADATA_KEY, ModelMetadata

#: Fixed values of the model format.
IR_VERSION, OPSET, TREE_OPSET, FLOAT, INT64 = 8, 17, 3, 1, 7
TREE_DOMAIN = "ai.onnx.ml"


class Message:
    """Bytes of one protobuf message."""

    def __init__(self) -> None:
        self.body = bytearray()

    @staticmethod
    def _number(value: int) -> bytes:
        value &= (1 << 64) - 1
        out = bytearray()
        while True:
            low, value = value & 0x7F, value >> 7
            out.append(low | (0x80 if value else 0))
            if not value:
                return bytes(out)

    def _tag(self, field: int, wire: int) -> None:
        self.body += self._number(field << 3 | wire)

    def integer(self, field: int, value: int) -> Message:
        self._tag(field, 0)
        self.body += self._number(int(value))
        return self

    def real(self, field: int, value: float) -> Message:
        self._tag(field, 5)
        self.body += struct.pack("<f", value)
        return self

    def data(self, field: int, value: bytes) -> Message:
        self._tag(field, 2)
        self.body += self._number(len(value)) + value
        return self

    def text(self, field: int, value: str) -> Message:
        return self.data(field, value.encode())

    def nested(self, field: int, value: Message) -> Message:
        return self.data(field, bytes(value.body))


#: Attribute values: int, float, str, or a list of one of them; an empty list needs its kind.
Value = int | float | str | Sequence[int] | Sequence[float] | Sequence[str]


def _attribute(name: str, value: Value) -> Message:
    m = Message().text(1, name)
    if isinstance(value, str):
        return m.text(4, value).integer(20, 3)
    if isinstance(value, bool | int | np.integer):
        return m.integer(3, value).integer(20, 2)
    if isinstance(value, float | np.floating):
        return m.real(2, value).integer(20, 1)
    items = list(value)
    if all(isinstance(v, str) for v in items) and items:
        for v in items:
            m.text(9, v)
        return m.integer(20, 8)
    if all(isinstance(v, int | np.integer) for v in items):
        for v in items:
            m.integer(8, v)
        return m.integer(20, 7)
    for v in items:
        m.real(7, v)
    return m.integer(20, 6)


@dataclass(frozen=True)
class TreeNode:
    """A branch (feature, threshold, and the numbers of its children) or a leaf (weights)."""

    feature: int = -1
    threshold: float = 0.0
    true_child: int = -1
    false_child: int = -1
    leaf_weights: tuple[float, ...] | None = None

    @property
    def is_leaf(self) -> bool:
        return self.leaf_weights is not None

    @staticmethod
    def branch(feature: int, threshold: float, true_child: int, false_child: int) -> TreeNode:
        return TreeNode(feature, threshold, true_child, false_child)

    @staticmethod
    def leaf(*weights: float) -> TreeNode:
        return TreeNode(leaf_weights=tuple(weights))


def float32_below(value: float) -> float:
    """The largest float32 that is not above the value, so that x <= t decides alike for every float32 x."""
    if not np.isfinite(value):
        raise ValueError("thresholds must be finite")
    near = np.float32(value)
    return float(np.nextafter(near, np.float32(-np.inf)) if float(near) > value else near)


@dataclass(frozen=True)
class TreeEnsemble:
    """Trees of nodes (root first, children by number), summed or averaged; x <= threshold goes to the true child."""

    trees: tuple[tuple[TreeNode, ...], ...]
    targets: int = 1
    average: bool = False
    base_values: tuple[float, ...] = ()

    def validate(self, features: int) -> None:
        if not self.trees or self.targets < 1:
            raise ValueError("an ensemble needs trees and targets")
        if self.base_values and len(self.base_values) != self.targets:
            raise ValueError("there must be one base value for each target")
        for tree in self.trees:
            if not tree:
                raise ValueError("a tree needs a node")
            met = [0] * len(tree)
            for node in tree:
                if node.is_leaf:
                    if len(node.leaf_weights) != self.targets or not np.isfinite(node.leaf_weights).all():
                        raise ValueError("a leaf needs one finite weight for each target")
                    continue
                if not 0 <= node.feature < features:
                    raise ValueError("a branch names a feature that does not exist")
                for child in (node.true_child, node.false_child):
                    if not 0 < child < len(tree):
                        raise ValueError("a branch names a child that does not exist")
                    met[child] += 1
            if any(n != 1 for n in met[1:]):
                raise ValueError("every node but the root must be the child of exactly one branch")

    def attributes(self) -> dict[str, Value]:
        rows = [(t, i, n) for t, tree in enumerate(self.trees) for i, n in enumerate(tree)]
        leaves = [(t, i, k, w) for t, i, n in rows if n.is_leaf for k, w in enumerate(n.leaf_weights)]
        out: dict[str, Value] = {
            "aggregate_function": "AVERAGE" if self.average else "SUM", "n_targets": self.targets, "post_transform": "NONE",
            "nodes_treeids": [t for t, _, _ in rows], "nodes_nodeids": [i for _, i, _ in rows],
            "nodes_modes": ["LEAF" if n.is_leaf else "BRANCH_LEQ" for _, _, n in rows],
            "nodes_featureids": [0 if n.is_leaf else n.feature for _, _, n in rows],
            "nodes_values": [0.0 if n.is_leaf else float32_below(n.threshold) for _, _, n in rows],
            "nodes_truenodeids": [0 if n.is_leaf else n.true_child for _, _, n in rows],
            "nodes_falsenodeids": [0 if n.is_leaf else n.false_child for _, _, n in rows],
            "nodes_missing_value_tracks_true": [0 for _ in rows],
            "target_treeids": [t for t, _, _, _ in leaves], "target_nodeids": [i for _, i, _, _ in leaves],
            "target_ids": [k for _, _, k, _ in leaves], "target_weights": [float(w) for _, _, _, w in leaves],
        }
        if self.base_values:
            out["base_values"] = [float(v) for v in self.base_values]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(rows, targets) in numpy, with the written thresholds."""
        out = np.tile(np.array(self.base_values or [0.0] * self.targets), (len(x), 1))
        for tree in self.trees:
            for r, row in enumerate(x):
                node = tree[0]
                while not node.is_leaf:
                    node = tree[node.true_child if np.float32(row[node.feature]) <= np.float32(float32_below(node.threshold)) else node.false_child]
                out[r] += np.array(node.leaf_weights) / (len(self.trees) if self.average else 1)
        return out


class OnnxGraph:
    """A graph under construction: one float32 input ``features`` [N, F], then nodes, then one head."""

    def __init__(self, feature_count: int):
        if feature_count < 1:
            raise ValueError("a graph needs at least one feature")
        self.feature_count, self.input = feature_count, "features"
        self._nodes: list[tuple[str, str, list[str], list[str], dict[str, Value]]] = []
        self._constants: dict[str, tuple[int, tuple[int, ...], bytes]] = {}
        self._outputs: list[tuple[str, int, tuple[int | str, ...]]] = []
        self._names = {self.input}
        self._task: str | None = None

    def _claim(self, name: str) -> str:
        if not name or name in self._names:
            raise ValueError(f"the name {name!r} is empty or taken")
        self._names.add(name)
        return name

    def _new(self, stem: str) -> str:
        n = 0
        while (name := f"{stem}_{n}") in self._names:
            n += 1
        return self._claim(name)

    def _require(self, *names: str) -> None:
        for name in names:
            if name not in self._names:
                raise ValueError(f"there is no tensor {name!r}")

    def constant(self, name: str, values: Sequence[float] | np.ndarray, dims: Sequence[int] | None = None) -> str:
        """A float32 constant; a matrix brings its own dims."""
        array = np.asarray(values, dtype=np.float32)
        dims = tuple(dims) if dims is not None else array.shape
        if int(np.prod(dims)) != array.size:
            raise ValueError(f"{array.size} values do not fill {dims}")
        self._constants[self._claim(name)] = (FLOAT, dims, array.astype("<f4").tobytes())
        return name

    def _values(self, stem: str, values: np.ndarray | Sequence[float]) -> str:
        array = np.asarray(values, dtype=np.float32)
        name = self._new(stem)
        self._constants[name] = (FLOAT, array.shape, array.astype("<f4").tobytes())
        return name

    def node(self, op_type: str, inputs: Sequence[str], attributes: dict[str, Value] | None = None, domain: str = "", output: str | None = None) -> str:
        """Append any operator with one output; returns the output's name."""
        self._require(*inputs)
        out = self._claim(output) if output else self._new(op_type.lower())
        self._nodes.append((op_type, domain, list(inputs), [out], dict(attributes or {})))
        return out

    def standardise(self, x: str, centre: Sequence[float], scale: Sequence[float]) -> str:
        scale = np.asarray(scale, float)
        if not np.isfinite(scale).all() or (scale == 0).any() or not np.isfinite(centre).all():
            raise ValueError("scales must be finite and not zero")
        return self.node("Div", [self.node("Sub", [x, self._values("centre", centre)]), self._values("scale", scale)])

    def dense(self, x: str, weights: np.ndarray, bias: Sequence[float]) -> str:
        """x @ weights [in, out] + bias."""
        weights = np.asarray(weights, float)
        if weights.ndim != 2 or len(bias) != weights.shape[1]:
            raise ValueError("weights must be [in, out] with one bias for each output")
        return self.node("Add", [self.node("MatMul", [x, self._values("weights", weights)]), self._values("bias", bias)])

    def relu(self, x: str) -> str:
        return self.node("Relu", [x])

    def softmax(self, x: str) -> str:
        return self.node("Softmax", [x], {"axis": 1})

    def rescale(self, x: str, centre: float, scale: float) -> str:
        return self.node("Add", [self.node("Mul", [x, self._values("scale", [scale])]), self._values("centre", [centre])])

    def sigmoid_pair(self, x: str) -> str:
        """[1 - s, s] of one logit."""
        s = self.node("Sigmoid", [x])
        return self.node("Concat", [self.node("Sub", [self._values("one", [1.0]), s]), s], {"axis": 1})

    def tree_ensemble(self, x: str, ensemble: TreeEnsemble) -> str:
        ensemble.validate(self.feature_count)
        return self.node("TreeEnsembleRegressor", [x], ensemble.attributes(), TREE_DOMAIN)

    def _head(self, task: str) -> None:
        if self._task is not None:
            raise ValueError("the graph has its outputs already")
        self._task = task

    def value_output(self, x: str) -> None:
        """The head of a regressor: ``value`` [N, 1]."""
        self._require(x)
        self._head("regression")
        self._rename(x, "value")
        self._outputs.append(("value", FLOAT, ("N", 1)))

    def classification_outputs(self, probabilities: str, classes: int) -> None:
        """The head of a classifier: ``label`` [N] (the first largest) and ``probabilities`` [N, C]."""
        self._require(probabilities)
        self._head("classification")
        self._rename(probabilities, "probabilities")
        self.node("ArgMax", ["probabilities"], {"axis": 1, "keepdims": 0, "select_last_index": 0}, output="label")
        self._outputs += [("label", INT64, ("N",)), ("probabilities", FLOAT, ("N", classes))]

    def _rename(self, old: str, new: str) -> None:
        if old in self._constants or old == self.input:
            raise ValueError("an output must be computed")
        self._names.discard(old)
        self._claim(new)
        swap = lambda names: [new if n == old else n for n in names]
        self._nodes = [(op, d, swap(i), swap(o), a) for op, d, i, o, a in self._nodes]

    def to_bytes(self, metadata: ModelMetadata | None = None, producer: str = "quillmere", key: str = METADATA_KEY) -> bytes:
        if not self._outputs:
            raise ValueError("the graph has no outputs")
        if metadata is not None:
            metadata.validate()
            if len(metadata.features) != self.feature_count:
                raise ValueError(f"the record names {len(metadata.features)} features, the graph takes {self.feature_count}")
            if metadata.task != self._task:
                raise ValueError("the record's task is not that of the graph")
        graph = Message()
        for n, (op, domain, inputs, outputs, attributes) in enumerate(self._nodes):
            node = Message()
            for i in inputs:
                node.text(1, i)
            for o in outputs:
                node.text(2, o)
            node.text(3, f"n{n}").text(4, op)
            for k, v in attributes.items():
                node.nested(5, _attribute(k, v))
            if domain:
                node.text(7, domain)
            graph.nested(1, node)
        graph.text(2, "model")
        for name, (kind, dims, raw) in self._constants.items():
            tensor = Message()
            for d in dims:
                tensor.integer(1, d)
            graph.nested(5, tensor.integer(2, kind).text(8, name).data(9, raw))
        graph.nested(11, _value_info(self.input, FLOAT, ("N", self.feature_count)))
        for name, kind, dims in self._outputs:
            graph.nested(12, _value_info(name, kind, dims))
        model = Message().integer(1, IR_VERSION).text(2, producer).nested(7, graph).nested(8, Message().text(1, "").integer(2, OPSET))
        if any(domain == TREE_DOMAIN for _, domain, *_ in self._nodes):
            model.nested(8, Message().text(1, TREE_DOMAIN).integer(2, TREE_OPSET))
        if metadata is not None:
            model.nested(14, Message().text(1, key).text(2, metadata.to_json()))
        return bytes(model.body)


def _value_info(name: str, kind: int, dims: Sequence[int | str]) -> Message:
    shape = Message()
    for d in dims:
        shape.nested(1, Message().text(2, d) if isinstance(d, str) else Message().integer(1, d))
    return Message().text(1, name).nested(2, Message().nested(1, Message().integer(1, kind).nested(2, shape)))


def write_model(data: bytes, path: str, check: Callable | None = None) -> None:
    """Stage beside the target, load, check, then rename; the staged file never stays."""
    from .onnx_model import OnnxModel

    staged = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(staged, "wb") as file:
            file.write(data)
        model = OnnxModel.load(staged)
        if check is not None:
            check(model)
        os.replace(staged, path)
    finally:
        if os.path.exists(staged):
            os.remove(staged)


def expect_values(model, rows: np.ndarray, expected: np.ndarray, tolerance: float = 1e-4) -> None:
    """Refuse a model whose values differ from the expected ones, or are not numbers."""
    expected = np.asarray(expected, float).ravel()
    got = np.asarray(model.predict(rows).values, float)
    worst = np.abs(got - expected).max() if len(expected) else 0.0
    if not worst <= tolerance * max(1.0, np.abs(expected).max() if len(expected) else 0.0):
        raise ValueError(f"the written model differs from the trained one by {worst}")


def expect_classes(model, rows: np.ndarray, labels: np.ndarray, probabilities: np.ndarray, tolerance: float = 1e-4, near_tie: float = 1e-3) -> None:
    """Refuse a model whose probabilities differ, or whose labels differ where the two best are not nearly equal."""
    probabilities = np.asarray(probabilities, float)
    got = model.predict(rows)
    worst = np.abs(got.probabilities - probabilities).max() if len(probabilities) else 0.0
    if not worst <= tolerance:
        raise ValueError(f"the written model's probabilities differ by {worst}")
    top = np.sort(probabilities, axis=1)
    clear = top[:, -1] - top[:, -2] > near_tie
    if ((got.label_index != np.asarray(labels)) & clear).any():
        raise ValueError("the written model chooses other classes")
