"""DuckDB SQL with the same results as the queries of the same names."""

from __future__ import annotations

_LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _fixed(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


def _standard(columns: tuple[str, ...], weights: tuple[float, ...] | None = None, log: bool = False) -> str:
    value = lambda c: f"ln(1.0 + {c})" if log else c
    moments = ", ".join(f"avg({value(c)}) AS m{i}, stddev_pop({value(c)}) AS s{i}" for i, c in enumerate(columns))
    kept = [i for i in range(len(columns)) if weights is None or weights[i]]
    outs = ", ".join(_fixed(f"({value(columns[i])} - m{i}) / s{i} * {weights[i] if weights else 1.0}") + f" AS z{k}" for k, i in enumerate(kept))
    return f"WITH p AS (SELECT {moments} FROM lineitem) SELECT l_orderkey, l_linenumber, {outs} FROM lineitem, p"


_E = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_D2 = "list_reduce(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda s, v: s + v)"
_PAIRS = f"{_E}, d AS (SELECT a.id AS id, b.id AS nb, {_D2} AS d2 FROM e a, e b WHERE a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nb) AS rank FROM d)"


def _graph(k: int = 10) -> str:
    return f"{_PAIRS}, g AS (SELECT least(id, nb) AS a, greatest(id, nb) AS b, 0.5 * count(*) AS weight FROM r WHERE rank <= {k} GROUP BY 1, 2), s AS (SELECT a, b, weight FROM g UNION ALL SELECT b, a, weight FROM g), deg AS (SELECT e.id, coalesce(sum(s.weight), 0.0) AS degree FROM e LEFT JOIN s ON s.a = e.id GROUP BY e.id)"


_KNN = f"WITH {_PAIRS} SELECT id, rank, nb AS neighbour, {_fixed('sqrt(d2)', 9)} AS distance FROM r WHERE rank <= 5"


def _propagated(self_weight: float) -> str:
    own = f"UNION ALL SELECT id, id, {self_weight} FROM e" if self_weight else ""
    return (
        f"WITH {_graph()}, l AS (SELECT * FROM s {own}), root AS (SELECT id, CASE WHEN degree + {self_weight} > 0 THEN 1 / sqrt(degree + {self_weight}) ELSE 0.0 END AS r FROM deg), "
        f"v AS (SELECT id, unnest(range(64)) AS pos, unnest(x) AS value FROM e), "
        f"m AS (SELECT l.a AS id, v.pos, sum(l.weight * v.value * q.r) AS t FROM l JOIN v ON v.id = l.b JOIN root q ON q.id = l.b GROUP BY 1, 2) "
        f"SELECT v.id, CAST(v.pos AS INTEGER) AS pos, {_fixed('coalesce(m.t * p.r, 0.0)', 9)} AS value FROM v JOIN root p ON p.id = v.id LEFT JOIN m ON m.id = v.id AND m.pos = v.pos"
    )


#: Closed form of the two-column eigenproblem, with the sign rule: the larger entry of an axis is positive.
_TWO = (
    "m AS (SELECT avg(p_size) AS mu, avg(p_retailprice) AS mv, var_samp(p_size) AS a, var_samp(p_retailprice) AS c, covar_samp(p_size, p_retailprice) AS b FROM part), "
    "l AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l0, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l1 FROM m), "
    "n AS (SELECT *, b AS u0, l0 - a AS v0, b AS u1, l1 - a AS v1 FROM l), "
    "q AS (SELECT *, CASE WHEN abs(u0) >= abs(v0) THEN sign(u0) ELSE sign(v0) END / sqrt(u0 * u0 + v0 * v0) AS k0, CASE WHEN abs(u1) >= abs(v1) THEN sign(u1) ELSE sign(v1) END / sqrt(u1 * u1 + v1 * v1) AS k1 FROM n)"
)


def _two(whiten: bool) -> str:
    over = lambda i: f" / sqrt(l{i})" if whiten else ""
    z = ", ".join(_fixed(f"((p_size - mu) * u{i} + (p_retailprice - mv) * v{i}) * k{i}{over(i)}", 5) + f" AS z{i}" for i in (0, 1))
    return f"WITH {_TWO} SELECT p_partkey AS id, {z} FROM part, q"


_CELLS = "t AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, abs(a.s_acctbal - b.s_acctbal) AS d FROM supplier a, supplier b)"
_MAP = f"{_E}, k AS (SELECT a.id AS i, b.id AS j, sqrt({_D2}) AS wanted, sqrt((a.x[1] - b.x[1]) ** 2 + (a.x[2] - b.x[2]) ** 2) AS got, a.x[1] - b.x[1] AS d0, a.x[2] - b.x[2] AS d1 FROM e a, e b WHERE a.id <> b.id)"
_RING = (
    f"{_E}, pt AS (SELECT id, unnest(range(33)) AS k, x FROM e), p AS (SELECT id, k, x[2 * (k % 32) + 1] AS px, x[2 * (k % 32) + 2] AS py FROM pt), "
    "seg AS (SELECT a.id, a.k, a.px, a.py, b.px AS qx, b.py AS qy, sqrt((b.px - a.px) ** 2 + (b.py - a.py) ** 2) AS len FROM p a JOIN p b ON a.id = b.id AND b.k = a.k + 1), "
    "cum AS (SELECT *, sum(len) OVER (PARTITION BY id ORDER BY k) AS hi, sum(len) OVER (PARTITION BY id ORDER BY k) - len AS lo, sum(len) OVER (PARTITION BY id) AS total FROM seg)"
)
_SAMPLED = f"{_RING}, spot AS (SELECT id, unnest(range(16)) AS place FROM e), w AS (SELECT spot.id, spot.place, c.px + (c.total * spot.place / 16.0 - c.lo) / c.len * (c.qx - c.px) AS x, c.py + (c.total * spot.place / 16.0 - c.lo) / c.len * (c.qy - c.py) AS y, row_number() OVER (PARTITION BY spot.id, spot.place ORDER BY c.k DESC) AS last FROM spot JOIN cum c ON c.id = spot.id AND c.len > 0 AND c.lo <= c.total * spot.place / 16.0)"

_EDGES = "pe AS (SELECT least(a, b) AS a, greatest(a, b) AS b, CAST(max(w) AS DOUBLE) AS weight FROM (SELECT CAST(p_partkey % 41 AS BIGINT) AS a, CAST(p_size % 37 AS BIGINT) AS b, p_partkey % 8 AS w FROM part) WHERE a <> b GROUP BY 1, 2 HAVING max(w) <> 0)"
_NEAREST_WAYS = f"{_PAIRS}, n AS (SELECT least(id, nb) AS a, greatest(id, nb) AS b, min(sqrt(d2)) AS w FROM r WHERE rank <= 10 GROUP BY 1, 2), s AS (SELECT a, b, w FROM n WHERE w > 0 UNION ALL SELECT b, a, w FROM n WHERE w > 0)"

ORACLES = {
    "graph_costs": f"WITH RECURSIVE {_NEAREST_WAYS}, c(id, cost) USING KEY (id) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE) UNION SELECT s.b, min(c.cost + s.w) FROM c JOIN s ON s.a = c.id LEFT JOIN recurring.c AS o ON o.id = s.b GROUP BY s.b, o.cost HAVING o.cost IS NULL OR min(c.cost + s.w) < o.cost) "
    f"SELECT e.id, {_fixed('c.cost', 8)} AS cost FROM e LEFT JOIN c ON c.id = e.id",
    "onnx_softmax": "WITH l AS (SELECT p_partkey, exp(2.5 - 0.125 * p_size) AS a, exp(0.25) AS b, exp(0.125 * p_size - 3.75) AS c FROM part), q AS (SELECT p_partkey, a / (a + b + c) AS x, b / (a + b + c) AS y, c / (a + b + c) AS z FROM l) "
    f"SELECT p_partkey, CASE WHEN x >= y AND x >= z THEN 'small' WHEN y >= z THEN 'medium' ELSE 'large' END AS label, {_fixed('greatest(x, y, z)', 4)} AS confidence, {_fixed('x', 4)} AS p0, {_fixed('y', 4)} AS p1, {_fixed('z', 4)} AS p2 FROM q",
    "onnx_sigmoid_pair": "WITH q AS (SELECT p_partkey, 1 / (1 + exp(-(1.5 * (p_size - 24.0) / 8.0 + 0.25))) AS s FROM part) "
    f"SELECT p_partkey, CASE WHEN 1 - s >= s THEN 'no' ELSE 'yes' END AS label, {_fixed('greatest(s, 1 - s)', 4)} AS confidence, {_fixed('1 - s', 4)} AS p0, {_fixed('s', 4)} AS p1 FROM q",
    "onnx_relu_rescale": "SELECT p_partkey, CAST(100.0 + 0.25 * greatest(p_size - 0.5 * (p_partkey % 64) - 8.0, 0.0) AS DOUBLE) AS value FROM part",
    "pca_counts": f"WITH {_TWO}, t AS (SELECT CAST(unnest([0.5, 0.9, 0.999, 0.99999, 1.0]) AS DOUBLE) AS threshold) SELECT threshold, CAST(CASE WHEN l1 <= 1e-10 * (l0 + l1) OR (threshold < 1 AND l0 / (l0 + l1) >= threshold) THEN 1 ELSE 2 END AS INTEGER) AS components FROM t, q",
    "pca_restored": f"WITH {_TWO}, z AS (SELECT p_partkey AS id, ((p_size - mu) * u0 + (p_retailprice - mv) * v0) / (u0 * u0 + v0 * v0) AS z, mu, mv, u0, v0 FROM part, q) SELECT id, {_fixed('mu + z * u0', 5)} AS x0, {_fixed('mv + z * v0', 5)} AS x1 FROM z",
    "graph_from_edges": f"WITH {_EDGES} SELECT * FROM pe",
    "graph_reweighted": f"WITH {_EDGES} SELECT a, b, {_fixed('1.0 / (a + b + weight)', 8)} AS weight FROM pe",
    "obstacle_blocks": "WITH t AS (SELECT p_partkey, p_size AS x, p_partkey % 41 AS y FROM part) "
    "SELECT p_partkey, (x > 3.5 AND x < 5.5 AND y < 6.5) OR (x > 10 AND y > 0 AND x + y < 30) AS inside, (x > 3.5 AND y < 6.5) OR (x > 10 AND y > 0 AND y < 20) AS blocked FROM t",
    "outline_variants": f"WITH {_RING} SELECT id AS outline_id, {_fixed('sum(len)', 7)} AS length FROM seg GROUP BY id",
    "prep_params": "WITH v AS (SELECT unnest([0, 1, 2, 3]) AS pos, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem) "
    f"SELECT CAST(pos AS INTEGER) AS pos, {_fixed('avg(x)', 4)} AS centre, {_fixed('stddev_pop(x)', 4)} AS scale, stddev_pop(x) > 1e-12 * greatest(1.0, abs(avg(x))) AS kept FROM v GROUP BY pos",
    "prep_transform": _standard(_LINE),
    "prep_log": _standard(_LINE[:2], log=True),
    "prep_weighted": _standard(_LINE, (2.0, 0.0, 0.5, 1.0)),
    "prep_inverse": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{_fixed(c, 4)} AS z{i}" for i, c in enumerate(_LINE)) + " FROM lineitem",
    "prep_normalise_rows": "SELECT l_orderkey, l_linenumber, " + ", ".join(_fixed(f"{c} / sqrt({' + '.join(f'{x} * {x}' for x in _LINE)})") + f" AS z{i}" for i, c in enumerate(_LINE)) + " FROM lineitem",
    "frame_extent": "SELECT count(*) AS n_rows, CAST(max(len(embedding)) AS BIGINT) AS width FROM embeddings",
    "pairwise_distances": f"WITH {_E}, d AS (SELECT a.id AS i, b.id AS j, {_D2} AS v FROM e a, e b WHERE a.id < b.id) SELECT i, j, {_fixed('v', 9)} AS d2, {_fixed('sqrt(v)', 9)} AS d FROM d",
    "knn5": _KNN,
    "knn5_sql": _KNN,
    "knn_graph": f"WITH {_graph()} SELECT a, b, CAST(weight AS DOUBLE) AS weight FROM g",
    "knn_graph_distance": f"WITH {_PAIRS}, n AS (SELECT least(id, nb) AS a, greatest(id, nb) AS b, min(sqrt(d2)) AS w FROM r WHERE rank <= 10 AND sqrt(d2) <= 1.2 GROUP BY 1, 2) SELECT a, b, {_fixed('w', 9)} AS weight FROM n JOIN embeddings p ON p.vec_id = a JOIN embeddings q ON q.vec_id = b WHERE p.label <> q.label AND w > 0",
    "graph_degree": f"WITH {_graph()} SELECT id, CAST(degree AS DOUBLE) AS degree FROM deg",
    "graph_neighbours": f"WITH {_graph()} SELECT a AS id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS neighbours FROM s GROUP BY a",
    "propagate_plain": _propagated(0.0),
    "propagate_self": _propagated(1.0),
    "graph_components": f"WITH RECURSIVE {_graph(2)}, c AS (SELECT id, id AS root FROM e UNION SELECT s.b, c.root FROM c JOIN s ON s.a = c.id) SELECT id, min(root) AS component FROM c GROUP BY id",
    "covariance": f"WITH {_E}, v AS (SELECT id, unnest(range(64)) AS pos, unnest(x) AS value FROM e) SELECT CAST(p.pos AS INTEGER) AS i, CAST(q.pos AS INTEGER) AS j, {_fixed('covar_samp(p.value, q.value)', 10)} AS v FROM v p JOIN v q ON p.id = q.id AND p.pos <= q.pos GROUP BY 1, 2",
    "pca_2col": _two(False),
    "pca_2col_whiten": _two(True),
    "pca_variances": f"WITH {_TWO} SELECT CAST(0 AS INTEGER) AS component, {_fixed('l0', 4)} AS variance, {_fixed('l0 / (l0 + l1)', 8)} AS share FROM q UNION ALL SELECT CAST(1 AS INTEGER), {_fixed('l1', 4)}, {_fixed('l1 / (l0 + l1)', 8)} FROM q",
    "pca_roundtrip": f"WITH {_E}, v AS (SELECT id, unnest(range(64)) AS pos, unnest(x) AS value FROM e) SELECT id, CAST(pos AS INTEGER) AS pos, {_fixed('value', 6)} AS value FROM v",
    "pca_total_variance": f"WITH {_E}, v AS (SELECT unnest(range(64)) AS pos, unnest(x) AS value FROM e), s AS (SELECT var_samp(value) AS w FROM v GROUP BY pos) SELECT {_fixed('sum(w)', 9)} AS total FROM s",
    "mds_double_centre": f"WITH {_CELLS}, s AS (SELECT i, j, d * d AS s FROM t) SELECT i, j, {_fixed('-0.5 * (s - avg(s) OVER (PARTITION BY i) - avg(s) OVER (PARTITION BY j) + avg(s) OVER ()) / pi()', 2)} AS b FROM s",
    "mds_table_map": f"WITH {_CELLS} SELECT i, j, {_fixed('d', 3)} AS d FROM t WHERE i < j",
    "mds_stress": f"WITH {_MAP} SELECT i AS id, {_fixed('sqrt(sum((wanted - got) ** 2) / sum(wanted ** 2))', 8)} AS distortion FROM k GROUP BY i",
    "mds_one_step": f"WITH {_MAP} SELECT i AS id, {_fixed('sum(CASE WHEN got > 0 THEN wanted / got * d0 ELSE 0 END) / (count(*) + 1)', 8)} AS x0, {_fixed('sum(CASE WHEN got > 0 THEN wanted / got * d1 ELSE 0 END) / (count(*) + 1)', 8)} AS x1 FROM k GROUP BY i",
    "spectral_axis0": f"WITH {_graph()} SELECT id, {_fixed('1 / sqrt((SELECT sum(degree) FROM deg))', 9)} AS x FROM deg",
    "spectral_constant": f"WITH {_graph()} SELECT id, {_fixed('1 / sqrt((SELECT sum(degree) FROM deg))', 9)} AS x FROM deg",
    "embed_pca": f"WITH m AS (SELECT avg(p_size) AS ma, stddev_pop(p_size) AS sa, avg(p_retailprice) AS mb, stddev_pop(p_retailprice) AS sb FROM part) SELECT p_partkey AS id, {_fixed('((p_size - ma) / sa) ** 2 + ((p_retailprice - mb) / sb) ** 2')} AS r2 FROM part, m",
    "outline_length": f"WITH {_RING} SELECT id AS outline_id, {_fixed('sum(len)', 8)} AS length FROM seg GROUP BY id",
    "outline_resample": f"WITH {_SAMPLED} SELECT id AS outline_id, CAST(place AS INTEGER) AS place, {_fixed('x')} AS x, {_fixed('y')} AS y FROM w WHERE last = 1",
    "outline_size": f"WITH {_SAMPLED} SELECT id AS outline_id, {_fixed('sqrt(var_pop(x) + var_pop(y))', 7)} AS size FROM w WHERE last = 1 GROUP BY id",
    "onnx_linear": "SELECT p_partkey, 0.5 * p_size - 0.25 * (p_partkey % 64) + 3.0 AS value FROM part",
    "onnx_tree": "SELECT l_orderkey, l_linenumber, CAST(100.0 + CASE WHEN l_quantity <= 24 THEN 1.0 ELSE 5.0 END + CASE WHEN l_linenumber <= 3.5 THEN 10.0 ELSE -10.0 END AS DOUBLE) AS value FROM lineitem",
    "onnx_argmax": "WITH l AS (SELECT p_partkey, 20.0 - p_size AS a, 0.0 AS b, p_size - 30.0 AS c FROM part) SELECT p_partkey, CASE WHEN a >= b AND a >= c THEN 'small' WHEN b >= c THEN 'medium' ELSE 'large' END AS label, CAST(CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS BIGINT) AS label_index FROM l",
}
