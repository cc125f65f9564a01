"""Queries over whole sessions: replay, marks, meshes, ties between views and comparisons of runs, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graph, knn, marks, robust, score, stencil
from ..sources import io
from . import catalog_state as state
from .catalog import _events, _GRID, _grid, _r, query
from .catalog_more import _P, _part, _pose
from .replay import replay


@query("fusion_gates", _P + " SELECT p_partkey, z > 0 AND px BETWEEN 0 AND 599 AND py BETWEEN 0 AND 449 AND p_size > 0 AND p_size / 10 <= 4.5::DOUBLE AND p_partkey % 3 > 0 AND p_size / 10 - z >= -0.5::DOUBLE AS kept FROM p")
def fusion_gates(spark, d):
    return _part(spark, d).select("p_partkey", stencil.fusion_gate(F.col("z"), F.col("px"), F.col("py"), F.col("p_size") / 10, F.col("p_partkey") % 3, 600, 450, 4.5, 0.5).alias("kept"))


def _pass(old):
    return f"(SELECT v.id, (3 * v.value + coalesce(sum(w * u.value), 0)) / (3 + coalesce(sum(w) FILTER (u.value IS NOT NULL), 0)) AS value FROM {old} v LEFT JOIN n ON n.id = v.id LEFT JOIN {old} u ON u.id = n.near GROUP BY v.id, v.value)"


@query("smoothed_values", "WITH v0 AS (SELECT p_partkey AS id, p_retailprice AS value FROM part), e AS (SELECT p_partkey // 2 AS a, p_partkey AS b, exp(-pow(p_size / 10, 2)) AS w FROM part WHERE p_partkey > 1), n AS (SELECT a AS id, b AS near, w FROM e UNION ALL SELECT b, a, w FROM e), v1 AS " + _pass("v0") + ", v2 AS " + _pass("v1") + " SELECT id, round(value, 6) AS value FROM v2")
def smoothed_values(spark, d):
    part, k = io.table(spark, d, "part"), F.col("p_partkey")
    edges = part.where(k > 1).select(F.floor(k / 2).alias("src"), k.alias("dst"), F.exp(-F.pow(F.col("p_size") / 10, 2)).alias("w"))
    return _r(graph.smooth(part.select(k.alias("id"), F.col("p_retailprice").cast("double").alias("value")), edges, "w"), "value")


_MIDDLE = """CASE WHEN s > 0 THEN m + 2 * s * cos(acos(least(greatest((a * (b * c - yz * yz) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)) / (2 * s * s * s), -1), 1)) / 3 - 2 * pi() / 3) ELSE m END"""


def _side(s):
    """Whether one side of each tie spreads enough."""
    cov = ", ".join(f"covar_samp({s}.{c[0]}, {s}.{c[1]}) AS {c}" for c in ("xx", "xy", "xz", "yy", "yz", "zz"))
    return f"""(SELECT src, dst FROM (SELECT *, sqrt((a * a + b * b + c * c + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS s FROM (SELECT *, xx - m AS a, yy - m AS b, zz - m AS c FROM (SELECT *, (xx + yy + zz) / 3 AS m FROM
    (SELECT src, dst, count(*) AS n, {cov}, (max({s}.px) - min({s}.px)) / 640 * ((max({s}.py) - min({s}.py)) / 480) AS area FROM star GROUP BY 1, 2)))) WHERE n >= 20 AND area >= 0.04 AND {_MIDDLE} > 0.002 * greatest(xx + yy + zz, 1e-9))"""


@query("gauge_views", """WITH RECURSIVE s AS (SELECT l_orderkey % 300 AS landmark, l_suppkey % 9 AS "view", (l_partkey * 13 % 640)::DOUBLE AS px, CASE WHEN l_suppkey % 9 = 4 THEN 7.0 ELSE l_partkey * 7 % 480 END::DOUBLE AS py, l_quantity::DOUBLE AS x, l_extendedprice / 1000::DOUBLE AS y, l_discount * 100::DOUBLE AS z FROM lineitem),
    o AS (SELECT landmark, "view", min({'px': px, 'py': py, 'x': x, 'y': y, 'z': z}) AS p FROM s GROUP BY 1, 2), f AS (SELECT landmark, min({'v': "view", 'p': p}) AS f FROM o GROUP BY 1),
    star AS MATERIALIZED (SELECT f.v AS src, "view" AS dst, f.p AS pa, p AS pb FROM o JOIN f USING (landmark) WHERE "view" <> f.v), e AS MATERIALIZED (SELECT * FROM """ + _side("pa") + " INTERSECT SELECT * FROM " + _side("pb") + """), n AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
    w AS (SELECT 0::BIGINT AS id, 0 AS hops UNION SELECT n.b, hops + 1 FROM w JOIN n ON n.a = w.id WHERE hops < 10) SELECT id, min(hops) AS hops FROM w GROUP BY 1""")
def gauge_views(spark, d):
    view = F.col("l_suppkey") % 9
    py = F.when(view == 4, 7.0).otherwise((F.col("l_partkey") * 7 % 480).cast("double"))
    own = [(F.col("l_partkey") * 13 % 640).cast("double").alias("px"), py.alias("py"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z")]
    rows = io.table(spark, d, "lineitem").select((F.col("l_orderkey") % 300).alias("landmark"), view.alias("view"), *own)
    return graph.gauge_connected(rows, 0, (640.0, 480.0))


@query("component_clouds", _P + """, q AS (SELECT p_partkey % 10 AS component, 10.1234567::DOUBLE + cos(angle) * l_quantity - sin(angle) * (l_extendedprice / 1000) AS x, 10.1234567::DOUBLE + sin(angle) * l_quantity + cos(angle) * (l_extendedprice / 1000) AS y, l_tax / 3 + 3 AS z FROM lineitem JOIN p ON l_partkey = p_partkey)
    SELECT component, CAST(floor(x / 31.415::DOUBLE) AS BIGINT) AS i_x, CAST(floor(y / 31.415::DOUBLE) AS BIGINT) AS i_y, CAST(floor(z / 31.415::DOUBLE) AS BIGINT) AS i_z, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM q GROUP BY 1, 2, 3, 4""")
def component_clouds(spark, d):
    poses = _part(spark, d).select(F.col("p_partkey").alias("l_partkey"), _pose(F.col("angle"), 10.1234567, 10.1234567, 3).alias("pose"))
    points = io.table(spark, d, "lineitem").select("l_partkey", F.col("l_quantity").cast("double").alias("qx"), (F.col("l_extendedprice") / 1000).alias("qy"), (F.col("l_tax") / 3).alias("qz")).join(poses, "l_partkey")
    parts = io.table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 10).alias("component"))
    return _r(graph.component_clouds(parts, points, "l_partkey", "pose", ("qx", "qy", "qz"), 31.415), "x", "y", "z")


@query("log_gains", """WITH c AS (SELECT p_partkey, [p_size / 50, p_partkey % 10 / 10, p_partkey % 7 / 7]::DOUBLE[] AS t, [p_partkey % 11 / 11, p_size % 13 / 13, p_partkey % 5 / 5]::DOUBLE[] AS s FROM part),
    w AS (SELECT *, ln(greatest(0.2126::DOUBLE * t[1] + 0.7152::DOUBLE * t[2] + 0.0722::DOUBLE * t[3], 0.02::DOUBLE) / greatest(0.2126::DOUBLE * s[1] + 0.7152::DOUBLE * s[2] + 0.0722::DOUBLE * s[3], 0.02::DOUBLE)) AS u FROM c),
    g AS (SELECT p_partkey, list_transform([1, 2, 3], lambda i: greatest(least(u + pow(least(t[i], s[i]), 2) / (pow(least(t[i], s[i]), 2) + 0.0036::DOUBLE) * (ln(greatest(t[i], 0.01::DOUBLE) / greatest(s[i], 0.01::DOUBLE)) - u), ln(2)), -ln(2))) AS g FROM w)
    SELECT p_partkey, round(g[1], 6) AS r, round(g[2], 6) AS g, round(g[3], 6) AS b FROM g""")
def log_gains(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    gains = g.log_gains((size / 50, k % 10 / 10, k % 7 / 7), (k % 11 / 11, size % 13 / 13, k % 5 / 5))
    return _r(io.table(spark, d, "part").select("p_partkey", *(v.alias(n) for v, n in zip(gains, "rgb", strict=True))), *"rgb")


@query("turned_pixels", "WITH p AS (SELECT p_partkey, p_partkey % 4 AS turns, p_partkey * 3 % 640 AS x, p_partkey * 7 % 480 AS y FROM part) SELECT p_partkey, CASE turns WHEN 0 THEN x WHEN 1 THEN 479 - y WHEN 2 THEN 639 - x ELSE y END AS x, CASE turns WHEN 0 THEN y WHEN 1 THEN x WHEN 2 THEN 479 - y ELSE 639 - x END AS y FROM p")
def turned_pixels(spark, d):
    k = F.col("p_partkey")
    places = [F.when(k % 4 == turns, g.turned_pixel(k * 3 % 640, k * 7 % 480, 640, 480, 90 * turns)) for turns in range(4)]
    return io.table(spark, d, "part").select("p_partkey", F.coalesce(*places).alias("q")).select("p_partkey", "q.x", "q.y")


@query("gravity_blend", """WITH p AS (SELECT p_partkey, p_partkey % 40 + 0.5::DOUBLE AS angle, p_partkey % 11 / 10 AS sure, p_partkey % 2 = 0 AS verified, (p_partkey % 7 - 3) * 60 AS lag_ms FROM part), w AS (SELECT *, sure / 2 * CASE WHEN verified THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS weight, sure BETWEEN 0.4::DOUBLE AND 1.0::DOUBLE AND abs(lag_ms) <= 150 AND angle <= 25 AS ok FROM p)
    SELECT p_partkey, CASE WHEN ok THEN round(angle, 6) END AS disagreement, CASE WHEN ok THEN round(weight, 6) END AS weight, CASE WHEN ok THEN round(least(angle * weight, 3.0::DOUBLE), 6) END AS correction FROM w""")
def gravity_blend(spark, d):
    k = F.col("p_partkey")
    angle, o = F.radians(k % 40 + F.lit(0.5)), F.lit(0.0)
    blend = g.gravity_blend(F.array(F.sin(angle), o, F.cos(angle)), F.array(o, o, F.lit(1.0)), k % 11 / 10, k % 2 == 0, (k % 7 - 3) * 60)
    return _r(io.table(spark, d, "part").select("p_partkey", blend.alias("q")).select("p_partkey", "q.*"), "disagreement", "weight", "correction")


@query("grid_triangles", _GRID + """, q AS (SELECT a.x, a.y, least(a.z, b.z, c.z, e.z) AS lo, greatest(a.z, b.z, c.z, e.z) AS hi FROM g a JOIN g b ON b.x = a.x + 1 AND b.y = a.y JOIN g c ON c.x = a.x AND c.y = a.y + 1 JOIN g e ON e.x = a.x + 1 AND e.y = a.y + 1),
    w AS (SELECT y * 40 + x AS i FROM q WHERE hi - lo <= greatest(9000, lo * 0.3::DOUBLE)) SELECT 0 AS frame, i AS a, i + 40 AS b, i + 1 AS c FROM w UNION ALL SELECT 0, i + 1, i + 40, i + 41 FROM w""")
def grid_triangles(spark, d):
    return stencil.triangles(_grid(spark, d), ("frame",), "x", "y", "z", 40, 9000.0, 0.3)


def _methods(spark, d):
    k, orders = F.col("o_orderkey"), io.table(spark, d, "orders")
    first = orders.select("o_orderkey", F.when(k % 3 > 0, F.col("o_totalprice")).alias("result"))
    return score.fallback(first, orders.where(k % 2 == 0).select("o_orderkey", (-F.col("o_totalprice")).alias("result")), "o_orderkey", "result")


_METHODS = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice WHEN o_orderkey % 2 = 0 THEN -o_totalprice END AS result, CASE WHEN o_orderkey % 3 > 0 THEN 'primary' WHEN o_orderkey % 2 = 0 THEN 'second' END AS method FROM orders"


@query("fallback_results", _METHODS)
def fallback_results(spark, d):
    return _methods(spark, d)


@query("method_counts", f"SELECT count(*) FILTER (method IS DISTINCT FROM 'primary') AS attempts, count(*) FILTER (method = 'second') AS verified FROM ({_METHODS})")
def method_counts(spark, d):
    return score.method_counts(_methods(spark, d))


@query("run_comparison", "WITH a AS (SELECT p_partkey, p_size AS x, p_retailprice AS y FROM part WHERE p_partkey % 9 <> 1), b AS (SELECT p_partkey, p_size + p_partkey % 4 AS x, p_retailprice + p_partkey % 3 AS y FROM part WHERE p_partkey % 9 <> 2) SELECT count(a.x + b.x) AS both, count(*) - count(a.x + b.x) AS one_only, round(avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS mean_gap, round(max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS largest_gap FROM a FULL JOIN b USING (p_partkey)")
def run_comparison(spark, d):
    p, k = io.table(spark, d, "part"), F.col("p_partkey")
    a = p.where("p_partkey % 9 <> 1").select("p_partkey", F.col("p_size").alias("x"), F.col("p_retailprice").alias("y"))
    b = p.where("p_partkey % 9 <> 2").select("p_partkey", (F.col("p_size") + k % 4).alias("x"), (F.col("p_retailprice") + k % 3).alias("y"))
    return _r(score.run_comparison(a, b, "p_partkey", ("x", "y")), "mean_gap", "largest_gap")


@query("cloud_gap", """WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice / 10 AS y FROM part), m AS (SELECT a.id AS a, b.id AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 9) AS dist FROM p a JOIN p b ON a.id % 2 = 0 AND b.id % 2 = 1 AND abs(a.x - b.x) < 3 AND abs(a.y - b.y) < 3),
    f AS (SELECT avg(coalesce(dist, 3.0::DOUBLE)) AS v FROM p LEFT JOIN (SELECT a, min(dist) AS dist FROM m WHERE dist < 3 GROUP BY 1) ON a = id WHERE id % 2 = 0), r AS (SELECT avg(coalesce(dist, 3.0::DOUBLE)) AS v FROM p LEFT JOIN (SELECT b, min(dist) AS dist FROM m WHERE dist < 3 GROUP BY 1) ON b = id WHERE id % 2 = 1)
    SELECT round(f.v, 6) AS forward, round(r.v, 6) AS backward, round((f.v + r.v) / 2, 6) AS symmetric FROM f, r""")
def cloud_gap(spark, d):
    p = io.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 10).alias("y"))
    return _r(knn.cloud_gap(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ("x", "y"), 3.0, "id"), "forward", "backward", "symmetric")


@query("mark_states", """WITH m AS (SELECT p_partkey, p_partkey % 20 AS frame, p_partkey % 83 AS mark, [x, x + s, x + s, x] AS xs, [y, y, y + s, y + s] AS ys FROM (SELECT *, (p_partkey * 7 % 6 * 30)::DOUBLE AS x, (p_partkey * 11 % 5 * 40)::DOUBLE AS y, 10 + p_size::DOUBLE AS s FROM part)),
    t AS (SELECT p_partkey, frame, mark, CASE WHEN p_partkey % 2 = 1 THEN [xs[3], xs[4], xs[1], xs[2]] ELSE xs END AS xs, CASE WHEN p_partkey % 2 = 1 THEN [ys[3], ys[4], ys[1], ys[2]] ELSE ys END AS ys FROM m),
    c AS (SELECT DISTINCT i FROM (SELECT a.p_partkey AS i, list_min(list_transform(range(0, 4), lambda k: list_max(list_transform(range(0, 4), lambda c: sqrt(pow(a.xs[c + 1] - b.xs[(c + k) % 4 + 1], 2) + pow(a.ys[c + 1] - b.ys[(c + k) % 4 + 1], 2)))))) AS apart FROM t a JOIN t b ON a.frame = b.frame AND a.p_partkey <> b.p_partkey) WHERE apart < 5),
    n AS (SELECT *, count(*) OVER (PARTITION BY frame, mark) > 1 AS twice, list_min(list_transform(range(1, 5), lambda c: sqrt(pow(xs[c] - xs[c % 4 + 1], 2) + pow(ys[c] - ys[c % 4 + 1], 2)))) AS side FROM t)
    SELECT p_partkey, frame, mark, CASE WHEN twice THEN 'repeated' WHEN i IS NOT NULL THEN 'overlapping' WHEN side >= 20 THEN 'usable' ELSE 'small' END AS state FROM n LEFT JOIN c ON i = p_partkey""")
def mark_states(spark, d):
    k = F.col("p_partkey")
    x, y, s = (k * 7 % 6 * 30).cast("double"), (k * 11 % 5 * 40).cast("double"), 10 + F.col("p_size").cast("double")
    at = [F.struct(u.alias("x"), v.alias("y")) for u, v in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))]
    corners = F.when(k % 2 == 1, F.array(*at[2:], *at[:2])).otherwise(F.array(*at))
    rows = io.table(spark, d, "part").select("p_partkey", (k % 20).alias("frame"), (k % 83).alias("mark"), corners.alias("corners"))
    return marks.mark_gate(rows, "frame", "p_partkey", "mark", "corners").select("p_partkey", "frame", "mark", "state")


@query("shared_mark_candidates", """WITH r AS (SELECT tag, j, row_number() OVER (PARTITION BY tag ORDER BY j) - 1 AS n FROM (SELECT DISTINCT l_suppkey AS tag, l_orderkey AS j FROM lineitem)), p AS (SELECT b.j, a.j AS i, count(*) AS shared FROM r a JOIN r b ON a.tag = b.tag AND a.n < b.n AND (a.n < 5 OR a.n >= b.n - 8 OR (a.n % 4 = 0 AND a.n // 4 > (b.n - 1) // 4 - 27)) GROUP BY 1, 2)
    SELECT j, i, shared, rank FROM (SELECT *, row_number() OVER (PARTITION BY j ORDER BY shared DESC, i DESC) AS rank FROM p) WHERE rank <= 5""")
def shared_mark_candidates(spark, d):
    return marks.shared_candidates(io.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey"), "l_orderkey", "l_suppkey")


@query("face_scores", "SELECT l_orderkey * 10 + l_linenumber AS face, round(avg(p_retailprice), 6) AS score FROM (SELECT l_orderkey, l_linenumber, unnest([l_partkey, l_partkey + 1, l_partkey + 2]) AS id FROM lineitem) LEFT JOIN (SELECT * FROM part WHERE p_partkey % 5 > 1) ON p_partkey = id GROUP BY 1")
def face_scores(spark, d):
    k = F.col("l_partkey")
    faces = io.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("face"), k.alias("a"), (k + 1).alias("b"), (k + 2).alias("c"))
    return _r(robust.face_means(faces, io.table(spark, d, "part").where("p_partkey % 5 > 1").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("score"))), "score")


@query("sensor_replay", "WITH p AS (" + state.NEAREST_UNUSED + "), g AS (" + state.GRAVITY.replace("FROM events)", "FROM (SELECT event_id, ts, value, 0 AS user_id FROM events WHERE event_type = 'purchase'))") + """),
    s AS (SELECT g.*, epoch_us(ts) / 1e6 AS t FROM g JOIN events ON event_id = id), m AS (SELECT epoch_us(ts) / 1e6 AS t, (event_id % 4)::VARCHAR AS mode FROM events WHERE event_type = 'signup'),
    n AS (SELECT p.*, s.id, s.valid, s.up_x, s.up_y, s.up_z, row_number() OVER (PARTITION BY a_id ORDER BY abs(b_t - s.t), s.t) AS rn FROM p LEFT JOIN s ON abs(b_t - s.t) <= 900),
    l AS (SELECT *, greatest(a_t, b_t) AS late FROM n WHERE rn = 1) SELECT 0 AS segment, a_id, b_id, l.id AS sample, coalesce(valid, false) AS valid, up_x, up_y, up_z, coalesce(mode, 'auto') AS mode FROM l ASOF LEFT JOIN m ON l.late >= m.t""")
def sensor_replay(spark, d):
    e = _events(spark, d).select(F.lit(0).alias("segment"), F.col("event_id").alias("id"), "t", "value", "event_type")
    kind = lambda name: e.where(F.col("event_type") == name)
    samples = kind("purchase").select("segment", "id", "t", (9.8 * F.sin(F.col("value") / 50)).alias("ax"), (9.8 * F.cos(F.col("value") / 50)).alias("ay"), F.lit(0.1).alias("az"))
    modes = kind("signup").select("segment", "t", (F.col("id") % 4).cast("string").alias("mode"))
    pictures = [kind(name).select("segment", "id", "t") for name in ("view", "error")]
    return _r(replay(*pictures, samples, modes, "segment", 600.0, 900.0, 86400.0, gap=40000.0, tau=20000.0), "up_x", "up_y", "up_z")
