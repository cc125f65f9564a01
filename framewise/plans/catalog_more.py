"""More queries: poses, projections, weights, grids, samples, fits, gates and ingestion, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import asof, dedup, fit, graph, knn, robust, sampling, score, sequence, stencil
from ..sources import io
from . import catalog_state as state
from .catalog import E_, _events, _GRID, _grid, _r, query


def _part(spark, d):
    """Parts with an angle, a depth and a pixel."""
    k = F.col("p_partkey")
    return io.table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice", F.radians((k % 360).cast("double")).alias("angle"), (F.col("p_retailprice") / 500).alias("z"), (k % 640).cast("double").alias("px"), (k * 7 % 480).cast("double").alias("py"))


_P = "WITH p AS (SELECT p_partkey, p_brand, p_size, p_retailprice, radians((p_partkey % 360)::DOUBLE) AS angle, p_retailprice / 500 AS z, (p_partkey % 640)::DOUBLE AS px, (p_partkey * 7 % 480)::DOUBLE AS py FROM part)"


def _pose(angle, x=0.0, y=0.0, z=0.0):
    """A turn about the vertical axis, then a shift."""
    c, s, o = F.cos(angle), F.sin(angle), F.lit(0.0)
    at = [v if hasattr(v, "cast") else F.lit(float(v)) for v in (x, y, z)]
    return F.array(c, -s, o, at[0], s, c, o, at[1], o, o, F.lit(1.0), at[2], o, o, o, F.lit(1.0))


@query("depth_clip", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice BETWEEN 5000 AND 40000 AND l_suppkey % 40 BETWEEN 5 AND 30 THEN l_extendedprice END AS l_extendedprice FROM lineitem")
def depth_clip(spark, d):
    rows = io.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey")
    return stencil.clip_depth(rows, "l_extendedprice", 5000, 40000, (F.col("l_suppkey") % 40).between(5, 30)).drop("l_suppkey")


@query("back_projection", _P + " SELECT p_partkey, round((px - 320) / 525.0::DOUBLE * z, 6) + 0 AS x, round((py - 240) / 525.0::DOUBLE * z, 6) + 0 AS y, round(z, 6) AS z FROM p")
def back_projection(spark, d):
    p = _part(spark, d).select("p_partkey", g.back_project(F.col("px"), F.col("py"), F.col("z"), 525, 525, 320, 240).alias("q"))
    return p.select("p_partkey", *((F.round(F.col("q")[a], 6) + 0).alias(a) for a in "xyz"))


@query("lens_projection", _P + """, q AS (SELECT p_partkey, (px - 320) / 525.0::DOUBLE AS a, (py - 240) / 525.0::DOUBLE AS b FROM p), r AS (SELECT *, a * a + b * b AS r2 FROM q), s AS (SELECT *, 1 + 0.1::DOUBLE * r2 - 0.05::DOUBLE * r2 * r2 + 0.01::DOUBLE * r2 * r2 * r2 AS k FROM r)
    SELECT p_partkey, round(520 * (a * k + 0.002::DOUBLE * a * b - 0.002::DOUBLE * (r2 + 2 * a * a)) + 310, 6) AS px, round(515 * (b * k + 0.001::DOUBLE * (r2 + 2 * b * b) - 0.004::DOUBLE * a * b) + 250, 6) AS py FROM s""")
def lens_projection(spark, d):
    p = _part(spark, d).withColumn("q", g.back_project(F.col("px"), F.col("py"), F.col("z"), 525, 525, 320, 240))
    p = p.select("p_partkey", g.project(F.col("q.x"), F.col("q.y"), F.col("q.z"), 520, 515, 310, 250, (0.1, -0.05, 0.001, -0.002, 0.01)).alias("s"))
    return _r(p.select("p_partkey", "s.px", "s.py"), "px", "py")


@query("rigid_transform", _P + " SELECT p_partkey, round(10 + cos(angle) * px - sin(angle) * py, 6) AS x, round(10 + sin(angle) * px + cos(angle) * py, 6) AS y, round(z + 3, 6) AS z FROM p")
def rigid_transform(spark, d):
    p = _part(spark, d).select("p_partkey", g.transform(_pose(F.col("angle"), 10, 10, 3), F.col("px"), F.col("py"), F.col("z")).alias("q"))
    return _r(p.select("p_partkey", "q.x", "q.y", "q.z"), "x", "y", "z")


@query("pose_algebra", _P + """ SELECT p_partkey, round(10 + 3 * cos(angle) + 4 * sin(angle), 6) AS x10, round(10 - 3 * sin(angle) + 4 * cos(angle), 6) AS y10, 5.0::DOUBLE AS moved,
    round(abs((p_partkey % 360 + 180) % 360 - 180)::DOUBLE, 4) AS turned, p_partkey % 5 <> 0 AS rigid FROM p""")
def pose_algebra(spark, d):
    # From a turned pose to a plain one: the shift of the latter is seen turned back.
    p = _part(spark, d).select("p_partkey", _pose(F.col("angle")).alias("a"), _pose(F.lit(0.0), 3, 4, 0).alias("b"))
    p = p.withColumns({"c": g.compose(g.inverse(F.col("a")), F.col("b")), "e": F.transform("a", lambda x: x * F.when(F.col("p_partkey") % 5 == 0, 1.1).otherwise(1.0))})
    c = F.col("c")
    return _r(_r(p.select("p_partkey", (10 + c[3]).alias("x10"), (10 + c[7]).alias("y10"), g.travel(c).alias("moved"), g.turn_degrees(c).alias("turned"), g.is_rigid(F.col("e")).alias("rigid")), "x10", "y10", "moved"), "turned", places=4)


@query("pixel_rounding", "SELECT p_partkey, round(p_partkey * 0.5::DOUBLE) AS away, round_even(p_partkey * 0.5::DOUBLE, 0) AS even, CAST(least(floor((p_partkey % 700) * 8 / 640.0::DOUBLE), 7) + 8 * least(floor((p_partkey * 7 % 500) * 6 / 480.0::DOUBLE), 5) AS BIGINT) AS cell FROM part")
def pixel_rounding(spark, d):
    k = F.col("p_partkey")
    return io.table(spark, d, "part").select("p_partkey", g.half_away(k * 0.5).alias("away"), g.half_even(k * 0.5).alias("even"), g.grid_cell(k % 700, k * 7 % 500, 640.0, 480.0).alias("cell"))


@query("time_gate", "SELECT event_id, CASE WHEN event_type = 'error' THEN true ELSE abs(value - 50) <= 20 END AS timely FROM events")
def time_gate(spark, d):
    lag = F.when(F.col("event_type") != "error", F.col("value") - 50)
    return io.table(spark, d, "events").select("event_id", g.timely(lag).alias("timely"))


@query("observation_weights", _P + """ SELECT p_partkey, round(0.001::DOUBLE + 0.002::DOUBLE * z * z, 9) AS sigma, round(c * c / greatest(z * z, 0.1::DOUBLE), 9) AS texture, round(z / greatest(c, 0.005::DOUBLE), 6) AS score, round(1 / (1 + pow(z / 0.5::DOUBLE, 2) + pow(c / 0.25::DOUBLE, 2)), 9) AS near,
    round(0.004::DOUBLE + 0.004::DOUBLE * sqrt(p_size::DOUBLE) + 0.008::DOUBLE * (p_partkey % 4), 9) AS uncertainty, round(exp(-pow(c / (0.07 * 9.80665::DOUBLE), 2) - pow(c / 2 / (0.08 * 9.80665::DOUBLE), 2)) * least(1.0::DOUBLE, p_size / 5.0::DOUBLE), 9) AS gravity FROM (SELECT *, (p_partkey % 11)::DOUBLE / 10 AS c FROM p)""")
def observation_weights(spark, d):
    z, c, k = F.col("z"), (F.col("p_partkey") % 11).cast("double") / 10, F.col("p_partkey")
    own = [g.depth_sigma(z).alias("sigma"), g.texture_weight(c, z).alias("texture"), g.pair_score(z, c).alias("score"), g.distance_weight(z, c, 0.5, 0.25).alias("near"), g.pose_uncertainty(F.col("p_size"), k % 4).alias("uncertainty"), g.gravity_confidence(9.80665 + c, c / 2, F.col("p_size")).alias("gravity")]
    return _r(_r(_part(spark, d).select("p_partkey", *own), "score"), "sigma", "texture", "near", "uncertainty", "gravity", places=9)


@query("barycentric_values", "SELECT p_partkey, round((greatest(a, 0) * 1 + greatest(b, 0) * 2 + 0.5::DOUBLE * 7) / (greatest(a, 0) + greatest(b, 0) + 0.5::DOUBLE), 9) AS v FROM (SELECT p_partkey, (p_partkey % 7 - 2)::DOUBLE / 5 AS a, (p_partkey % 5 - 1)::DOUBLE / 4 AS b FROM part)")
def barycentric_values(spark, d):
    k = F.col("p_partkey")
    v = g.barycentric(F.lit(1.0), F.lit(2.0), F.lit(7.0), (k % 7 - 2) / 5.0, (k % 5 - 1) / 4.0, F.lit(0.5))
    return _r(io.table(spark, d, "part").select("p_partkey", v.alias("v")), "v", places=9)


@query("affine_samples", "SELECT p_partkey, round((p_size - 0.5::DOUBLE) * 2, 6) AS x, round(-(p_retailprice - 0.25::DOUBLE) * 0.5::DOUBLE, 6) AS y FROM part")
def affine_samples(spark, d):
    raw = F.array(F.col("p_retailprice"), F.col("p_size").cast("double"), F.lit(0.0))
    v = g.affine(raw, (0.25, 0.5, 0.0), (0.5, 2.0, 1.0), (0, 1, 0, -1, 0, 0, 0, 0, 1))
    return _r(io.table(spark, d, "part").select("p_partkey", v[0].alias("x"), v[1].alias("y")), "x", "y")


@query("turn_between", _P + " SELECT p_partkey, round(cos(h / 2), 6) AS w, round(1 + sin(h / 2), 6) AS z1, round(h * 180 / pi() * 2, 6) AS degrees FROM (SELECT p_partkey, angle / 4 AS h FROM p)")
def turn_between(spark, d):
    half = F.col("angle") / 4
    q = g.slerp(F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))), F.array(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half)), F.lit(0.5))
    p = _part(spark, d).select("p_partkey", q.alias("q"), g.rotation_vector_angle(F.lit(0.0), F.lit(0.0), F.col("angle") / 2).alias("degrees"))
    return _r(p.select("p_partkey", F.col("q")[0].alias("w"), (1 + F.col("q")[3]).alias("z1"), "degrees"), "w", "z1", "degrees")


@query("identity_digest", "SELECT event_id, sha256(len(user_id::VARCHAR) || ':' || user_id || len(event_type) || ':' || event_type || CASE WHEN event_id % 3 = 0 THEN '0:' ELSE '2:é' END) AS digest, CASE WHEN event_id % 4 > 0 AND event_id % 5 > 0 THEN user_id || '/' || event_id % 4 || '/' || event_id % 5 ELSE user_id || '@' || event_id END AS frame FROM events")
def identity_digest(spark, d):
    k = F.col("event_id")
    digest = g.canonical_digest(F.col("user_id"), F.col("event_type"), F.when(k % 3 != 0, F.lit("é")))
    frame = score.frame_identity(F.col("user_id"), F.when(k % 4 > 0, k % 4), F.when(k % 5 > 0, k % 5), k)
    return io.table(spark, d, "events").select("event_id", digest.alias("digest"), frame.alias("frame"))


@query("projective_match", _GRID + """ SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN z IS NULL THEN 'missing' WHEN abs(z - l_extendedprice) <= greatest(2000.0::DOUBLE, 0.05::DOUBLE * l_extendedprice) THEN 'agree' WHEN z > l_extendedprice THEN 'free' ELSE 'hidden' END AS state
    FROM lineitem LEFT JOIN g ON x = l_suppkey % 40 AND y = l_partkey % 40 AND (x + y) % 3 > 0""")
def projective_match(spark, d):
    depth = _grid(spark, d).where("(x + y) % 3 > 0").select(F.lit(0).alias("view"), F.col("x").alias("px"), F.col("y").alias("py"), "z")
    points = io.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(0).alias("view"), (F.col("l_suppkey") % 40).alias("px"), (F.col("l_partkey") % 40).alias("py"), F.col("l_extendedprice").alias("z"))
    return knn.projective_match(points, depth, 2000.0, 0.05).select("l_orderkey", "l_linenumber", "l_partkey", "state")


@query("bilinear_values", _GRID + """, s AS (SELECT p_partkey AS id, (p_partkey % 79)::DOUBLE / 2 AS px, (p_partkey * 3 % 79)::DOUBLE / 2 AS py FROM part),
    c AS (SELECT id, floor(px) + a AS x, floor(py) + b AS y, (CASE WHEN a = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END) * (CASE WHEN b = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END) AS w FROM s, (VALUES (0), (1)) t(a), (VALUES (0), (1)) u(b))
    SELECT id, CASE WHEN count(*) = count(z) THEN round(sum(w * z), 2) END AS z FROM c LEFT JOIN g USING (x, y) WHERE w > 0 GROUP BY 1""")
def bilinear_values(spark, d):
    k = F.col("p_partkey")
    points = io.table(spark, d, "part").select(k.alias("id"), ((k % 79).cast("double") / 2).alias("px"), ((k * 3 % 79).cast("double") / 2).alias("py"))
    return _r(stencil.bilinear(points, _grid(spark, d), "id", "px", "py", "z"), "z", places=2)


@query("picture_sharpness", _GRID + """, n AS (SELECT a.x, a.y, a.z, r.z AS r, l.z AS l, u.z AS u, w.z AS w FROM g a LEFT JOIN g r ON r.x = a.x + 1 AND r.y = a.y LEFT JOIN g l ON l.x = a.x - 1 AND l.y = a.y LEFT JOIN g u ON u.x = a.x AND u.y = a.y - 1 LEFT JOIN g w ON w.x = a.x AND w.y = a.y + 1)
    SELECT 0 AS frame, round(var_pop(l + r + u + w - 4 * z), 0) AS laplacian, round((sum(abs(r - z)) + sum(abs(w - z))) / (count(r) + count(w)), 4) AS difference FROM n""")
def picture_sharpness(spark, d):
    return _r(_r(stencil.sharpness(_grid(spark, d), ("frame",), "x", "y", "z"), "laplacian", places=0), "difference", places=4)


@query("depth_classes", "SELECT l_returnflag, CASE WHEN l_suppkey % 7 = 0 THEN 'missing' WHEN l_extendedprice NOT BETWEEN 5000 AND 40000 THEN 'excluded' ELSE 'included' END AS shown, count(*) AS n, count(*) FILTER (l_suppkey % 7 <> 0 AND l_extendedprice <= 40000 AND l_discount > 0 AND l_extendedprice - l_quantity * 900 >= -5000 AND l_partkey % 700 <= 639) AS folded FROM lineitem GROUP BY 1, 2")
def depth_classes(spark, d):
    depth = F.when(F.col("l_suppkey") % 7 != 0, F.col("l_extendedprice"))
    gate = stencil.fusion_gate(F.col("l_quantity") * 900, F.col("l_partkey") % 700, F.lit(0), depth, F.col("l_discount"), 640, 480, 40000, 5000)
    rows = io.table(spark, d, "lineitem").select("l_returnflag", stencil.colour_class(depth, 5000, 40000).alias("shown"), gate.alias("gate"))
    return rows.groupBy("l_returnflag", "shown").agg(F.count(F.lit(1)).alias("n"), F.count_if("gate").alias("folded"))


@query("usable_views", "SELECT l_suppkey, count(*) FILTER (l_discount > 0) AS pixels, count(DISTINCT CASE WHEN l_discount > 0 THEN l_partkey % 97 END) AS points FROM lineitem GROUP BY 1 HAVING pixels >= 40 AND points >= 30")
def usable_views(spark, d):
    rows = io.table(spark, d, "lineitem").select("l_suppkey", "l_discount", (F.col("l_partkey") % 97).alias("cell"))
    return stencil.usable_views(rows, "l_suppkey", "l_discount", "cell", 40, 30)


@query("boxes_in_view", """WITH b AS (SELECT p_partkey, (p_partkey % 20)::DOUBLE AS x0, (p_partkey % 20 + p_size / 10.0::DOUBLE) AS x1, (p_partkey % 13)::DOUBLE AS y0, (p_partkey % 13 + 1)::DOUBLE AS y1 FROM part), v AS (SELECT s_suppkey AS view, (s_suppkey % 10)::DOUBLE AS at_ FROM supplier WHERE s_suppkey < 10)
    SELECT p_partkey, view FROM b, v WHERE x1 >= at_ AND x0 <= at_ + 5 AND y1 >= at_ / 2 AND greatest(y0 - x0, y0 - x1, y1 - x0, y1 - x1) + 4 >= 0""")
def boxes_in_view(spark, d):
    k, o = F.col("p_partkey"), F.lit(0.0)
    boxes = io.table(spark, d, "part").select("p_partkey", (k % 20).cast("double").alias("x0"), (k % 20 + F.col("p_size") / 10.0).alias("x1"), (k % 13).cast("double").alias("y0"), (k % 13 + 1).cast("double").alias("y1"), o.alias("z0"), o.alias("z1"))
    at = (F.col("s_suppkey") % 10).cast("double")
    sides = [(F.lit(1.0), o, o, -at), (F.lit(-1.0), o, o, at + 5), (o, F.lit(1.0), o, -at / 2), (F.lit(-1.0), F.lit(1.0), o, F.lit(4.0))]
    planes = io.table(spark, d, "supplier").where("s_suppkey < 10").select(F.col("s_suppkey").alias("view"), F.explode(F.array(*(F.struct(*(c.alias(n) for c, n in zip(s, "abcd", strict=True))) for s in sides))).alias("p")).select("view", "p.*")
    return stencil.box_in_view(boxes, planes, "p_partkey")


@query("loss_scores", """SELECT l_returnflag, round(avg(pow(least(abs(l_tax - l_discount), 0.05::DOUBLE), 2)), 9) AS saturated, round(coalesce(avg((abs(l_tax - l_discount) <= 0.03::DOUBLE)::INT), 0), 9)::DOUBLE AS within, round(sum(l_quantity * l_discount) / sum(l_quantity), 9) AS weighted,
    round(2 * a * b / (a + b), 9) AS f FROM (SELECT *, avg((l_discount > 0.02::DOUBLE)::INT) OVER (PARTITION BY l_returnflag) AS a, avg((l_tax > 0.02::DOUBLE)::INT) OVER (PARTITION BY l_returnflag) AS b FROM lineitem) GROUP BY l_returnflag, a, b""")
def loss_scores(spark, d):
    error = F.col("l_tax") - F.col("l_discount")
    own = io.table(spark, d, "lineitem").groupBy("l_returnflag").agg(robust.saturated_loss(error, 0.05).alias("saturated"), robust.share(F.abs(error) <= 0.03, 0.0).alias("within"), robust.weighted_mean(F.col("l_discount"), F.col("l_quantity")).alias("weighted"), robust.share(F.col("l_discount") > 0.02, 0.0).alias("a"), robust.share(F.col("l_tax") > 0.02, 0.0).alias("b"))
    return _r(own.withColumn("f", robust.f_score(F.col("a"), F.col("b"))).drop("a", "b"), "saturated", "within", "weighted", "f", places=9)


def _moved(spark, d, outlier):
    """Points of each supplier, and where a turn by the supplier's number of degrees and a shift carry them."""
    p = io.table(spark, d, "lineitem").select("l_suppkey", F.col("l_quantity").alias("px"), (F.col("l_tax") * 100).alias("py"), (F.col("l_discount") * 10).alias("pz"), (F.col("l_partkey") % 17 == 0).alias("odd"))
    q = g.transform(_pose(F.radians((F.col("l_suppkey") % 90).cast("double")), 1, 2, 3), F.col("px"), F.col("py"), F.col("pz"))
    return p.withColumn("q", q).select("l_suppkey", "px", "py", "pz", *(F.col("q")[a].alias(f"q{a}") for a in "xy"), (F.col("q.z") + F.when(F.col("odd"), outlier).otherwise(0.0)).alias("qz"))


_TURNS = "WITH s AS (SELECT DISTINCT l_suppkey, radians((l_suppkey % 90)::DOUBLE) AS a FROM lineitem) SELECT l_suppkey, round(cos(a), 6) AS c, round(1 + sin(a), 6) AS s1, round(1.0::DOUBLE, 6) AS x, round(2.0::DOUBLE, 6) AS y, round(3.0::DOUBLE, 6) AS z FROM s"


def _turned(poses):
    return _r(poses.select("l_suppkey", F.col("pose")[0].alias("c"), (1 + F.col("pose")[4]).alias("s1"), F.col("pose")[3].alias("x"), F.col("pose")[7].alias("y"), F.col("pose")[11].alias("z")), "c", "s1", "x", "y", "z")


@query("rigid_fit", _TURNS)
def rigid_fit(spark, d):
    return _turned(fit.rigid_fit(_moved(spark, d, 0.0), ["l_suppkey"]))


@query("trimmed_fit", _TURNS)
def trimmed_fit(spark, d):
    return _turned(fit.trimmed_fit(_moved(spark, d, 0.15), ["l_suppkey"], 0.08, 6))


@query("plane_fit", "SELECT p_brand, round(-2 / sqrt(14.0::DOUBLE), 6) AS nx, round(3 / sqrt(14.0::DOUBLE), 6) AS ny, round(1 / sqrt(14.0::DOUBLE), 6) AS nz, round(1 / sqrt(14.0::DOUBLE), 6) AS \"offset\" FROM part GROUP BY 1 HAVING count(*) >= 6")
def plane_fit(spark, d):
    # Each point and its mirror, so that the medians lie on the plane z = 1 + 2 x - 3 y.
    p = io.table(spark, d, "part").withColumn("n", F.count(F.lit(1)).over(_own("p_brand"))).where("n >= 6")
    p = p.select("p_brand", F.explode(F.array(F.lit(-1.0), F.lit(1.0))).alias("s"), (F.col("p_partkey") % 10 + 1).alias("a"), (F.col("p_size") % 7 + 1).alias("b"))
    points = p.select("p_brand", (F.col("s") * F.col("a")).alias("x"), (F.col("s") * F.col("b")).alias("y"), (1 + F.col("s") * (2 * F.col("a") - 3 * F.col("b"))).alias("z"))
    return _r(fit.plane_fit(points, "p_brand").drop("scatter"), "nx", "ny", "nz", "offset")


def _own(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


@query("descriptor_summary", """WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), q AS (SELECT label, k, quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM u GROUP BY 1, 2),
    n AS (SELECT label, sqrt(sum(a * a + b * b + c * c)) AS n FROM q GROUP BY 1) SELECT label, k * 3 - 3 + j AS place, round(CASE j WHEN 0 THEN a WHEN 1 THEN b ELSE c END / n, 6) + 1 AS v1 FROM q JOIN n USING (label), (VALUES (0), (1), (2)) t(j)""")
def descriptor_summary(spark, d):
    rows = io.table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    out = fit.descriptor_summary(rows, "label", "v").select("label", F.posexplode("summary").alias("place", "v"))
    return out.select("label", F.col("place").cast("long").alias("place"), (F.round("v", 6) + 1).alias("v1"))


@query("place_votes", "SELECT l_shipdate::DATE AS day, count(DISTINCT l_suppkey) AS votes FROM lineitem GROUP BY 1")
def place_votes(spark, d):
    return fit.place_votes(io.table(spark, d, "lineitem").select("l_suppkey", F.to_date("l_shipdate").alias("day")), "l_suppkey", "day")


@query("independent_supports", "SELECT DISTINCT a.l_partkey FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey <> b.l_suppkey AND a.l_linenumber <> b.l_linenumber")
def independent_supports(spark, d):
    return fit.independent_supports(io.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber"), "l_partkey", "l_suppkey", "l_linenumber")


@query("reciprocal_poses", "SELECT p_partkey, p_partkey % 6 <= 2 AND p_partkey % 4 <= 1 AS ok FROM part")
def reciprocal_poses(spark, d):
    k = F.col("p_partkey")
    back = _pose(-F.col("angle") + F.radians((k % 6).cast("double") * 0.9), z=(k % 4) * 0.0099)
    return _part(spark, d).select("p_partkey", _pose(F.col("angle")).alias("a"), back.alias("b")).select("p_partkey", fit.reciprocal("a", "b").alias("ok"))


@query("split_segments", """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id) AS all_ FROM events)
    SELECT user_id, event_id, n // 16 AS fragment, true AS owned FROM r UNION ALL SELECT user_id, event_id, n // 16 + 1, false FROM r WHERE n % 16 >= 14 AND n // 16 + 1 <= (all_ - 1) // 16""")
def split_segments(spark, d):
    return sequence.split_segments(io.table(spark, d, "events"), ("user_id",), t="ts", ties=("event_id",)).select("user_id", "event_id", "fragment", "owned")


@query("best_of_recent", E_ + ", w AS (SELECT event_id, t, list({'valid': event_type <> 'error', 'score': value, 'at': t}) OVER (PARTITION BY user_id ORDER BY t ROWS 4 PRECEDING) AS l FROM e) SELECT event_id, round(list_max(list_filter(l, lambda x: t - x.at <= 86400)).at, 6) AS best_t FROM w")
def best_of_recent(spark, d):
    rows = _events(spark, d).withColumn("valid", F.col("event_type") != "error")
    return _r(sequence.best_of_recent(rows, ("user_id",), "value", "valid", age=86400.0).select("event_id", "best_t"), "best_t")


@query("motion_triggered", state.MOTION)
def motion_triggered(spark, d):
    return sequence.motion_triggered(_events(spark, d).select("user_id", F.col("event_id").alias("id"), "t", "value"), "user_id", "value", 20.0, 43200.0)


@query("extrapolated", E_ + ", w AS (SELECT event_id, t, lag(t) OVER o AS t1, lag(t, 2) OVER o AS t2, lag(value) OVER o AS v1, lag(value, 2) OVER o AS v2 FROM e WINDOW o AS (PARTITION BY user_id ORDER BY t)) SELECT event_id, CASE WHEN t1 > t2 AND (t - t1) / (t1 - t2) <= 2 THEN round(v1 + (v1 - v2) * ((t - t1) / (t1 - t2)), 5) END AS predicted FROM w")
def extrapolated(spark, d):
    return _r(sequence.extrapolate(_events(spark, d), ("user_id",), "value").select("event_id", "predicted"), "predicted", places=5)


@query("interpolated", E_ + """, k AS (SELECT event_id, t, CASE WHEN event_type <> 'error' THEN {'t': t, 'v': value} END AS k, user_id FROM e), w AS (SELECT event_id, t, last_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS a, first_value(k IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM k)
    SELECT event_id, round(coalesce(CASE WHEN b.t > a.t THEN a.v + (b.v - a.v) * ((t - a.t) / (b.t - a.t)) END, a.v, b.v), 5) AS filled FROM w""")
def interpolated(spark, d):
    rows = _events(spark, d).withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    return _r(sequence.interpolate(rows, ("user_id",), "v").select("event_id", "filled"), "filled", places=5)


@query("trails", """WITH r AS (SELECT DISTINCT user_id, datediff('day', DATE '1970-01-01', ts::DATE) AS f FROM events), l AS (SELECT *, coalesce(lag(f) OVER (PARTITION BY user_id ORDER BY f) = f - 1, false) AS linked FROM r), t AS (SELECT *, sum((NOT linked)::INT) OVER (PARTITION BY user_id ORDER BY f ROWS UNBOUNDED PRECEDING) AS trail FROM l)
    SELECT user_id, f, linked, trail::BIGINT AS trail, row_number() OVER (PARTITION BY user_id, trail ORDER BY f) - 1 AS age FROM t""")
def trails(spark, d):
    rows = io.table(spark, d, "events").select("user_id", F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("f")).distinct()
    return sequence.trails(rows, "user_id", "f").select("user_id", "f", "linked", F.col("trail").cast("long").alias("trail"), F.col("age").cast("long").alias("age"))


@query("lifetimes", "SELECT user_id, min(event_id) AS first_frame, max(event_id) AS last_frame, count(*) AS observations, max(event_id) - min(event_id) AS age, max(event_id) = (SELECT max(event_id) FROM events) AS retained FROM events GROUP BY 1")
def lifetimes(spark, d):
    return sequence.lifetimes(io.table(spark, d, "events"), "user_id", "event_id")


@query("path_edges", "WITH a AS (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS was FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 4 <> 0)) SELECT l_orderkey, was AS from_index, l_linenumber AS to_index FROM a WHERE was = l_linenumber - 1")
def path_edges(spark, d):
    rows = io.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 4 != 0).alias("ok")).distinct()
    return sequence.path_edges(rows, ("l_orderkey",), "l_linenumber", "ok")


@query("temporal_pairs", "WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT a.user_id, a.n AS i, b.n AS j FROM r a JOIN r b ON a.user_id = b.user_id AND b.n - a.n BETWEEN 1 AND 3")
def temporal_pairs(spark, d):
    rows = io.table(spark, d, "events").select("user_id", F.row_number().over(_own("user_id").orderBy("ts", "event_id")).cast("long").alias("n"))
    return sequence.temporal_pairs(rows, ("user_id",), "n")


@query("tag_bank_pairs", """WITH t AS (SELECT DISTINCT event_type AS tag, datediff('day', DATE '1970-01-01', ts::DATE) AS j FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY j) - 1 AS n FROM t)
    SELECT a.tag, b.j AS i, a.j FROM r a JOIN r b ON a.tag = b.tag AND b.n < a.n WHERE b.n < 5 OR b.n >= a.n - 8 OR (b.n % 4 = 0 AND b.n // 4 > (a.n - 1) // 4 - 27)""")
def tag_bank_pairs(spark, d):
    rows = io.table(spark, d, "events").select(F.col("event_type").alias("tag"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).cast("long").alias("day"))
    return sequence.bank_pairs(rows, "tag", "day")


@query("pairs_apart", "WITH v AS (SELECT DISTINCT p_brand, p_size FROM part) SELECT a.p_brand, a.p_size AS i, b.p_size AS j FROM v a JOIN v b ON a.p_brand = b.p_brand AND b.p_size - a.p_size >= 5")
def pairs_apart(spark, d):
    return knn.pairs_apart(io.table(spark, d, "part").select("p_brand", "p_size").distinct(), ["p_brand"], "p_size", 5)


@query("earlier_results", "WITH r AS (SELECT l_partkey, l_suppkey, max({'l_quantity': l_quantity, 'l_tax': l_tax}) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) SELECT l_partkey, l_suppkey, r.l_quantity, r.l_tax, r IS NOT NULL AS cached FROM p LEFT JOIN r USING (l_partkey, l_suppkey)")
def earlier_results(spark, d):
    rows = io.table(spark, d, "lineitem")
    done = rows.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey", "l_quantity", "l_tax")
    return knn.with_earlier_results(rows.select("l_partkey", "l_suppkey").distinct(), done, ["l_partkey", "l_suppkey"])


@query("reference_pose", E_ + """, p AS (SELECT event_id, t FROM e WHERE event_type = 'signup'), r AS (SELECT event_id, t FROM e WHERE event_type = 'purchase'), m AS (SELECT p.event_id, r.event_id AS ref, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - r.t), r.t, r.event_id) AS rn FROM p JOIN r ON abs(p.t - r.t) <= 300)
    SELECT p.event_id, m.ref AS ref_event_id FROM p LEFT JOIN m ON m.event_id = p.event_id AND rn = 1""")
def reference_pose(spark, d):
    e = _events(spark, d)
    probe, ref = (e.where(F.col("event_type") == k).select("event_id", "t") for k in ("signup", "purchase"))
    return asof.asof_nearest(probe, ref, 300.0, how="left").select("event_id", "ref_event_id")


@query("top_matches", "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_quantity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_suppkey, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def top_matches(spark, d):
    rows = io.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    return sampling.top_k(rows, ["l_partkey"], [F.desc("l_quantity"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")], 3)


@query("interleaved", "WITH r AS (SELECT l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) AS turn FROM lineitem) SELECT l_partkey, min({'turn': turn, 'g': l_returnflag}).turn::INT AS turn, min({'turn': turn, 'g': l_returnflag}).g AS l_returnflag FROM r GROUP BY 1")
def interleaved(spark, d):
    return sampling.interleave(io.table(spark, d, "lineitem"), "l_returnflag", ["l_orderkey", "l_linenumber", "l_partkey"], "l_partkey")


@query("area_draws", "WITH s AS (SELECT p_partkey, p_size::DOUBLE AS a, sum(p_size::DOUBLE) OVER (ORDER BY p_partkey) AS up, sum(p_size::DOUBLE) OVER () AS all_ FROM part) SELECT p_partkey, CAST(ceil(up / all_ * 5000) - ceil((up - a) / all_ * 5000) AS BIGINT) AS draws FROM s")
def area_draws(spark, d):
    rows = io.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("area"))
    return sampling.area_sample(rows, "area", "p_partkey", 5000).select("p_partkey", "draws")


@query("landmark_quota", "WITH r AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), w AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey % 101 DESC, l_partkey) <= 5 AS due FROM r) SELECT l_partkey, bool_or(due) AS quota_met FROM w GROUP BY 1 ORDER BY 2 DESC, l_partkey % 101 DESC, 1 LIMIT 250")
def landmark_quota(spark, d):
    rows = io.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_partkey") % 101).alias("rank")).distinct()
    return sampling.quota_fill(rows, "l_suppkey", "l_partkey", [F.desc("rank")], 5, 250)


@query("replenished", """WITH c AS (SELECT p_partkey, p_partkey % 48 AS cell, p_retailprice FROM part WHERE p_size > 20), h AS (SELECT p_partkey % 48 AS cell, count(*) AS held FROM part WHERE p_size = 7 GROUP BY 1), r AS (SELECT *, coalesce(held, 0) + row_number() OVER (PARTITION BY cell ORDER BY p_retailprice DESC, p_partkey) AS turn FROM c LEFT JOIN h USING (cell))
    SELECT p_partkey, cell, turn FROM r WHERE turn <= 4 ORDER BY turn, cell LIMIT (SELECT 150 - sum(held) FROM h)""")
def replenished(spark, d):
    p = io.table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 48).alias("cell"), "p_retailprice", "p_size")
    return sampling.replenish(p.where("p_size > 20"), p.where("p_size = 7"), "cell", [F.desc("p_retailprice")], "p_partkey", 4, 150).select("p_partkey", "cell", F.col("turn").cast("long").alias("turn"))


@query("landmarks", "SELECT l_partkey, count(DISTINCT l_suppkey) AS views, round(median(l_quantity), 6) AS l_quantity, round(median(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1 HAVING views >= 10")
def landmarks(spark, d):
    out = robust.landmarks(io.table(spark, d, "lineitem"), ["l_partkey"], "l_suppkey", ["l_quantity", "l_extendedprice"], 10)
    return _r(_r(out, "l_quantity"), "l_extendedprice", places=4)


@query("mean_direction", """WITH u AS (SELECT l_suppkey AS k, l_discount AS w, l_quantity / n AS x, l_tax * 100 / n AS y, 30 / n AS z FROM (SELECT *, sqrt(l_quantity * l_quantity + l_tax * 100 * (l_tax * 100) + 900) AS n FROM lineitem) WHERE l_discount > 0),
    s AS (SELECT k, count(*) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * z) AS z FROM u GROUP BY 1), m AS (SELECT k, n, x / sqrt(x * x + y * y + z * z) AS ux, y / sqrt(x * x + y * y + z * z) AS uy, z / sqrt(x * x + y * y + z * z) AS uz FROM s)
    SELECT k AS l_suppkey, any_value(n) AS n, round(any_value(ux), 6) AS ux, round(any_value(uy), 6) AS uy, round(any_value(uz), 6) AS uz, round(degrees(acos(least(min(x * ux + y * uy + z * uz), 1))), 4) AS spread, degrees(acos(least(min(x * ux + y * uy + z * uz), 1))) <= 44 AS accepted FROM u JOIN m USING (k) GROUP BY 1""")
def mean_direction(spark, d):
    rows = io.table(spark, d, "lineitem").select("l_suppkey", "l_discount", F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), F.lit(30.0).alias("z"))
    return _r(_r(robust.mean_direction(rows, ["l_suppkey"], ("x", "y", "z"), "l_discount", 44.0), "ux", "uy", "uz"), "spread", places=4)


@query("normal_scatter", "SELECT l_partkey, round(sum(l_quantity * l_tax * l_tax), 6) AS s_00, round(sum(l_quantity * l_tax * l_discount), 6) AS s_01, round(sum(l_quantity * l_tax), 6) AS s_02, round(sum(l_quantity * l_discount * l_discount), 6) AS s_11, round(sum(l_quantity * l_discount), 6) AS s_12, round(sum(l_quantity), 6) AS s_22, round(sum(l_quantity), 6) AS area, round(avg(l_tax), 6) AS mean_score FROM lineitem GROUP BY 1")
def normal_scatter(spark, d):
    rows = io.table(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    out = robust.normal_scatter(rows, "l_partkey", ("l_tax", "l_discount", "one"), "l_quantity").join(rows.groupBy("l_partkey").agg(F.avg("l_tax").alias("mean_score")), "l_partkey")
    return _r(out, *(c for c in out.columns if c != "l_partkey"))


@query("evidence_summary", "SELECT user_id, count(DISTINCT (event_type, event_id % 10)) AS observations, count(*) FILTER (value >= 20) AS complete, count(*) FILTER (value < 20) AS incomplete FROM events GROUP BY 1")
def evidence_summary(spark, d):
    rows = io.table(spark, d, "events").withColumn("sequence", F.col("event_id") % 10)
    return score.evidence_summary(rows, ["user_id"], "event_type", "sequence", sequence.interval_complete(F.lit(0.0), F.lit(20.0), F.lit(0.0), F.col("value"), 0.0))


@query("quality_states", "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'not_requested' WHEN p_partkey % 7 = 0 THEN 'failed' WHEN p_partkey % 11 = 0 THEN 'missing' WHEN p_size < 10 THEN 'invalid' ELSE 'passed' END AS state FROM part")
def quality_states(spark, d):
    k = F.col("p_partkey")
    return io.table(spark, d, "part").select("p_partkey", score.quality_state(k % 5 != 0, k % 7 == 0, F.when(k % 11 != 0, k), F.col("p_size") >= 10).alias("state"))


@query("support_disagreement", "WITH a AS (SELECT l_orderkey, max(l_tax) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_orderkey, max(l_tax) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) SELECT count(*) FILTER (a.l_orderkey IS NOT NULL AND b.l_orderkey IS NOT NULL) AS both, count(*) FILTER (a.l_orderkey IS NOT NULL AND b.l_orderkey IS NOT NULL AND a.v IS DISTINCT FROM b.v) AS differ, count(*) FILTER (a.l_orderkey IS NULL OR b.l_orderkey IS NULL) AS one_only FROM a FULL JOIN b USING (l_orderkey)")
def support_disagreement(spark, d):
    own = [io.table(spark, d, "lineitem").where(F.col("l_returnflag") == k).groupBy("l_orderkey").agg(F.max("l_tax").alias("v")) for k in "AR"]
    return score.disagreement(*own, "l_orderkey", "v")


@query("held_out_gate", "SELECT count(*) FILTER (b > 1.1::DOUBLE * a) AS worse, round(avg(a), 6) AS before, round(avg(b), 6) AS after, count(*) FILTER (b > 1.1::DOUBLE * a) = 0 AND avg(b) <= 0.98::DOUBLE * avg(a) AS accepted FROM (SELECT l_extendedprice AS a, l_extendedprice * (1 - l_discount) AS b FROM lineitem)")
def held_out_gate(spark, d):
    rows = io.table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("a"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("b"))
    return _r(score.held_out_gate(rows, "a", "b"), "before", "after")


@query("free_space_audit", "SELECT l_suppkey, view, round(sum(l_quantity), 6) AS tests, round(sum(l_quantity * l_discount) / sum(l_quantity), 9) AS agreement FROM (SELECT *, l_partkey % 10 AS view FROM lineitem) GROUP BY 1, 2 ORDER BY sum(l_quantity * l_discount) / sum(l_quantity), 1, 2 LIMIT 30")
def free_space_audit(spark, d):
    rows = io.table(spark, d, "lineitem").withColumn("view", F.col("l_partkey") % 10)
    return _r(_r(score.pair_agreement(rows, "l_suppkey", "view", "l_quantity", "l_discount"), "tests"), "agreement", places=9)


@query("tolerant_compare", "WITH a AS (SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_partkey % 9 <> 1), b AS (SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS p_size, p_retailprice + CASE WHEN p_partkey % 4 = 0 THEN 1.0::DOUBLE ELSE 0.00000000001::DOUBLE END AS p_retailprice FROM part WHERE p_partkey % 9 <> 2) SELECT p_partkey, CASE WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'p_size' WHEN a.p_retailprice IS DISTINCT FROM b.p_retailprice AND NOT coalesce(abs(a.p_retailprice - b.p_retailprice) <= 1e-10, false) THEN 'p_retailprice' END AS first_difference FROM a FULL JOIN b USING (p_partkey)")
def tolerant_compare(spark, d):
    p, k = io.table(spark, d, "part"), F.col("p_partkey")
    a = p.where("p_partkey % 9 <> 1").select("p_partkey", "p_size", "p_retailprice")
    b = p.where("p_partkey % 9 <> 2").select("p_partkey", F.when(k % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("p_size"), (F.col("p_retailprice") + F.when(k % 4 == 0, 1.0).otherwise(1e-11)).alias("p_retailprice"))
    return dedup.tolerant_compare(a, b, "p_partkey", ["p_size", "p_retailprice"])


@query("fusion_plan", "SELECT p_partkey, CAST(ceil(p_size * 100 * 1.02::DOUBLE) AS BIGINT) * 81920 AS bytes, CAST(ceil(p_size * 100 * 1.02::DOUBLE) AS BIGINT) * 81920 + greatest(268435456, CAST(ceil(p_size * 100 * 1.02::DOUBLE) AS BIGINT) * 81920 / 2.0::DOUBLE) <= 800000000 * 0.8::DOUBLE AS fits FROM part")
def fusion_plan(spark, d):
    plan = score.fusion_plan(F.col("p_size") * 100 * 1.0, F.lit(800_000_000))
    return io.table(spark, d, "part").select("p_partkey", plan.alias("q")).select("p_partkey", "q.bytes", "q.fits")


@query("valid_streams", """WITH r AS (SELECT event_id, user_id, event_id % 50 AS s, ts, (event_id * 7) % 11 AS o FROM events), w AS (SELECT *, count(*) OVER (PARTITION BY user_id, s) > 1 AS twice, s <= coalesce(lag(s) OVER (PARTITION BY user_id ORDER BY ts, s), s - 1) AS back FROM r)
    SELECT event_id, CASE WHEN twice THEN 'repeated identity' WHEN back THEN 'sequence' ELSE 'interval' END AS reason FROM w WHERE twice OR back OR o > 8""")
def valid_streams(spark, d):
    rows = _events(spark, d).select("event_id", "user_id", (F.col("event_id") % 50).alias("s"), "t", ((F.col("event_id") * 7) % 11).alias("o"))
    rows = rows.withColumns({"start": F.col("t") - 1, "end": F.when(F.col("o") > 8, F.col("t") - 0.5).otherwise(F.col("t"))})
    return score.validate_stream(rows, ["user_id"], "s", "t", "start", "end").select("event_id", "reason")


@query("journal_inventory", """WITH n AS (SELECT user_id::VARCHAR AS recording_segment, count(*) AS found FROM events GROUP BY 1), s AS (SELECT c_custkey::VARCHAR AS recording_segment, c_acctbal AS started_at, (c_custkey % 4 > 0) AS ok, 60 AS "rows" FROM customer WHERE c_custkey % 3 > 0)
    SELECT recording_segment, round(started_at, 4) AS started_at, least(found, coalesce("rows", 0)) AS usable, coalesce(ok, false) AS complete FROM n LEFT JOIN s USING (recording_segment)""")
def journal_inventory(spark, d):
    rows, status = _journal(spark, d)
    return _r(io.inventory(rows, status), "started_at", places=4)


def _journal(spark, d):
    k = F.col("c_custkey")
    rows = io.table(spark, d, "events").select(F.col("user_id").cast("string").alias("recording_segment"), F.col("event_id").alias("sequence"))
    status = io.table(spark, d, "customer").where("c_custkey % 3 > 0").select(k.cast("string").alias("recording_segment"), F.col("c_acctbal").alias("started_at"), F.lit(True).alias("closed"), (k % 4 > 0).alias("complete"), F.lit(0).cast("long").alias("dropped_reads"), F.lit(60).cast("long").alias("rows"))
    return rows, status


@query("checkpointed_prefix", "SELECT user_id::VARCHAR AS recording_segment, event_id AS sequence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) JOIN customer ON c_custkey = user_id WHERE c_custkey % 3 > 0 AND n <= 60")
def checkpointed_prefix(spark, d):
    return io.checkpointed(*_journal(spark, d))


@query("strided_frames", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND (o_orderkey - 100) % 7 = 0 AND o_orderkey < 100 + 7 * 150")
def strided_frames(spark, d):
    return io.strided(io.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7, 100, 150)


@query("raw_depths", "SELECT l_orderkey, l_linenumber, l_partkey, l_partkey % 2300 AS code, CASE WHEN l_partkey % 2300 BETWEEN 1 AND 2047 THEN (l_partkey % 2300) * 3 END AS mm FROM lineitem")
def raw_depths(spark, d):
    lookup = spark.range(1, 2048).select(F.col("id").alias("code"), (F.col("id") * 3).alias("mm"))
    rows = io.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 2300).alias("code"))
    return io.raw_to_mm(rows, lookup)


@query("missing_members", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND md5(e.text) = md5(d.text))")
def missing_members(spark, d):
    docs = io.table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    return io.missing_members(docs, docs.where("doc_id % 2 = 0"), "digest").select("doc_id")


@query("compact_plan", "SELECT o_orderkey AS old_index, row_number() OVER (ORDER BY o_orderkey) - 1 AS new_index FROM orders WHERE o_orderstatus <> 'P'")
def compact_plan(spark, d):
    frames = io.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") != "P").alias("ok"))
    return io.compact(frames, "ok", "o_orderkey")


@query("pose_chain", "WITH RECURSIVE w AS (SELECT 1::BIGINT AS id, 0.0::DOUBLE AS x UNION ALL SELECT p_partkey, w.x - p_size FROM part JOIN w ON w.id = p_partkey // 2 WHERE p_partkey > 1) SELECT id, round(x, 6) + 0 AS x FROM w")
def pose_chain(spark, d):
    k = F.col("p_partkey")
    tree = io.table(spark, d, "part").where(k > 1).select(F.floor(k / 2).alias("src"), k.alias("dst"), _pose(F.lit(0.0), F.col("p_size").cast("double")).alias("pose"))
    return graph.propagate(tree, 1).select("id", (F.round(F.col("world")[3], 6) + 0).alias("x"))


@query("face_adjacency", "WITH f AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 1000000 AS b, l_linenumber + 2000000 AS c FROM lineitem), n AS (SELECT *, row_number() OVER (ORDER BY a, b, c) AS face FROM f), e AS (SELECT face, a AS u, b AS v FROM n UNION ALL SELECT face, b, c FROM n UNION ALL SELECT face, a, c FROM n) SELECT u, v FROM e GROUP BY 1, 2 HAVING count(*) = 2")
def face_adjacency(spark, d):
    faces = io.table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b"), (F.col("l_linenumber") + 2000000).cast("long").alias("c")).distinct()
    return graph.face_adjacency(faces.withColumn("face", F.xxhash64("a", "b", "c"))).select("u", "v")


def _ranked(spark, d):
    near = knn.nearest_k(*[io.table(spark, d, "embeddings").select("vec_id", "embedding")] * 2, 3, "vec_id", "embedding", other=True)
    edges = near.select(F.least("a_id", "b_id").alias("src"), F.greatest("a_id", "b_id").alias("dst"), (-F.col("distance")).alias("score")).distinct()
    return edges.withColumn("kind", F.when((F.col("src") + F.col("dst")) % 3 == 0, "temporal").when((F.col("src") + F.col("dst")) % 3 == 1, "visual").otherwise("geometric"))


@query("ranked_forest", state.SPANNING.replace("rn <= 4", "rn <= 3").replace("(ORDER BY dist, src, dst)", "(ORDER BY (src + dst) % 3, dist, src, dst)").replace("SELECT src, dst, -dist AS score FROM s", "SELECT src, dst FROM s"))
def ranked_forest(spark, d):
    return graph.ranked_forest(_ranked(spark, d), "kind", {"temporal": 0, "visual": 1, "geometric": 2}, "score")


@query("surface_agreement", """WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice / 10 AS y, cos(p_partkey::DOUBLE) AS nx, sin(p_partkey::DOUBLE) AS ny FROM part),
    m AS (SELECT a.id AS a_id, b.id AS b_id, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 9) AS dist, abs(a.nx * b.nx + a.ny * b.ny) AS dot FROM p a JOIN p b ON a.id % 2 = 0 AND b.id % 2 = 1 AND abs(a.x - b.x) < 3 AND abs(a.y - b.y) < 3),
    n AS (SELECT a_id, min({'d': dist, 'b': b_id, 'dot': dot}) AS r FROM m WHERE dist < 3 GROUP BY 1) SELECT a_id, r.b AS b_id, round(r.d, 6) AS distance, r.d < 1 AND r.dot > 0.85 AS agrees FROM n""")
def surface_agreement(spark, d):
    k = F.col("p_partkey").cast("double")
    p = io.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 10).alias("y"), F.cos(k).alias("nx"), F.sin(k).alias("ny"), F.lit(0.0).alias("nz"))
    near = knn.radius_nearest(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ("x", "y"), 3.0, "id")
    return _r(knn.surface_agreement(near, p, p, 1.0, 0.85), "distance")


@query("paced_interval", "SELECT event_id, round(ceil(median(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 7 PRECEDING) * 1.15::DOUBLE * 10 - 1e-9) / 10, 6) AS \"interval\" FROM events")
def paced_interval(spark, d):
    return _r(sequence.paced_interval(io.table(spark, d, "events"), ("user_id",), "value", ("ts", "event_id")).select("event_id", "interval"), "interval")


@query("session_summary", "SELECT user_id, count(value) AS n, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY 1")
def session_summary(spark, d):
    return _r(score.session_summary(io.table(spark, d, "events"), ["user_id"], "value"), "min", "median", "mean", "p90", "p95", "max")


@query("accepted_prefix", "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) SELECT event_id, user_id FROM r WHERE n < 3 + user_id % 9")
def accepted_prefix(spark, d):
    rows = io.table(spark, d, "events").select("event_id", "user_id", (F.row_number().over(_own("user_id").orderBy("event_id")) - 1).alias("s"))
    rows = rows.where(F.col("s") != 3 + F.col("user_id") % 9)  # the sequence number that never came
    return dedup.accepted_prefix(rows, "user_id", "s").select("event_id", "user_id")
