"""Queries for local planes, contradictions, windings, labels and folds of streams, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.geometry import cell
from ..operators import graph, rounds, stencil, voxel
from ..sources import io
from ..streaming import jobs, tag_map
from . import catalog_state as state
from .catalog import _EDGES, _event_stream, _knn_edges, _r, query
from .shared import shared_dir

_CAMERA = (30.0, 32.0, 11.5, 9.5)
_SURFACE = """g AS (SELECT l_linenumber % 2 AS frame, l_orderkey % 24 AS x, l_partkey % 20 AS y, CAST(sum(l_quantity) AS BIGINT) % 29 AS h, round(avg(l_quantity), 2) AS q FROM lineitem GROUP BY 1, 2, 3),
    s AS (SELECT frame, x, y, CASE WHEN h = 0 THEN 0 ELSE round(1.2::DOUBLE + 0.004::DOUBLE * x + 0.01::DOUBLE * y + 0.0001::DOUBLE * q + CASE WHEN x > 17 THEN 0.4::DOUBLE ELSE 0 END, 6) END::DOUBLE AS z FROM g)"""


def _surface(spark, d):
    """Frames of a tilted plane with a jump, noise and holes."""
    key = [(F.col(c) % n).alias(a) for c, n, a in (("l_linenumber", 2, "frame"), ("l_orderkey", 24, "x"), ("l_partkey", 20, "y"))]
    g = io.table(spark, d, "lineitem").groupBy(*key).agg((F.sum("l_quantity").cast("long") % 29).alias("h"), F.round(F.avg("l_quantity"), 2).cast("double").alias("q"))
    z = F.round(1.2 + 0.004 * F.col("x") + 0.01 * F.col("y") + 0.0001 * F.col("q") + F.when(F.col("x") > 17, 0.4).otherwise(0.0), 6)
    return g.select("frame", "x", "y", F.when(F.col("h") == 0, 0.0).otherwise(z).alias("z"))


def _patches(sizes):
    """Whole patches of good cells, by meeting all cells around each."""
    out = []
    for s in sizes:
        r, square = s // 2, s * sum(2 * k * k for k in range(1, s // 2 + 1))
        out.append(f"p{s} AS (SELECT a.frame, a.x, a.y, sum(1 / b.z) / {s * s} AS m, sum((b.x - a.x) / b.z) / {square} AS dx, sum((b.y - a.y) / b.z) / {square} AS dy FROM good a JOIN good b ON a.frame = b.frame AND abs(a.x - b.x) <= {r} AND abs(a.y - b.y) <= {r} GROUP BY 1, 2, 3 HAVING count(*) = {s * s})")
    return ", ".join(out)


def _jumps(rule):
    return f"e AS (SELECT a.frame, a.x, a.y, a.z, coalesce(bool_or(b.z > 0 AND {rule}), false) AS edge FROM s a LEFT JOIN s b ON a.frame = b.frame AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY ALL), good AS (SELECT * FROM e WHERE z > 0 AND NOT edge)"


def _cosine(s):
    fx, fy, cx, cy = _CAMERA
    return f"CASE WHEN p{s}.m IS NOT NULL THEN least(greatest(p{s}.m / greatest(sqrt(pow(p{s}.dx * {fx}, 2) + pow(p{s}.dy * {fy}, 2) + pow(p{s}.m - p{s}.dx * (e.x - {cx}) - p{s}.dy * (e.y - {cy}), 2)) * sqrt(1 + pow((e.x - {cx}) / {fx}, 2) + pow((e.y - {cy}) / {fy}, 2)), 1e-10), 0), 1) END"


def _lefts(sizes):
    return " ".join(f"LEFT JOIN p{s} ON p{s}.frame = e.frame AND p{s}.x = e.x AND p{s}.y = e.y" for s in sizes)


@query("plane_incidence", f"WITH {_SURFACE}, " + _jumps("abs(a.z - b.z) > greatest(0.02, 0.02 * a.z)") + f", {_patches((7, 3))}, c AS (SELECT e.frame, e.x, e.y, e.z, edge, coalesce({_cosine(7)}, {_cosine(3)}) AS c FROM e {_lefts((7, 3))})" + """
    SELECT frame, x, y, edge, c IS NOT NULL AS fitted, round(coalesce(c, 0.5), 6)::DOUBLE AS cosine,
      round(CASE WHEN z <= 0 OR edge OR c < 0.25 THEN 0 ELSE least(greatest(pow(0.003::DOUBLE / (0.001::DOUBLE + 0.002::DOUBLE * z * z), 2), 0.05), 1) * coalesce(c, 0.5) * coalesce(c, 0.5) END, 6)::DOUBLE AS weight FROM c""")
def plane_incidence(spark, d):
    return _r(stencil.depth_weights(_surface(spark, d), ("frame",), "x", "y", "z", _CAMERA).drop("z"), "cosine", "weight")


@query("smooth_depth", f"WITH {_SURFACE}, " + _jumps("a.z > 0 AND abs(a.z - b.z) > greatest(0.03, 0.02 * least(a.z, b.z))") + f", {_patches((9, 5, 3))} SELECT e.frame, e.x, e.y, round(coalesce(" + ", ".join(f"CASE WHEN abs(1 / p{s}.m - e.z) <= greatest(0.0005, 0.0005 * e.z) THEN 1 / p{s}.m END" for s in (9, 5, 3)) + f", e.z), 6)::DOUBLE AS smooth FROM e {_lefts((9, 5, 3))}")
def smooth_depth(spark, d):
    return _r(stencil.smooth_depth(_surface(spark, d), ("frame",), "x", "y", "z", most=0.0005).drop("z"), "smooth")


_ROUNDS, _SWEEPS = 12, 2


def _contradictions():
    """The rounds one after the other; a round drops nothing once one before dropped nothing."""
    place = "SELECT {id} AS id, ({id} % 97) * 0.5::DOUBLE AS x, ({id} % 89) * 0.25::DOUBLE AS y"
    parts = [
        "v AS MATERIALIZED (" + place.format(id="p_partkey") + " FROM part UNION ALL " + place.format(id="(o_orderkey + 1000000000)") + " FROM orders)",
        """e0 AS MATERIALIZED (SELECT l_orderkey * 10 + l_linenumber AS edge, l_partkey AS src, l_orderkey + 1000000000 AS dst, l_quantity::DOUBLE AS weight,
        (l_partkey % 97) * 0.5::DOUBLE - ((l_orderkey + 1000000000) % 97) * 0.5::DOUBLE + l_discount::DOUBLE * 0.5 + CASE WHEN (l_orderkey * 7 + l_linenumber) % 53 = 0 THEN 2.0::DOUBLE ELSE 0 END AS x,
        (l_partkey % 89) * 0.25::DOUBLE - ((l_orderkey + 1000000000) % 89) * 0.25::DOUBLE + l_tax::DOUBLE * 0.5 AS y FROM lineitem)""",
    ]
    at = "v"
    for k in range(1, _ROUNDS + 1):
        for i in range(_SWEEPS):
            now = f"w{k}_{i}"
            both = f"(SELECT src AS id, dst AS near, weight, x, y FROM e{k - 1} UNION ALL SELECT dst, src, weight, -x, -y FROM e{k - 1})"
            parts.append(f"{now} AS MATERIALIZED (SELECT p.id, (p.x + coalesce(s.x, 0)) / (1 + coalesce(s.w, 0)) AS x, (p.y + coalesce(s.y, 0)) / (1 + coalesce(s.w, 0)) AS y FROM {at} p LEFT JOIN (SELECT b.id, sum(weight) AS w, sum(weight * (n.x + b.x)) AS x, sum(weight * (n.y + b.y)) AS y FROM {both} b JOIN {at} n ON n.id = b.near GROUP BY 1) s ON s.id = p.id)")
            at = now
        miss = "round(sqrt(pow(a.x - b.x - e.x, 2) + pow(a.y - b.y - e.y, 2)), 6)"
        parts.append(f"b{k} AS MATERIALIZED (SELECT edge, src, dst, {{'m': {miss}, 'e': edge}} AS r FROM e{k - 1} e JOIN {at} a ON a.id = src JOIN {at} b ON b.id = dst WHERE {miss} > 0.6)")
        before = f"(SELECT count(*) FROM g{k - 1}) > 0" if k > 1 else "true"
        parts.append(f"t{k} AS MATERIALIZED (SELECT v, max(r) AS r FROM (SELECT src AS v, r FROM b{k} UNION ALL SELECT dst, r FROM b{k}) GROUP BY 1)")
        parts.append(f"g{k} AS MATERIALIZED (SELECT edge FROM b{k} JOIN t{k} s ON s.v = src AND s.r = b{k}.r JOIN t{k} d ON d.v = dst AND d.r = b{k}.r WHERE {before})")
        parts.append(f"e{k} AS MATERIALIZED (SELECT * FROM e{k - 1} WHERE edge NOT IN (SELECT edge FROM g{k}))")
    gone = " UNION ALL ".join(f"SELECT edge, {k} AS gone FROM g{k}" for k in range(1, _ROUNDS + 1))
    return "WITH " + ",\n".join(parts) + f" SELECT e0.edge, CAST(gone AS INTEGER) AS gone FROM e0 LEFT JOIN ({gone}) g USING (edge)"


@query("without_contradictions", _contradictions())
def without_contradictions(spark, d):
    place = lambda c: (c.alias("id"), (c % 97 * 0.5).alias("x"), (c % 89 * 0.25).alias("y"))
    part, order = F.col("l_partkey"), F.col("l_orderkey") + 1_000_000_000
    at = io.table(spark, d, "part").select(*place(F.col("p_partkey"))).unionAll(io.table(spark, d, "orders").select(*place(F.col("o_orderkey") + 1_000_000_000)))
    wrong = F.when((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 53 == 0, 2.0).otherwise(0.0)
    x = part % 97 * 0.5 - order % 97 * 0.5 + F.col("l_discount").cast("double") * 0.5 + wrong
    y = part % 89 * 0.25 - order % 89 * 0.25 + F.col("l_tax").cast("double") * 0.5
    edges = io.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge"), part.alias("src"), order.alias("dst"), F.col("l_quantity").cast("double").alias("weight"), x.alias("x"), y.alias("y"))
    return rounds.without_contradictions(edges, at, ("x", "y"), 0.6, sweeps=_SWEEPS).select("edge", "gone")


@query("windings", """WITH f AS (SELECT p_partkey AS face, p_partkey % 5 AS ring, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY p_partkey % 5) AS n, p_size % 2 AS s, min(p_partkey) OVER (PARTITION BY p_partkey % 5) AS component FROM part WINDOW w AS (PARTITION BY p_partkey % 5 ORDER BY p_partkey)),
    g AS (SELECT *, (s = coalesce(lead(s) OVER w, first_value(s) OVER w))::INT AS flip FROM f WINDOW w AS (PARTITION BY ring ORDER BY i)),
    h AS (SELECT *, CASE WHEN i < n - 1 THEN coalesce(sum(flip) OVER (PARTITION BY ring ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 ELSE flip END AS turn FROM g),
    k AS (SELECT ring, ((max(turn) FILTER (i = n - 2) + max(turn) FILTER (i = n - 1)) % 2 <> max(flip) FILTER (i = n - 2))::BIGINT AS n_cuts FROM h GROUP BY 1)
    SELECT face, component, turn = 1 AS flipped, n_cuts FROM h JOIN k USING (ring)""")
def windings(spark, d):
    """Rings of triangles, each with its own winding."""
    from pyspark.sql import Window

    part, own = io.table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_partkey") % 5).alias("ring")), Window.partitionBy("ring")
    part = part.withColumns({"i": F.row_number().over(own.orderBy("p_partkey")) - 1, "n": F.count(F.lit(1)).over(own)})
    corner = lambda k: (F.col("ring") * 1_000_000 + (F.col("i") + k) % F.col("n")).cast("long")
    odd = F.col("p_size") % 2 == 1
    faces = part.select(F.col("p_partkey").alias("face"), F.when(odd, corner(1)).otherwise(corner(0)).alias("a"), F.when(odd, corner(0)).otherwise(corner(1)).alias("b"), corner(2).alias("c"))
    found, cuts = rounds.windings(faces)
    n = cuts.join(found.select(F.col("face").alias("src"), "component"), "src").groupBy("component").agg(F.count(F.lit(1)).alias("n_cuts"))
    return found.join(n, "component", "left").select("face", "component", "flipped", F.coalesce("n_cuts", F.lit(0).cast("long")).alias("n_cuts"))


@query("potts_labels")
def potts_labels(spark, d):
    seen = io.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id"), (F.col("l_suppkey") % 4).alias("view")).agg(F.sum("l_quantity").cast("double").alias("score"))
    k = F.col("p_partkey")
    edges = io.table(spark, d, "part").select(k.alias("a"), F.explode(F.array(k + 1, k + 10)).alias("b"))
    return rounds.potts_labels(seen, edges, diffusions=3, passes=4)[0]


@query("live_tag_map", state.TAG_MAP)
def live_tag_map(spark, d):
    i, v = F.col("event_id"), F.col("value")
    place = {"x": i * 37 % 11 * 0.004 + F.when(v > 70, 1).otherwise(0), "y": v * 0.0002, "z": 1 + i % 5 * 0.1}
    rows = jobs.read_table(spark, f"{d}/events.parquet").where("user_id is not null").withColumn("ts", F.col("ts").cast("timestamp")).withColumns(place)
    rows = rows.select(F.col("user_id").alias("session"), i.alias("view"), (F.length("event_type") % 3).cast("long").alias("mark"), "x", "y", "z", (F.col("z") * 2).alias("range_m"), F.lit(False).alias("repeated"), "ts")
    return jobs.run_to_table(tag_map.live_tag_map(rows, "60 days", 60 * 86_400_000), "tag-map")


@query("large_components", _EDGES + " SELECT id, component, n AS size FROM c JOIN (SELECT component, count(*) AS n FROM c GROUP BY 1 HAVING count(*) >= 5) USING (component)")
def large_components(spark, d):
    return graph.large_components(_knn_edges(spark, d), 5)


@query("uniform_fold", """SELECT CAST(floor(l_quantity / 10.0::DOUBLE) AS BIGINT) AS qx, round(avg(least((l_tax - 0.03::DOUBLE) / 0.02::DOUBLE, 1.0::DOUBLE)), 6)::DOUBLE AS tsdf, count(*)::DOUBLE AS w, count(*) AS n FROM lineitem WHERE l_tax - 0.03::DOUBLE >= -0.02::DOUBLE GROUP BY 1""")
def uniform_fold(spark, d):
    """Every observation counts alike."""
    rows = io.table(spark, d, "lineitem")
    return _r(voxel.weighted_fold(rows, [cell(F.col("l_quantity"), 10).alias("qx")], F.col("l_tax") - 0.03, F.lit(1), 0.02), "tsdf", "w")


@query("stream_windows", "SELECT CAST(floor(epoch_us(ts) / 86400e6) AS BIGINT) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    rows = _event_stream(spark, d).select("event_type", "ts")
    end = io.table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 10 DAYS")).first()[0]
    out = jobs.run_to_table(jobs.stream_windows(jobs.with_end(rows, end), ["event_type"], "1 day", "1 hour"), "windows").where("event_type is not null")
    return out.select(F.floor(F.unix_seconds("start") / 86400).alias("day"), "event_type", "n")


@query("upsert_fold", "SELECT l_partkey AS key, round(sum((1 + l_discount) * l_tax) / sum(1 + l_discount), 6)::DOUBLE AS tsdf, round(sum(1 + l_discount), 6)::DOUBLE AS w, count(*) AS n FROM lineitem GROUP BY 1")
def upsert_fold(spark, d):
    """The last version that the stream's batches have folded."""
    path = f"{shared_dir(spark)}/fold-{uuid.uuid4().hex}"
    rows = jobs.read_table(spark, f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("key"), F.col("l_tax").cast("double").alias("tsdf"), (1 + F.col("l_discount").cast("double")).alias("w"), F.lit(1).cast("long").alias("n"))
    jobs.upsert_fold(rows, path, ["key"]).awaitTermination()
    versions = spark.read.parquet(path)
    last = versions.agg(F.max("version")).first()[0]
    return _r(versions.where(F.col("version") == last).drop("version"), "tsdf", "w")
