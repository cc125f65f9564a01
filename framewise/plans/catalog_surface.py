"""Queries for ties between parts, batches, planes and pages, each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, score, sequence, surface
from ..sources import io
from .catalog import _r, query
from .catalog_more import _P, _part, _pose


@query("boundary_checks", _P + """, o AS (SELECT p_partkey AS k, angle AS a, p_size / 1000 AS x, angle + radians(0.37 * (p_partkey % 11)) AS b, p_size / 1000 + 0.01 * (p_partkey % 5) AS y, p_partkey % 13 > 0 AS ok FROM p),
    t AS (SELECT s.k AS src, s.k + 1 AS dst, s.ok AND coalesce(d.ok, false) AS ok, 0.37 * abs(s.k % 11 - d.k % 11) AS turned, sqrt(pow(cos(d.b) * (s.y - d.y) - cos(d.a) * (s.x - d.x), 2) + pow(sin(d.b) * (s.y - d.y) - sin(d.a) * (s.x - d.x), 2)) AS moved FROM o s LEFT JOIN o d ON d.k = s.k + 1)
    SELECT src, dst, CASE WHEN ok THEN round(moved, 6) END AS moved, CASE WHEN ok THEN round(turned, 3) END::DOUBLE AS turned, CASE WHEN NOT ok THEN 'missing' WHEN moved > 0.03 OR turned > 3 THEN 'too_far' ELSE 'kept' END AS reason FROM t""")
def boundary_checks(spark, d):
    part, k = _part(spark, d), F.col("p_partkey")
    new = _pose(F.col("angle") + F.radians(0.37 * (k % 11)), F.col("p_size") / 1000 + 0.01 * (k % 5))
    poses = part.select(k.alias("id"), _pose(F.col("angle"), F.col("p_size") / 1000).alias("old"), F.when(k % 13 > 0, new).alias("new"))
    return _r(_r(graph.boundary_checks(part.select(k.alias("src"), (k + 1).alias("dst")), poses, "id", "old", "new"), "moved"), "turned", places=3)


@query("witnessed_ties", """WITH w AS (SELECT l_orderkey AS a, l_linenumber AS line, 0.4::DOUBLE * l_discount AS x, l_quantity AS q FROM lineitem), f AS (SELECT a, min({'q': -q, 'line': line, 'x': x}) AS b FROM w GROUP BY 1),
    g AS (SELECT w.a, count(*) AS witnesses, any_value(b.line) AS line, any_value(b.x) AS x, bool_or(0.9 * abs(w.line - b.line) > 3 OR abs(w.x - b.x) > 0.03) AS unlike FROM w JOIN f USING (a) GROUP BY 1)
    SELECT g.a, g.a + 1 AS b, witnesses, CASE WHEN unlike OR (o_orderkey IS NOT NULL AND (abs(0.9 * line - 2) > 3 OR x > 0.03)) THEN 'ambiguous' WHEN o_orderkey IS NOT NULL THEN 'held' ELSE 'added' END AS state FROM g LEFT JOIN orders ON o_orderkey = g.a AND o_orderkey % 3 = 0""")
def witnessed_ties(spark, d):
    key = F.col("l_orderkey")
    seen = io.table(spark, d, "lineitem").select(key.alias("a"), (key + 1).alias("b"), "l_quantity", "l_linenumber", _pose(F.radians(0.9 * F.col("l_linenumber")), F.col("l_discount").cast("double") * 0.4).alias("pose"))
    held = io.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"), _pose(F.radians(F.lit(2.0))).alias("pose"))
    return graph.witnessed_ties(seen, held, "a", "b", [-F.col("l_quantity"), F.col("l_linenumber")], "pose").drop("pose")


@query("bridge_visibility", """WITH e AS (SELECT l_partkey % 97 AS a, l_suppkey % 97 AS b, l_quantity * 15 AS n, l_discount * CASE WHEN l_discount >= 0.085 THEN 4.9 ELSE 0.5 END::DOUBLE AS f FROM lineitem),
    s AS (SELECT least(a, b) AS a, greatest(a, b) AS b, sum(n) AS n, sum(n * f) AS free, count(*) FILTER (n >= 500 AND f > 0.4) AS bad FROM e WHERE a <> b GROUP BY 1, 2),
    t AS (SELECT p.p_partkey AS src, p.p_partkey * 2 AS dst, p.p_partkey % 97 AS a, q.p_partkey % 97 AS b FROM part p LEFT JOIN part q ON q.p_partkey = p.p_partkey * 2),
    m AS (SELECT src, dst, t.a, t.b, coalesce(n, 0)::DOUBLE AS tested, coalesce(free, 0) / greatest(coalesce(n, 0), 1) AS fraction, coalesce(bad, 0) AS conflicts FROM t LEFT JOIN s ON s.a = least(t.a, t.b) AND s.b = greatest(t.a, t.b) AND t.b IS NOT NULL)
    SELECT src, dst, tested, round(fraction, 6)::DOUBLE AS fraction, conflicts, CASE WHEN b IS NULL THEN 'unknown' WHEN a = b THEN 'same_component' WHEN conflicts > 0 OR fraction > 0.12 THEN 'conflict' ELSE 'supported' END AS reason FROM m""")
def bridge_visibility(spark, d):
    part, k = io.table(spark, d, "part"), F.col("p_partkey")
    share = F.col("l_discount").cast("double") * F.when(F.col("l_discount") >= 0.085, 4.9).otherwise(0.5)
    seen = io.table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_quantity") * 15).cast("double").alias("tested"), share.alias("fraction"))
    return _r(graph.bridge_visibility(part.select(k.alias("src"), (k * 2).alias("dst")), part.select(k.alias("id"), (k % 97).alias("component")), seen), "tested", "fraction")


@query("barrier_batches", """WITH o AS (SELECT o_custkey % 7 AS k, o_orderkey, o_orderkey % 9 > 0 AS ok, o_orderstatus AS s FROM orders), j AS (SELECT *, CASE WHEN ok AND coalesce(lag(ok) OVER w, false) AND lag(s) OVER w IS NOT DISTINCT FROM s THEN 0 ELSE 1 END AS fresh FROM o WINDOW w AS (PARTITION BY k ORDER BY o_orderkey)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS run FROM j), c AS (SELECT *, CASE WHEN (row_number() OVER (PARTITION BY k, run ORDER BY o_orderkey) - 1) % 3 = 0 THEN 1 ELSE 0 END AS start FROM r)
    SELECT k, o_orderkey, CAST(sum(start) OVER (PARTITION BY k ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS batch FROM c""")
def barrier_batches(spark, d):
    rows = io.table(spark, d, "orders").select((F.col("o_custkey") % 7).alias("k"), "o_orderkey", "o_orderstatus")
    return sequence.batches(rows, ("k",), ("o_orderkey",), F.col("o_orderkey") % 9 > 0, "o_orderstatus", 3).drop("o_orderstatus")


def _metric(name):
    return f"SELECT l_returnflag, '{name}' AS metric, {name}::DOUBLE AS v FROM lineitem"


@query("measurement_summary", "WITH u AS (" + " UNION ALL ".join(map(_metric, ("l_quantity", "l_discount", "l_tax"))) + ") SELECT l_returnflag, metric, count(v) AS n, min(v) AS min, round(median(v), 6) AS median, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95, max(v) AS max FROM u GROUP BY 1, 2")
def measurement_summary(spark, d):
    metrics = ["l_quantity", "l_discount", "l_tax"]
    rows = io.table(spark, d, "lineitem").select("l_returnflag", *(F.col(m).cast("double").alias(m) for m in metrics))
    return _r(score.measurement_summary(rows, ["l_returnflag"], metrics), "min", "median", "mean", "p90", "p95", "max")


def _plane_round(r):
    """SQL of one round: planes through hashed triples, hits, the best of each key, and what it leaves."""
    corners = ", ".join(f"max(CASE WHEN (rn - 1) % 3 = {c} THEN {a} END) AS {a}{c}" for c in range(3) for a in "xyz")
    return f"""t{r} AS (SELECT k, (rn - 1) // 3 AS try, {corners} FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5('{r}:' || id), id, x, y, z) AS rn FROM l{r}) WHERE rn <= 60 GROUP BY 1, 2 HAVING x2 IS NOT NULL),
    c{r} AS (SELECT k, try, x0, y0, z0, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS cx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS cy, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS cz FROM t{r}),
    p{r} AS (SELECT k, try, cx / n AS nx, cy / n AS ny, cz / n AS nz, cx / n * x0 + cy / n * y0 + cz / n * z0 AS d FROM (SELECT *, sqrt(cx * cx + cy * cy + cz * cz) AS n FROM c{r}) WHERE n > 1e-12),
    h{r} AS (SELECT k, try, nx, ny, nz, d, count(*) AS n FROM l{r} JOIN p{r} USING (k) WHERE abs(nx * x + ny * y + nz * z - d) <= 1.2345 GROUP BY ALL),
    b{r} AS MATERIALIZED (SELECT k, {r} AS round, nx, ny, nz, d, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, try) AS place FROM h{r}) JOIN needs USING (k) WHERE place = 1 AND n >= needs),
    l{r + 1} AS MATERIALIZED (SELECT l{r}.* FROM l{r} JOIN b{r} USING (k) WHERE abs(nx * x + ny * y + nz * z - d) > 1.2345)"""


@query("plane_segments", """WITH l0 AS MATERIALIZED (SELECT l_returnflag AS k, l_orderkey * 10 + l_linenumber AS id, l_quantity::DOUBLE AS x, l_extendedprice / 1000::DOUBLE AS y, l_discount * 100::DOUBLE AS z FROM lineitem), needs AS (SELECT k, greatest(20, floor(count(*) * 0.05)) AS needs FROM l0 GROUP BY 1), """
    + ", ".join(map(_plane_round, range(2))) + " SELECT k, round, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, round(d, 6) AS d, n FROM (FROM b0 UNION ALL FROM b1)")
def plane_segments(spark, d):
    own = [F.col("l_returnflag").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z")]
    return _r(surface.segment_planes(io.table(spark, d, "lineitem").select(*own), "k", "id", ("x", "y", "z"), 1.2345, 20, 0.05, 2, 20), "nx", "ny", "nz", "d")


def _cut(r):
    """SQL of one round of cuts."""
    widest = "CASE WHEN wx >= wy AND wx >= wz THEN x WHEN wy >= wz THEN y ELSE z END"
    spans = ", ".join(f"max({a}) OVER p - min({a}) OVER p AS w{a}" for a in "xyz")
    return f"""w{r} AS (SELECT *, {widest} AS v FROM (SELECT *, sum(a) OVER p AS s, count(*) OVER p AS n, {spans} FROM f{r} WINDOW p AS (PARTITION BY page))),
    c{r} AS MATERIALIZED (SELECT *, row_number() OVER o AS rn, sum(a) OVER (PARTITION BY page ORDER BY v, id ROWS UNBOUNDED PRECEDING) AS u FROM w{r} WINDOW o AS (PARTITION BY page ORDER BY v, id)),
    m{r} AS (SELECT page, min({{'o': abs(u - s / 2), 'rn': rn}}).rn AS spot FROM c{r} WHERE rn < n GROUP BY 1),
    f{r + 1} AS MATERIALIZED (SELECT id, x, y, z, a, CASE WHEN s > (SELECT sum(p_size) / 6 FROM part) AND n > 1 THEN 2 * page + CASE WHEN rn > spot THEN 1 ELSE 0 END ELSE page END AS page FROM c{r} LEFT JOIN m{r} USING (page))"""


@query("face_pages", "WITH f0 AS (SELECT p_partkey AS id, p_retailprice::DOUBLE AS x, (p_partkey * 7919 % 1000)::DOUBLE AS y, (p_partkey % 600)::DOUBLE AS z, p_size AS a, 1::BIGINT AS page FROM part WHERE p_size > 0), " + ", ".join(map(_cut, range(5))) + " SELECT id, page FROM f5")
def face_pages(spark, d):
    part, k = io.table(spark, d, "part"), F.col("p_partkey")
    faces = part.select(k.alias("id"), F.col("p_retailprice").cast("double").alias("x"), (k * 7919 % 1000).alias("y"), (k % 600).alias("z"), F.col("p_size").alias("a"))
    return surface.face_pages(faces, "id", ("x", "y", "z"), "a", part.agg(F.sum("p_size")).first()[0] / 6)
