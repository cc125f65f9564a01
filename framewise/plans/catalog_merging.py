"""Queries for merged maps, frontier searches, grouped planes and motions by consensus, with DuckDB SQL that goes one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consensus, merging
from ..sources import io
from .catalog import _r, query


@query("merge_maps", """WITH RECURSIVE
    m AS (SELECT l_suppkey AS scene, l_partkey % 12 AS map, count(*) AS size, CAST(sum(l_quantity) AS BIGINT) % 7 <> 0 AS accepted FROM lineitem GROUP BY 1, 2),
    o AS (SELECT scene, map, row_number() OVER (PARTITION BY scene ORDER BY size DESC, map) AS r FROM m WHERE accepted),
    q AS (SELECT l_suppkey AS scene, l_partkey % 12 AS src, l_orderkey % 12 AS dst, 100 AS tested, CAST(round(l_discount * 100) AS BIGINT) AS free, ((l_orderkey * 7 + l_linenumber) % 401 = 0)::BIGINT AS conflicts, l_returnflag = 'R' AS sup,
      cos(radians(l_quantity)) AS c, sin(radians(l_quantity)) AS s, l_discount::DOUBLE AS x, l_tax::DOUBLE AS y FROM lineitem WHERE l_partkey % 12 <> l_orderkey % 12),
    e AS (SELECT q.*, a.r > b.r AS direct, greatest(a.r, b.r) AS late, CASE WHEN a.r > b.r THEN dst ELSE src END AS early FROM q JOIN o a ON a.scene = q.scene AND a.map = q.src JOIN o b ON b.scene = q.scene AND b.map = q.dst),
    p AS (SELECT scene, late, early, sum(tested)::BIGINT AS n, sum(free)::BIGINT AS free, sum(conflicts)::BIGINT AS conflicts, count(*) FILTER (sup) AS sup,
      min(CASE WHEN sup THEN {'share': free / tested::DOUBLE, 'e': early, 'c': c, 'ns': CASE WHEN direct THEN -s ELSE s END, 'x': CASE WHEN direct THEN x ELSE -(c * x + s * y) END, 'y': CASE WHEN direct THEN y ELSE -(-s * x + c * y) END} END) AS b FROM e GROUP BY 1, 2, 3),
    l AS (SELECT scene, late, list({'e': early, 'n': n, 'free': free, 'conflicts': conflicts, 'sup': sup, 'b': b}) AS ev FROM p GROUP BY 1, 2),
    s AS (SELECT scene, r, [{'m': map, 'c': 1.0::DOUBLE, 's': 0.0::DOUBLE, 'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE}] AS joined, map, 'target' AS state FROM o WHERE r = 1
      UNION ALL SELECT s.scene, s.r + 1, CASE WHEN y.state = 'joined' THEN list_append(s.joined, {'m': o.map, 'c': z.j.c * y.b.c + z.j.s * y.b.ns, 's': z.j.s * y.b.c - z.j.c * y.b.ns, 'x': z.j.c * y.b.x - z.j.s * y.b.y + z.j.x, 'y': z.j.s * y.b.x + z.j.c * y.b.y + z.j.y}) ELSE s.joined END, o.map, y.state
      FROM s JOIN o ON o.scene = s.scene AND o.r = s.r + 1 LEFT JOIN l ON l.scene = o.scene AND l.late = o.r,
      LATERAL (SELECT list_filter(coalesce(l.ev, []), lambda v: list_contains(list_transform(s.joined, lambda j: j.m), v.e)) AS ev) w,
      LATERAL (SELECT CASE WHEN coalesce(list_sum(list_transform(w.ev, lambda v: v.sup)), 0) < 1 THEN 'unsupported' WHEN list_sum(list_transform(w.ev, lambda v: v.conflicts)) = 0 AND list_sum(list_transform(w.ev, lambda v: v.free)) <= 0.052::DOUBLE * list_sum(list_transform(w.ev, lambda v: v.n)) THEN 'joined' ELSE 'conflict' END AS state,
        list_min(list_transform(list_filter(w.ev, lambda v: v.b IS NOT NULL), lambda v: v.b)) AS b) y,
      LATERAL (SELECT list_filter(s.joined, lambda j: j.m = y.b.e)[1] AS j) z),
    f AS (SELECT scene, unnest(joined) AS j FROM s QUALIFY r = max(r) OVER (PARTITION BY scene))
    SELECT s.scene, s.map, state, round(f.j.c, 6)::DOUBLE AS cosine, round(f.j.x, 6)::DOUBLE AS x, round(f.j.y, 6)::DOUBLE AS y FROM s LEFT JOIN f ON f.scene = s.scene AND f.j.m = s.map
    UNION ALL SELECT scene, map, 'rejected', NULL, NULL, NULL FROM m WHERE NOT accepted""")
def merge_maps(spark, d):
    """A scene for each supplier, its maps from parts, its bridges from line items."""
    rows = io.table(spark, d, "lineitem").withColumns({"scene": F.col("l_suppkey"), "map": F.col("l_partkey") % 12})
    maps = rows.groupBy("scene", "map").agg(F.count(F.lit(1)).alias("size"), (F.sum("l_quantity").cast("long") % 7 != 0).alias("accepted"))
    a, zero = F.radians("l_quantity"), F.lit(0.0)
    pose = F.array(F.cos(a), -F.sin(a), zero, F.col("l_discount").cast("double"), F.sin(a), F.cos(a), zero, F.col("l_tax").cast("double"), zero, zero, F.lit(1.0), zero, zero, zero, zero, F.lit(1.0))
    told = {"tested": F.lit(100), "free": F.round(F.col("l_discount") * 100).cast("long"), "conflicts": ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 401 == 0).cast("long"), "supports": (F.col("l_returnflag") == "R").cast("long")}
    evidence = rows.select("scene", F.col("map").alias("src"), (F.col("l_orderkey") % 12).alias("dst"), *(c.alias(n) for n, c in told.items()), pose.alias("pose"))
    w = F.col("world")
    return _r(merging.merge_maps(maps, evidence, most=0.052).select("scene", "map", "state", w[0].alias("cosine"), w[3].alias("x"), w[7].alias("y")), "cosine", "x", "y")


@query("frontier_search", """WITH RECURSIVE c AS (SELECT l_suppkey AS scene, l_partkey % 9 AS src, l_orderkey % 9 AS dst, min(l_extendedprice)::DOUBLE AS distance, max(l_quantity) >= 49 AS verified FROM lineitem GROUP BY 1, 2, 3),
    s AS (SELECT s_suppkey AS scene, 0 AS number, [0::BIGINT] AS reached, (SELECT list({'d': distance, 's': src, 't': dst, 'v': verified} ORDER BY distance, src, dst) FROM c WHERE scene = s_suppkey AND src <> dst) AS open_, NULL::STRUCT(d DOUBLE, s BIGINT, t BIGINT, v BOOLEAN) AS pick, false AS joins FROM supplier
      UNION ALL SELECT s.scene, s.number + 1, CASE WHEN y.joins THEN list_append(s.reached, CASE WHEN list_contains(s.reached, x.pick.s) THEN x.pick.t ELSE x.pick.s END) ELSE s.reached END, list_filter(s.open_, lambda p: p.s <> x.pick.s OR p.t <> x.pick.t), x.pick, y.joins FROM s,
      LATERAL (SELECT coalesce(list_filter(s.open_, lambda p: list_contains(s.reached, p.s) <> list_contains(s.reached, p.t))[1], list_filter(s.open_, lambda p: list_contains(s.reached, p.s) AND list_contains(s.reached, p.t))[1]) AS pick) x,
      LATERAL (SELECT x.pick.v AND list_contains(s.reached, x.pick.s) <> list_contains(s.reached, x.pick.t) AS joins) y WHERE x.pick IS NOT NULL AND s.number < 24)
    SELECT c.scene, c.src, c.dst, s.number, coalesce(s.joins, false) AS joins FROM c LEFT JOIN s ON s.scene = c.scene AND s.pick.s = c.src AND s.pick.t = c.dst""")
def frontier_search(spark, d):
    rows = io.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("scene"), (F.col("l_partkey") % 9).alias("src"), (F.col("l_orderkey") % 9).alias("dst"))
    pairs = rows.agg(F.min("l_extendedprice").cast("double").alias("distance"), (F.max("l_quantity") >= 49).alias("verified"))
    roots = io.table(spark, d, "supplier").select(F.col("s_suppkey").alias("scene"), F.lit(0).cast("long").alias("id"))
    return merging.frontier_search(pairs, roots, budget=24)


_PLANES = """p AS (SELECT l_suppkey AS scene, l_orderkey % 12 AS node, l_partkey % 3 AS plane, radians(60.0::DOUBLE * (l_partkey % 3) + 0.6::DOUBLE * (avg(l_quantity) - 25)) AS a, round(0.2::DOUBLE + 0.5::DOUBLE * (l_partkey % 3) + 4.0::DOUBLE * avg(l_discount), 6) AS d FROM lineitem GROUP BY 1, 2, 3),
    o AS (SELECT scene, node, plane, round(cos(a), 9) AS nx, round(sin(a), 9) AS ny, d, row_number() OVER (PARTITION BY scene ORDER BY node, plane) AS r FROM p),
    s AS (SELECT scene, r, [{'sd': d, 'm': [{'x': nx, 'y': ny, 'd': d}], 'n': node, 'p': plane}] AS groups, node AS lead_node, plane AS lead_plane FROM o WHERE r = 1
      UNION ALL SELECT s.scene, s.r + 1, CASE WHEN y.g IS NULL THEN list_append(s.groups, {'sd': o.d, 'm': [{'x': o.nx, 'y': o.ny, 'd': o.d}], 'n': o.node, 'p': o.plane}) ELSE list_transform(s.groups, lambda v, k: CASE WHEN k = y.g THEN {'sd': v.sd + o.d, 'm': list_append(v.m, {'x': o.nx, 'y': o.ny, 'd': o.d}), 'n': v.n, 'p': v.p} ELSE v END) END,
      CASE WHEN y.g IS NULL THEN o.node ELSE s.groups[y.g].n END, CASE WHEN y.g IS NULL THEN o.plane ELSE s.groups[y.g].p END
      FROM s JOIN o ON o.scene = s.scene AND o.r = s.r + 1,
      LATERAL (SELECT list_filter(range(1, len(s.groups) + 1), lambda g: len(list_filter(s.groups[g].m, lambda v: abs(v.d - o.d) >= 0.15::DOUBLE OR v.x * o.nx + v.y * o.ny <= cos(radians(12.0::DOUBLE)))) = 0) AS near) x,
      LATERAL (SELECT list_min(list_transform(x.near, lambda g: {'a': abs(o.d - s.groups[g].sd / len(s.groups[g].m)), 'g': g})).g AS g) y)"""


def _planes(spark, d):
    rows = io.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("scene"), (F.col("l_orderkey") % 12).alias("node"), (F.col("l_partkey") % 3).alias("plane"))
    own = rows.agg(F.avg("l_quantity").cast("double").alias("q"), F.avg("l_discount").cast("double").alias("f"))
    a = F.radians(60.0 * F.col("plane") + 0.6 * (F.col("q") - 25))
    return own.select("scene", "node", "plane", F.round(F.cos(a), 9).alias("nx"), F.round(F.sin(a), 9).alias("ny"), F.lit(0.0).alias("nz"), F.round(0.2 + 0.5 * F.col("plane") + 4.0 * F.col("f"), 6).alias("d"))


@query("plane_groups", f"WITH RECURSIVE {_PLANES} SELECT o.scene, o.node, o.plane, lead_node, lead_plane FROM o JOIN s USING (scene, r)")
def plane_groups(spark, d):
    return merging.plane_groups(_planes(spark, d)).select("scene", "node", "plane", "lead_node", "lead_plane")


@query("joint_planes", f"WITH RECURSIVE {_PLANES}, g AS (SELECT o.scene, lead_node, lead_plane, count(DISTINCT node) AS nodes, avg(nx) AS x, avg(ny) AS y, avg(d) AS d, max(node) - min(node) AS span FROM o JOIN s USING (scene, r) GROUP BY 1, 2, 3) SELECT scene, lead_node, lead_plane, nodes, round(x / sqrt(x * x + y * y), 6)::DOUBLE AS nx, round(y / sqrt(x * x + y * y), 6)::DOUBLE AS ny, round(d, 9)::DOUBLE AS d FROM g WHERE nodes >= 3 AND span > 3")
def joint_planes(spark, d):
    return _r(_r(merging.joint_planes(merging.plane_groups(_planes(spark, d))).drop("nz"), "nx", "ny"), "d", places=9)


@query("mark_motion", """WITH m AS (SELECT l_suppkey AS pair, l_partkey % 12 AS mark, CAST(sum(l_quantity) AS BIGINT) % 10 < l_suppkey % 5 AS moved FROM lineitem GROUP BY 1, 2, l_suppkey),
    p AS (SELECT pair, count(*) AS matched, count(*) FILTER (NOT moved) AS inliers FROM m GROUP BY 1)
    SELECT pair, matched, inliers, round(cos(radians(pair % 7)), 6)::DOUBLE AS cosine, round(0.01::DOUBLE * (pair % 9), 6)::DOUBLE AS x FROM p WHERE inliers >= 0.65::DOUBLE * matched""")
def mark_motion(spark, d):
    """Marks at places that line items give, some of them moved between the views; the SQL knows which."""
    own = io.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("pair"), (F.col("l_partkey") % 12).alias("mark"))
    own = own.agg(F.sum("l_quantity").cast("long").alias("n"), *(F.avg(c).cast("double").alias(c) for c in ("l_quantity", "l_discount", "l_tax")))
    moved = F.when(F.col("n") % 10 < F.col("pair") % 5, 0.2 + 0.03 * F.col("mark")).otherwise(0.0)
    own = own.select("pair", "mark", moved.alias("_s"), (F.col("l_quantity") / 40).alias("x"), (F.col("l_discount") * 6).alias("y"), (1.5 + F.col("l_tax") * 5).alias("z"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("corner"))
    east = F.when(F.col("corner").isin(0, 3), -0.04).otherwise(0.04)
    north = F.when(F.col("corner") < 2, -0.04).otherwise(0.04)
    own = own.withColumns({"px": F.col("x") + east, "py": F.col("y") + north, "pz": F.col("z")})
    a = F.radians((F.col("pair") % 7).cast("double"))
    own = own.withColumns({"qx": F.cos(a) * F.col("px") - F.sin(a) * F.col("py") + 0.01 * (F.col("pair") % 9) + F.col("_s"), "qy": F.sin(a) * F.col("px") + F.cos(a) * F.col("py"), "qz": F.col("pz") + F.col("_s")})
    seen = {f"{s}{t}": 500 * F.col(f"{s}{v}") / F.col(f"{s}z") + 320 for s in "pq" for t, v in (("u", "x"), ("v", "y"))}
    found = consensus.mark_motion(own.withColumns(seen), (500.0, 500.0, 320.0, 320.0))
    w = F.col("pose")
    return _r(found.select("pair", "matched", "inliers", w[0].alias("cosine"), w[3].alias("x")), "cosine", "x")
