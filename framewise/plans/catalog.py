"""Queries over the driver tables, each with DuckDB SQL where SQL can express it.

Constants are scaled to these tables (gaps of hours, not milliseconds).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import cell, observation_weight, wrap_delta
from ..operators import asof, dedup, graph, knn, pairing, robust, sampling, score, select, sequence, stencil, voxel
from ..sources import io
from ..streaming import jobs
from . import catalog_state as state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) for c in columns})


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events with t in seconds."""
    return io.table(spark, d, "events").withColumn("t", io.seconds("ts"))


E_ = "WITH e AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"


@query(
    "voxel_downsample",
    """SELECT CAST(floor(l_quantity / 10.0::DOUBLE) AS BIGINT) AS i_l_quantity, CAST(floor(l_extendedprice / 10000.0::DOUBLE) AS BIGINT) AS i_l_extendedprice,
    round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, round(avg(l_discount), 6) AS l_discount, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def voxel_downsample(spark, d):
    out = voxel.downsample(io.table(spark, d, "lineitem"), {"l_quantity": 10.0, "l_extendedprice": 10000.0}, ("l_discount",))
    return _r(_r(out, "l_quantity", "l_discount"), "l_extendedprice", places=4)


@query("voxel_occupied", "SELECT DISTINCT CAST(floor(l_quantity / 5.0::DOUBLE) AS BIGINT) AS i_l_quantity, CAST(floor(l_extendedprice / 5000.0::DOUBLE) AS BIGINT) AS i_l_extendedprice FROM lineitem")
def voxel_occupied(spark, d):
    return voxel.occupied(io.table(spark, d, "lineitem"), {"l_quantity": 5.0, "l_extendedprice": 5000.0})


@query(
    "weighted_fold",
    """SELECT CAST(floor(l_quantity / 10.0::DOUBLE) AS BIGINT) AS qx, CAST(floor(l_extendedprice / 10000.0::DOUBLE) AS BIGINT) AS px,
    round(sum((1 - l_discount) * least((l_tax - 0.03::DOUBLE) / 0.02::DOUBLE, 1.0::DOUBLE)) / sum(1 - l_discount), 6) AS tsdf, round(sum(1 - l_discount), 6) AS w, count(*) AS n,
    round(sum((1 - l_discount) * l_quantity) / sum(1 - l_discount), 6) AS colour FROM lineitem WHERE l_tax - 0.03::DOUBLE >= -0.02::DOUBLE GROUP BY 1, 2""",
)
def weighted_fold(spark, d):
    rows = io.table(spark, d, "lineitem")
    out = voxel.weighted_fold(rows, [cell(F.col("l_quantity"), 10).alias("qx"), cell(F.col("l_extendedprice"), 10000).alias("px")], F.col("l_tax") - 0.03, 1 - F.col("l_discount"), 0.02, {"colour": F.col("l_quantity")})
    return _r(out, "tsdf", "w", "colour")


@query("observation_statistics", "SELECT l_returnflag, round(avg(l_discount), 6) AS mean_weight, round(count(*) FILTER (l_discount <= 0)::DOUBLE / count(l_discount), 6) AS rejected FROM lineitem GROUP BY 1")
def observation_statistics(spark, d):
    return _r(voxel.observation_statistics(io.table(spark, d, "lineitem"), ["l_returnflag"], "l_discount"), "mean_weight", "rejected")


@query(
    "interval_stats",
    E_ + """, g AS (SELECT user_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e)
    SELECT user_id, count(*) AS n, round(max(t) - min(t), 6) AS span, count(*) FILTER (gap > 50000) AS n_gaps, count(*) FILTER (gap <= 0) AS n_not_positive,
    CASE WHEN max(t) > min(t) THEN round((count(*) - 1) / (max(t) - min(t)), 12) END AS rate FROM g GROUP BY 1""",
)
def interval_stats(spark, d):
    return _r(_r(sequence.interval_stats(_events(spark, d), ("user_id",), 50000.0, ties=("event_id",)), "span"), "rate", places=12)


@query(
    "adaptive_gap_segments",
    E_ + """, g AS (SELECT user_id, event_id, t, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e),
    l AS (SELECT user_id, CASE WHEN count(*) FILTER (gap > 0) >= 4 THEN greatest(7200.0::DOUBLE, 3 * quantile_cont(gap, 0.5) FILTER (gap > 0)) ELSE 7200.0::DOUBLE END AS lim FROM g GROUP BY 1),
    s AS (SELECT user_id, t, sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS segment FROM g JOIN l USING (user_id))
    SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, round(min(t), 6) AS start, round(max(t), 6) AS "end" FROM s GROUP BY 1, 2""",
)
def adaptive_gap_segments(spark, d):
    cut = sequence.adaptive_segments(_events(spark, d), ("user_id",), floor=7200.0, ties=("event_id",))
    return _r(cut.groupBy("user_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("start"), F.max("t").alias("end")), "start", "end")


@query(
    "asof_nearest",
    E_ + """, p AS (SELECT event_id, t FROM e WHERE event_type = 'view'), r AS (SELECT event_id, t FROM e WHERE event_type = 'error'),
    m AS (SELECT p.event_id, r.event_id AS ref_event_id, abs(p.t - r.t) AS delta, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(p.t - r.t), r.t, r.event_id) AS rn FROM p JOIN r ON abs(p.t - r.t) <= 1800)
    SELECT event_id, ref_event_id, round(delta, 6) AS delta FROM m WHERE rn = 1""",
)
def asof_nearest(spark, d):
    e = _events(spark, d)
    probe, ref = (e.where(F.col("event_type") == k).select("event_id", "t") for k in ("view", "error"))
    out = asof.asof_nearest(probe, ref, 1800.0)
    return _r(out.select("event_id", "ref_event_id", F.abs(F.col("t") - F.col("ref_t")).alias("delta")), "delta")


@query(
    "asof_backward",
    E_ + """, p AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'purchase'), r AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'click')
    SELECT p.event_id, p.user_id, r.event_id AS ref_event_id, round(p.t - r.t, 6) AS age FROM p ASOF LEFT JOIN r ON p.user_id = r.user_id AND p.t >= r.t""",
)
def asof_backward(spark, d):
    e = _events(spark, d)
    probe, ref = (e.where(F.col("event_type") == k).select("event_id", "user_id", "t") for k in ("purchase", "click"))
    out = asof.asof_backward(probe, ref, ("user_id",), 86400.0)
    return _r(out.select("event_id", "user_id", "ref_event_id", (F.col("t") - F.col("ref_t")).alias("age")), "age")


@query(
    "mode_in_force",
    E_ + """, p AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'error'), r AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'signup')
    SELECT p.event_id, r.event_id AS ref_event_id FROM p ASOF JOIN r ON p.user_id = r.user_id AND p.t >= r.t WHERE p.t - r.t <= 259200""",
)
def mode_in_force(spark, d):
    e = _events(spark, d)
    probe, ref = (e.where(F.col("event_type") == k).select("event_id", "user_id", "t") for k in ("error", "signup"))
    return asof.asof_backward(probe, ref, ("user_id",), 86400.0, max_age=259200.0, how="inner").select("event_id", "ref_event_id")


@query(
    "range_join_count",
    E_ + """, p AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'view'), r AS (SELECT user_id, t FROM e WHERE event_type = 'error')
    SELECT p.event_id, p.user_id, count(r.t) AS n_near FROM p LEFT JOIN r ON p.user_id = r.user_id AND abs(p.t - r.t) <= 43200 GROUP BY 1, 2""",
)
def range_join_count(spark, d):
    e = _events(spark, d)
    probe, ref = e.where("event_type = 'view'").select("event_id", "user_id", "t"), e.where("event_type = 'error'").select("user_id", "t")
    return asof.count_in_range(probe, ref, 43200.0, ("user_id",), "event_id").select("event_id", "user_id", "n_near")


@query("distribution", "SELECT event_type, count(value) AS n, round(min(value), 6) AS min, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS max FROM events GROUP BY 1")
def distribution(spark, d):
    return _r(robust.distribution(io.table(spark, d, "events"), ["event_type"], "value"), "min", "median", "mean", "p90", "p95", "max")


def _halves(spark, d):
    rows = io.table(spark, d, "embeddings").select("vec_id", "embedding")
    return rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1")


_PAIRS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_distance(a.e, b.e), 6) AS dist FROM v a, v b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
f AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY dist, b_id) AS rn, lead(dist) OVER (PARTITION BY a_id ORDER BY dist, b_id) AS nxt FROM p),
g AS (SELECT *, row_number() OVER (PARTITION BY b_id ORDER BY dist, a_id) AS rn, lead(dist) OVER (PARTITION BY b_id ORDER BY dist, a_id) AS nxt FROM p)"""


@query("mutual_knn_ratio", _PAIRS + " SELECT a_id, b_id, f.dist AS distance FROM f JOIN g USING (a_id, b_id) WHERE f.rn = 1 AND g.rn = 1 AND f.dist < 0.95 * f.nxt AND g.dist < 0.95 * g.nxt")
def mutual_knn_ratio(spark, d):
    return knn.mutual_ratio(*_halves(spark, d), "vec_id", "embedding", 0.95)


@query("mutual_nn", _PAIRS + " SELECT a_id, b_id, f.dist AS distance FROM f JOIN g USING (a_id, b_id) WHERE f.rn = 1 AND g.rn = 1")
def mutual_nn(spark, d):
    return knn.mutual_nearest(*_halves(spark, d), "vec_id", "embedding")


@query(
    "reciprocal_shortlist",
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_distance(a.e, b.e), 6) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS rn FROM p) WHERE rn <= 12),
    m AS (SELECT x.a, x.b, x.dist, row_number() OVER (PARTITION BY x.a ORDER BY x.dist, x.b) AS rn FROM n x JOIN n y ON x.a = y.b AND x.b = y.a)
    SELECT DISTINCT least(a, b) AS i, greatest(a, b) AS j, dist AS distance FROM m WHERE rn <= 3""",
)
def reciprocal_shortlist(spark, d):
    return knn.reciprocal_shortlist(io.table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")


def _binned(spark, d):
    rows = io.table(spark, d, "embeddings")
    return rows.select("vec_id", *(cell(F.col("embedding")[k].cast("double"), 0.05).alias(f"q{k}") for k in range(4)))


@query(
    "quantised_bin_join",
    """WITH q AS (SELECT vec_id, CAST(floor(embedding[1]::DOUBLE / 0.05::DOUBLE) AS BIGINT) AS q0, CAST(floor(embedding[2]::DOUBLE / 0.05::DOUBLE) AS BIGINT) AS q1, CAST(floor(embedding[3]::DOUBLE / 0.05::DOUBLE) AS BIGINT) AS q2, CAST(floor(embedding[4]::DOUBLE / 0.05::DOUBLE) AS BIGINT) AS q3 FROM embeddings),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q0, q1, q2, q3 ORDER BY vec_id) AS rn FROM q WHERE vec_id % 2 = 1) WHERE rn <= 6)
    SELECT a.vec_id AS a_id, b.vec_id AS b_id FROM q a JOIN b ON abs(a.q0 - b.q0) <= 1 AND abs(a.q1 - b.q1) <= 1 AND abs(a.q2 - b.q2) <= 1 AND abs(a.q3 - b.q3) <= 1 WHERE a.vec_id % 2 = 0""",
)
def quantised_bin_join(spark, d):
    rows = _binned(spark, d)
    return knn.bin_join(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), ["q0", "q1", "q2", "q3"], "vec_id")


@query(
    "radius_nearest",
    """WITH p AS (SELECT p_partkey AS id, p_size::DOUBLE AS x, p_retailprice / 10 AS y FROM part),
    m AS (SELECT a.id AS a_id, b.id AS b_id, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM p a JOIN p b ON a.id % 2 = 0 AND b.id % 2 = 1 AND abs(a.x - b.x) < 3 AND abs(a.y - b.y) < 3)
    SELECT a_id, arg_min(b_id, (round(dist, 9), b_id)) AS b_id, round(min(dist), 6) AS distance FROM m WHERE dist < 3 GROUP BY 1""",
)
def radius_nearest(spark, d):
    p = io.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), (F.col("p_retailprice") / 10).alias("y"))
    return _r(knn.radius_nearest(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ("x", "y"), 3.0, "id"), "distance")


@query("stage_summary", "WITH s AS (SELECT event_type, sum(value) AS total, count(value) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1) SELECT event_type, round(total, 6) AS total, n, round(p50, 6) AS p50, round(p95, 6) AS p95, round(total / sum(total) OVER (), 6) AS share FROM s")
def stage_summary(spark, d):
    return _r(robust.stage_summary(io.table(spark, d, "events"), "event_type", "value"), "total", "p50", "p95", "share")


@query(
    "capped_rmse",
    """WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS total FROM lineitem GROUP BY 1),
    j AS (SELECT o_orderpriority AS view, total - o_totalprice AS err FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
    SELECT view, count(*) AS n, count(err) AS hits, round(coalesce(avg(CASE WHEN err IS NULL THEN NULL WHEN abs(err) <= 50000 THEN 1.0 ELSE 0.0 END), 0), 6)::DOUBLE AS "precision",
    round(avg(CASE WHEN abs(err) <= 50000 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS completeness, round(sqrt(avg(pow(coalesce(least(abs(err), 100000.0::DOUBLE), 100000.0::DOUBLE), 2))), 4) AS rmse FROM j GROUP BY 1""",
)
def capped_rmse(spark, d):
    totals = io.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("o_totalprice"))
    orders = io.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderpriority").alias("view"))
    out = score.view_metrics(orders, totals, ["o_orderkey"], "view", "o_totalprice", 50000.0, 100000.0)
    return _r(_r(out.drop("f_score"), "precision", "completeness"), "rmse", places=4)


@query("stratified_topk", "WITH r AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1 AS turn FROM events) SELECT event_id, event_type, round(value, 6) AS value, CAST(turn AS BIGINT) AS turn FROM r ORDER BY turn, event_type LIMIT 23")
def stratified_topk(spark, d):
    out = sampling.stratified_top_k(io.table(spark, d, "events").select("event_id", "event_type", "value"), "event_type", [F.desc("value"), F.col("event_id")], 23)
    return _r(out.withColumn("turn", F.col("turn").cast("long")), "value")


@query(
    "ema_asymmetric",
    """WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    s AS (SELECT user_id, rn, value AS a FROM r WHERE rn = 1 UNION ALL SELECT r.user_id, r.rn, CASE WHEN s.a = 0 THEN r.value ELSE s.a + (CASE WHEN r.value > s.a THEN 0.5::DOUBLE ELSE 0.1::DOUBLE END) * (r.value - s.a) END FROM s JOIN r ON r.user_id = s.user_id AND r.rn = s.rn + 1)
    SELECT user_id, max(rn) AS n, round(arg_max(a, rn), 6) AS smoothed FROM s GROUP BY 1""",
)
def ema_asymmetric(spark, d):
    return _r(sequence.asymmetric_ema(io.table(spark, d, "events"), ("user_id",), "value", ("ts", "event_id")), "smoothed")


@query(
    "clock_unwrap",
    """WITH k AS (SELECT event_id, user_id, ts, ((epoch_us(ts) // 1000) % 4294967296 + 4294967296) % 4294967296 AS tick FROM events),
    g AS (SELECT *, tick - lag(tick) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS raw FROM k),
    u AS (SELECT event_id, user_id, ts, CASE WHEN raw IS NULL THEN 0 ELSE (((raw + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648 END AS delta FROM g)
    SELECT event_id, round(sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE / 1000, 6) AS elapsed_s FROM u""",
)
def clock_unwrap(spark, d):
    e = io.table(spark, d, "events").withColumn("tick", F.pmod(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(1 << 32))).withColumn("arrival", F.struct("ts", "event_id"))
    return _r(sequence.unwrap_clock(e, ("user_id",), "tick", "arrival", 1000.0).select("event_id", "elapsed_s"), "elapsed_s")


@query("rolling_min_offset", "SELECT event_id, round(min(value) OVER w, 6) AS \"offset\", round(max(value) OVER w - min(value) OVER w, 6) AS spread, round(avg(value) OVER v, 6) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 127 PRECEDING), v AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 11 PRECEDING)")
def rolling_min_offset(spark, d):
    e = io.table(spark, d, "events").withColumn("arrival", F.struct("ts", "event_id"))
    out = sequence.rolling_mean(sequence.rolling_offset(e, ("user_id",), "value", "arrival"), ("user_id",), "value", "arrival")
    return _r(out.select("event_id", "offset", "spread", "mean"), "offset", "spread", "mean")


@query("travel_distance", "WITH s AS (SELECT event_id, user_id, ts, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 0) AS step FROM events) SELECT event_id, round(step, 6) AS step, round(sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 5) AS travelled FROM s")
def travel_distance(spark, d):
    out = sequence.travel_distance(io.table(spark, d, "events"), ("user_id",), ("value",), ("ts", "event_id")).select("event_id", "step", "travelled")
    return _r(_r(out, "step"), "travelled", places=5)


@query(
    "loss_episodes",
    """WITH f AS (SELECT *, event_type = 'error' AS failed FROM events),
    s AS (SELECT *, (failed AND NOT coalesce(lag(failed) OVER w, false))::INT AS first_, sum((NOT failed)::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS good FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT event_id, failed, sum(first_) OVER (w ROWS UNBOUNDED PRECEDING) AS episode, last_value(CASE WHEN NOT failed THEN event_id END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS last_good,
      CASE WHEN failed THEN sum(failed::INT) OVER (PARTITION BY user_id, good ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS consecutive FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, failed, episode::BIGINT AS episode, consecutive::BIGINT AS consecutive, last_good, failed AND (consecutive <= 3 OR consecutive % 4 = 0) AS probe FROM c""",
)
def loss_episodes(spark, d):
    out = sequence.loss_episodes(io.table(spark, d, "events"), ("user_id",), F.col("event_type") == "error", ("ts", "event_id"), "event_id")
    return out.select("event_id", "failed", F.col("episode").cast("long").alias("episode"), F.col("consecutive").cast("long").alias("consecutive"), "last_good", "probe")


@query(
    "parity_split_rmse",
    "WITH r AS (SELECT l_suppkey, l_tax - l_discount AS err, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_tax, l_discount) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, CASE WHEN n >= 5 THEN rn % 5 = 0 ELSE rn = n END AS held_out, count(*) AS n, round(sqrt(avg(err * err)), 6) AS rmse FROM r GROUP BY 1, 2",
)
def parity_split_rmse(spark, d):
    cut = sampling.hold_out(io.table(spark, d, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount"])
    return _r(cut.groupBy("l_suppkey", "held_out").agg(F.count(F.lit(1)).alias("n"), robust.rmse(F.col("l_tax") - F.col("l_discount")).alias("rmse")), "rmse")


@query("linspace_sample", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders), k AS (SELECT DISTINCT floor(k * (n - 1) / 199.0::DOUBLE)::BIGINT AS at_ FROM (SELECT max(n) AS n FROM r), range(200) t(k)) SELECT o_orderkey, rn FROM r JOIN k ON rn - 1 = at_")
def linspace_sample(spark, d):
    return sampling.linspace(io.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 200).select("o_orderkey", F.col("rn").cast("long").alias("rn"))


@query("every_kth", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, count(*) OVER () AS n FROM orders) SELECT o_orderkey FROM r WHERE (rn - 1) % CAST(ceil(n / 700.0::DOUBLE) AS BIGINT) = 0")
def every_kth(spark, d):
    return sampling.every_kth(io.table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 700).select("o_orderkey")


@query("ends_of_history", "WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS up, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS down FROM events) SELECT user_id, event_id FROM r WHERE up <= 2 OR down <= 6")
def ends_of_history(spark, d):
    return sampling.ends(io.table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("best_per_run", "WITH r AS (SELECT user_id, event_id, value, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) SELECT user_id, run::INT AS run, arg_max(event_id, (value, event_id)) AS event_id, round(max(value), 6) AS value FROM r GROUP BY 1, 2")
def best_per_run(spark, d):
    rows = io.table(spark, d, "events").select("user_id", "value", "event_id", F.struct("ts", "event_id").alias("at"))
    return _r(sampling.best_per_run(rows, ["user_id"], ["at"], "value", 4).select("user_id", "run", "event_id", "value"), "value")


@query("vote_cells", "SELECT CAST(floor(l_quantity / 7.0::DOUBLE) AS BIGINT) AS cx, CAST(floor(l_extendedprice / 9000.0::DOUBLE) AS BIGINT) AS cy, count(*) AS votes, min(l_orderkey) AS first_index FROM lineitem GROUP BY 1, 2 ORDER BY 3 DESC, 4 LIMIT 12")
def vote_cells(spark, d):
    return robust.vote_cells(io.table(spark, d, "lineitem"), [cell(F.col("l_quantity"), 7), cell(F.col("l_extendedprice"), 9000)], ["cx", "cy"], "l_orderkey")


@query("best_view_argmax", "SELECT l_partkey, arg_min(l_suppkey, (-l_quantity, l_suppkey)) AS l_suppkey, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
def best_view_argmax(spark, d):
    return robust.argmax(io.table(spark, d, "lineitem"), ["l_partkey"], "l_suppkey", "l_quantity")


@query("first_wins_dedup", "SELECT md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def first_wins_dedup(spark, d):
    return dedup.first_wins(io.table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), "doc_id"), ["digest"], ["doc_id"])


@query("upsert_last_wins", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def upsert_last_wins(spark, d):
    return dedup.last_wins(io.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query(
    "upload_receipts",
    """WITH r AS (SELECT event_id, user_id, event_id % 40 AS sequence, event_type AS digest FROM events), f AS (SELECT user_id, sequence, min(event_id) AS first_id, arg_min(digest, event_id) AS first_digest FROM r GROUP BY 1, 2)
    SELECT event_id, CASE WHEN event_id = first_id THEN 'stored' WHEN digest = first_digest THEN 'replayed' ELSE 'conflict' END AS status FROM r JOIN f USING (user_id, sequence)""",
)
def upload_receipts(spark, d):
    r = io.table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 40).alias("sequence"), F.col("event_type").alias("digest"))
    return dedup.receipts(r, "user_id", "sequence", "digest", "event_id").select("event_id", "status")


@query(
    "quarantine_repeated",
    """WITH k AS (SELECT event_id, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(ts AS DATE) AS day FROM events), bad AS (SELECT DISTINCT user_id, k FROM k GROUP BY user_id, k, day HAVING count(*) > 1)
    SELECT event_id, user_id, k FROM k WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.user_id = k.user_id AND bad.k = k.k)""",
)
def quarantine_repeated(spark, d):
    rows = io.table(spark, d, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_date("ts").alias("day"))
    return dedup.quarantine(rows, ["user_id", "k"], ["day"]).select("event_id", "user_id", "k")


@query("member_audit", "SELECT u IS NOT NULL AS used, count(*) AS members, round(sum(o_totalprice), 2) AS size FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS u FROM lineitem WHERE l_returnflag = 'R') ON u = o_orderkey GROUP BY 1")
def member_audit(spark, d):
    used = io.table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return _r(dedup.member_audit(io.table(spark, d, "orders"), used, "o_orderkey", F.col("o_totalprice")), "size", places=2)


@query("set_difference", "SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def set_difference(spark, d):
    return io.table(spark, d, "orders").select("o_orderkey").subtract(io.table(spark, d, "lineitem").select("l_orderkey"))


@query(
    "reason_cascade",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 20000 THEN 'too small' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority LIKE '5%' THEN 'low priority' ELSE 'accepted' END AS reason,
    CASE WHEN o_orderpriority LIKE '1%' THEN 'first' WHEN o_orderpriority LIKE '2%' THEN 'second' ELSE 'other' END AS category FROM orders""",
)
def reason_cascade(spark, d):
    rules = [("too small", F.col("o_totalprice") < 20000), ("pending", F.col("o_orderstatus") == "P"), ("low priority", F.col("o_orderpriority").startswith("5"))]
    return io.table(spark, d, "orders").select("o_orderkey", score.first_reason(rules).alias("reason"), score.failure_category(F.col("o_orderpriority"), [("1", "first"), ("2", "second")]).alias("category"))


@query(
    "confidence_weight",
    """WITH p AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS z, (p_partkey % 11)::DOUBLE / 10 AS c FROM part)
    SELECT p_partkey, round(CASE WHEN c < 0.25 OR p_partkey % 7 = 0 THEN 0 ELSE least(greatest(pow(0.003::DOUBLE / (0.001::DOUBLE + 0.002::DOUBLE * z * z), 2), 0.05::DOUBLE), 1.0::DOUBLE) * c * c END, 6) AS weight FROM p""",
)
def confidence_weight(spark, d):
    z, c = F.col("p_size") / 10.0, (F.col("p_partkey") % 11).cast("double") / 10
    return _r(io.table(spark, d, "part").select("p_partkey", observation_weight(z, c, F.col("p_partkey") % 7 == 0).alias("weight")), "weight")


_GRID = "WITH g AS (SELECT l_suppkey % 40 AS x, l_partkey % 40 AS y, round(avg(l_extendedprice), 4) AS z FROM lineitem GROUP BY 1, 2)"


def _grid(spark, d):
    rows = io.table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 40).alias("x"), (F.col("l_partkey") % 40).alias("y")).agg(F.round(F.avg("l_extendedprice"), 4).alias("z"))
    return rows.withColumn("frame", F.lit(0))


@query(
    "stencil_support",
    _GRID + """, n AS (SELECT a.x, a.y, count(*) FILTER (b.z > 0 AND abs(b.z - a.z) <= greatest(1500.0::DOUBLE, a.z * 0.02::DOUBLE)) AS support, coalesce(bool_or(b.z > 0 AND abs(b.z - a.z) > greatest(3000.0::DOUBLE, a.z * 0.02::DOUBLE)), false) AS edge
    FROM g a LEFT JOIN g b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1, 2) SELECT x, y, support, support >= 2 AS supported, edge FROM n""",
)
def stencil_support(spark, d):
    g = _grid(spark, d)
    out = stencil.edge_flags(stencil.support_filter(g, ("frame",), "x", "y", "z", 2, 1500.0, 0.02), ("frame",), "x", "y", "z", 3000.0, 0.02)
    return out.select("x", "y", F.col("support").cast("long").alias("support"), "supported", "edge")


@query(
    "stable_samples",
    _GRID + """, n AS (SELECT a.x, a.y, a.z, list_sort(list(b.z)) AS zs FROM g a JOIN g b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY 1, 2, 3)
    SELECT x, y, zs[CAST(floor((len(zs) + 1) / 2) AS BIGINT)] AS median FROM n WHERE len(zs) >= 7 AND zs[len(zs)] - zs[1] <= greatest(9000.0::DOUBLE, 0.04::DOUBLE * zs[CAST(floor((len(zs) + 1) / 2) AS BIGINT)])""",
)
def stable_samples(spark, d):
    return stencil.stable_samples(_grid(spark, d), ("frame",), "x", "y", "z", 7, 9000.0, 0.04).select("x", "y", "median")


@query(
    "zbuffer_visible",
    "WITH m AS (SELECT *, min(l_extendedprice) OVER (PARTITION BY l_partkey) AS z_min FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, round(z_min, 4) AS z_min FROM m WHERE l_extendedprice <= z_min + greatest(500.0::DOUBLE, 0.1::DOUBLE * z_min)",
)
def zbuffer_visible(spark, d):
    out = stencil.z_buffer(io.table(spark, d, "lineitem"), ["l_partkey"], "l_extendedprice", 500.0, 0.1)
    return _r(out.select("l_orderkey", "l_linenumber", "l_partkey", "z_min"), "z_min", places=4)


@query(
    "median_mad_gate",
    "WITH r AS (SELECT l_suppkey, ln(l_extendedprice / l_quantity) AS v FROM lineitem), m AS (SELECT l_suppkey, median(v) AS m, count(v) AS n FROM r GROUP BY 1) SELECT l_suppkey, round(any_value(m), 6) AS median, any_value(n) AS n, round(median(abs(v - m)), 6) AS mad, median(abs(v - m)) <= 0.11 AND any_value(n) >= 10 AS accepted FROM r JOIN m USING (l_suppkey) GROUP BY 1",
)
def median_mad_gate(spark, d):
    rows = io.table(spark, d, "lineitem").select("l_suppkey", F.ln(F.col("l_extendedprice") / F.col("l_quantity")).alias("v"))
    return _r(robust.median_mad(rows, ["l_suppkey"], "v", 0.11, 10), "median", "mad")


@query(
    "speedup_vs_baseline",
    "WITH r AS (SELECT o_orderpriority, o_orderstatus, median(o_totalprice) AS m FROM orders GROUP BY 1, 2), v AS (SELECT o_orderpriority, median(m) AS m, count(*) AS runs FROM r GROUP BY 1) SELECT o_orderpriority, round(m, 4) AS median, runs, round((SELECT m FROM v WHERE o_orderpriority LIKE '1%') / m, 6) AS speedup FROM v",
)
def speedup_vs_baseline(spark, d):
    orders = io.table(spark, d, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    out = robust.baseline_speedup(orders, "o_orderpriority", "o_orderstatus", "o_totalprice", orders.where("o_orderpriority like '1%'").agg(F.min("o_orderpriority")).first()[0])
    return _r(_r(out, "median", places=4), "speedup")


@query("per_view_contribution", "WITH s AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), n AS (SELECT *, count(*) OVER (PARTITION BY l_partkey) AS views FROM s) SELECT l_suppkey, count(*) AS visible, count(*) FILTER (views = 1) AS only_here FROM n GROUP BY 1")
def per_view_contribution(spark, d):
    return score.contribution(io.table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


@query("change_only_events", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1 OR event_type IS DISTINCT FROM was")
def change_only_events(spark, d):
    return sequence.changes_only(io.table(spark, d, "events"), ("user_id",), ("event_type",), ("ts", "event_id")).select("event_id")


@query(
    "robust_bounds",
    """WITH b AS (SELECT p_brand, quantile_cont(p_size, 0.01) AS a, quantile_cont(p_size, 0.99) AS b, quantile_cont(p_retailprice, 0.01) AS c, quantile_cont(p_retailprice, 0.99) AS e FROM part GROUP BY 1)
    SELECT p_brand, round(a, 6) AS p_size_lo, round(b, 6) AS p_size_hi, round(c, 6) AS p_retailprice_lo, round(e, 6) AS p_retailprice_hi, round((a + b) / 2, 6) AS p_size_centre, round((c + e) / 2, 6) AS p_retailprice_centre, round(sqrt(pow(b - a, 2) + pow(e - c, 2)) / 2, 6) AS half_diagonal FROM b""",
)
def robust_bounds(spark, d):
    out = robust.bounds(io.table(spark, d, "part"), ["p_brand"], ["p_size", "p_retailprice"])
    return _r(out, *(c for c in out.columns if c != "p_brand"))


@query(
    "stationary_summary",
    E_ + """, m AS (SELECT user_id, value, t, avg(value) OVER (PARTITION BY user_id) AS m, ntile(3) OVER (PARTITION BY user_id ORDER BY t, event_id) AS block FROM e),
    b AS (SELECT user_id, max(x) - min(x) AS block_shift FROM (SELECT user_id, block, avg(value) AS x FROM m GROUP BY 1, 2) GROUP BY 1)
    SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(sqrt(avg(pow(value - m, 2))), 6) AS scatter, round(max(abs(value - m)), 6) AS peak, round(any_value(block_shift), 6) AS block_shift FROM m JOIN b USING (user_id) GROUP BY 1""",
)
def stationary_summary(spark, d):
    return _r(robust.stationary(_events(spark, d), ["user_id"], "value").drop("drift"), "mean", "scatter", "peak", "block_shift")


@query(
    "irls_consensus",
    """WITH r0 AS (SELECT l_suppkey AS k, l_discount AS v, least(l_quantity / greatest(max(l_quantity) OVER (PARTITION BY l_suppkey), 1e-8), 0.5::DOUBLE) AS w FROM lineitem)"""
    + "".join(
        f""", m{k} AS (SELECT *, sum({'w' if k == 1 else 'c'} * v) OVER (PARTITION BY k) / greatest(sum({'w' if k == 1 else 'c'}) OVER (PARTITION BY k), 1e-8) AS m FROM r{k - 1}), r{k} AS (SELECT k, v, w, w * least(1.0::DOUBLE, 0.035::DOUBLE / greatest(abs(v - m), 1e-8)) AS c FROM m{k})"""
        for k in range(1, 6)
    )
    + " SELECT k AS l_suppkey, round(max(m), 6) AS consensus, count(*) AS n FROM m5 GROUP BY 1",
)
def irls_consensus(spark, d):
    return _r(robust.irls_consensus(io.table(spark, d, "lineitem").select("l_suppkey", "l_discount", "l_quantity"), ["l_suppkey"], "l_discount", "l_quantity"), "consensus")


@query("covariance_condition", "SELECT l_returnflag, count(*) AS n, round(covar_pop(l_quantity, l_quantity), 4) AS cov_l_quantity_l_quantity, round(1000 + covar_pop(l_quantity, l_discount), 6) AS cov_l_quantity_l_discount, round(1000 + covar_pop(l_quantity, l_tax), 6) AS cov_l_quantity_l_tax, round(1000 + covar_pop(l_discount, l_discount), 6) AS cov_l_discount_l_discount, round(1000 + covar_pop(l_discount, l_tax), 6) AS cov_l_discount_l_tax, round(1000 + covar_pop(l_tax, l_tax), 6) AS cov_l_tax_l_tax FROM lineitem GROUP BY 1")
def covariance_condition(spark, d):
    out = robust.moments(io.table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount", "l_tax"])
    small = [c for c in out.columns if c.startswith("cov") and c != "cov_l_quantity_l_quantity"]
    shifted = out.withColumns({c: 1000 + F.col(c) for c in small})  # else a rounded -0.0 and 0.0 would differ
    return _r(_r(shifted, *small), "cov_l_quantity_l_quantity", places=4)


@query("normal_equations", "SELECT l_returnflag, round(sum(l_quantity * l_quantity), 2) AS jj_0_0, round(sum(l_quantity), 2) AS jj_0_1, round(count(*), 2)::DOUBLE AS jj_1_1, round(sum(l_quantity * l_discount), 4) AS jr_0, round(sum(l_discount), 4) AS jr_1 FROM lineitem GROUP BY 1")
def normal_equations(spark, d):
    out = robust.normal_equations(io.table(spark, d, "lineitem"), ["l_returnflag"], [F.col("l_quantity"), F.lit(1.0)], F.col("l_discount"))
    return _r(_r(out, "jj_0_0", "jj_0_1", "jj_1_1", places=2), "jr_0", "jr_1", places=4)


@query(
    "trajectory_score",
    """WITH o AS (SELECT user_id, value - first_value(value) OVER w AS dx, (event_id % 97)::DOUBLE - first_value((event_id % 97)::DOUBLE) OVER w AS dy FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, count(*) AS n, round(sqrt(avg(pow(dx - dy, 2))), 6) AS rmse FROM o GROUP BY 1""",
)
def trajectory_score(spark, d):
    rows = io.table(spark, d, "events").withColumn("truth", (F.col("event_id") % 97).cast("double"))
    return _r(score.trajectory_score(rows, ["user_id"], [("value", "truth")], ["ts", "event_id"]), "rmse")


@query("content_fingerprint", "WITH r AS (SELECT source, sha256(coalesce(doc_id::VARCHAR, '~') || '|' || coalesce(text, '~')) AS h FROM documents) SELECT source, sha256(concat_ws('-', " + ", ".join(f"sum(('0x' || substr(h, {15 * k + 1}, 15))::BIGINT)::VARCHAR" for k in range(4)) + ")) AS fingerprint, count(*) AS n FROM r GROUP BY 1")
def content_fingerprint(spark, d):
    return dedup.fingerprint(io.table(spark, d, "documents"), ["source"], [F.col("doc_id"), F.col("text")])


@query(
    "prefix_merge",
    """WITH j AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    a AS (SELECT user_id, s, value FROM j WHERE s * 3 <= n * 2), b AS (SELECT user_id, s, CASE WHEN user_id % 10 = 3 AND s = 1 THEN value + 1 ELSE value END AS value FROM j WHERE user_id % 2 = 1)
    SELECT coalesce(a.user_id, b.user_id) AS user_id, count(a.s) AS n_old, count(b.s) AS n_new, greatest(count(a.s), count(b.s)) AS n_merged, count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL AND a.value IS DISTINCT FROM b.value) > 0 AS conflict FROM a FULL JOIN b ON a.user_id = b.user_id AND a.s = b.s GROUP BY 1""",
)
def prefix_merge(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("user_id")
    j = io.table(spark, d, "events").select("user_id", "value", F.row_number().over(own.orderBy("ts", "event_id")).alias("s"), F.count(F.lit(1)).over(own).alias("n"))
    a = j.where("s * 3 <= n * 2").select("user_id", "s", "value")
    b = j.where("user_id % 2 = 1").select("user_id", "s", F.when((F.col("user_id") % 10 == 3) & (F.col("s") == 1), F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return dedup.prefix_merge(a, b, "user_id", "s", ["value"])


@query("bounded_history", E_ + """, w AS (SELECT event_id, user_id, t, count(*) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 86400.0::DOUBLE PRECEDING AND CURRENT ROW) AS n, lag(t, 4) OVER (PARTITION BY user_id ORDER BY t, event_id) AS oldest FROM e) SELECT event_id, least(n, 5) AS n_recent, round(greatest(t - 86400, coalesce(oldest, t - 86400)), 6) AS recent_from FROM w""")
def bounded_history(spark, d):
    return _r(sequence.bounded_history(_events(spark, d), ("user_id",), "t", 86400.0, 5).select("event_id", "n_recent", "recent_from"), "recent_from")


@query("low_recovered_events", "WITH m AS (SELECT *, value < 20 AS low, coalesce(lag(value < 20) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM events) SELECT event_id, CASE WHEN low THEN 'low' ELSE 'recovered' END AS event FROM m WHERE low <> was")
def low_recovered_events(spark, d):
    return score.edge_events(io.table(spark, d, "events"), ["user_id"], F.col("value") < 20, ["ts", "event_id"]).select("event_id", "event")


@query("lag_evidence", "SELECT event_type, round(quantile_cont(abs(value - 50), 0.95), 6) AS p95, count(*) FILTER (abs(value - 50) > 40) AS over, round(avg((value IS NOT NULL)::INT), 6)::DOUBLE AS known FROM events GROUP BY 1")
def lag_evidence(spark, d):
    rows = io.table(spark, d, "events").withColumn("lag", F.col("value") - 50)
    return _r(score.lag_evidence(rows, ["event_type"], "lag", 40.0), "p95", "known")


@query("ambiguity", "WITH b AS (SELECT l_partkey, max((l_quantity, l_tax)) AS b FROM lineitem GROUP BY 1) SELECT l_partkey, any_value(b[1]) AS best, any_value(b[2]) AS position, bool_or(l_quantity >= 0.85::DOUBLE * b[1] AND abs(l_tax - b[2]) > 0.05::DOUBLE) AS ambiguous FROM lineitem JOIN b USING (l_partkey) GROUP BY 1")
def ambiguity(spark, d):
    return graph.ambiguous(io.table(spark, d, "lineitem").select("l_partkey", "l_quantity", "l_tax"), "l_partkey", "l_quantity", "l_tax")


@query("delta_round_trip", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS value FROM lineitem")
def delta_round_trip(spark, d):
    rows = io.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    coded = io.delta_encode(rows, ["l_orderkey"], "l_linenumber", "q").drop("q")
    return io.delta_decode(coded, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber", "value")


@query("clock_delta_ms", "SELECT event_id, round(((((event_id * 7919000 - 4294000000 + 2147483648) % 4294967296) + 4294967296) % 4294967296 - 2147483648) / 60000.0::DOUBLE, 6) AS delta_ms FROM events")
def clock_delta_ms(spark, d):
    return _r(io.table(spark, d, "events").select("event_id", wrap_delta(F.col("event_id") * 7919000, F.lit(4294000000), 60000.0).alias("delta_ms")), "delta_ms")


def _knn_edges(spark, d):
    rows = io.table(spark, d, "embeddings").select("vec_id", "embedding")
    return knn.nearest_k(rows, rows, 1, "vec_id", "embedding", other=True).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"), "distance")


_EDGES = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT a.vec_id AS a, b.vec_id AS b, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.e, b.e), 6), b.vec_id) AS rn FROM v a JOIN v b ON a.vec_id <> b.vec_id),
s AS (SELECT a, b FROM n WHERE rn = 1 UNION SELECT b, a FROM n WHERE rn = 1),
r AS (SELECT a AS id, a AS label FROM s UNION SELECT s.b, r.label FROM r JOIN s ON s.a = r.id WHERE r.label < s.b),
c AS (SELECT id, min(label) AS component FROM r GROUP BY 1)"""


@query("components", _EDGES + " SELECT id, component FROM c")
def components(spark, d):
    return graph.connected_components(_knn_edges(spark, d))


@query("conflict_union", _EDGES + " SELECT component, count(*) AS size FROM c JOIN embeddings ON vec_id = id GROUP BY 1 HAVING count(*) = count(DISTINCT label)")
def conflict_union(spark, d):
    return graph.conflict_free(graph.connected_components(_knn_edges(spark, d)), io.table(spark, d, "embeddings"), "vec_id", "label")


@query("reachability", _EDGES + ", q AS (SELECT 0::BIGINT AS id) SELECT c.id FROM c WHERE component = (SELECT component FROM c WHERE id = 0)")
def reachability(spark, d):
    return graph.reachable(_knn_edges(spark, d), spark.range(1)).select("id")


@query("max_spanning_tree", state.SPANNING)
def max_spanning_tree(spark, d):
    rows = io.table(spark, d, "embeddings").select("vec_id", "embedding")
    near = knn.nearest_k(rows, rows, 4, "vec_id", "embedding", other=True)
    edges = near.select(F.least("a_id", "b_id").alias("src"), F.greatest("a_id", "b_id").alias("dst"), (-F.col("distance")).alias("score")).distinct()
    return graph.spanning_forest(edges, "score")


def _sides(spark, d):
    e = _events(spark, d).select(F.lit(0).alias("key"), F.col("event_id").alias("id"), "t", "event_type", "user_id")
    return e


@query("greedy_one_to_one", state.GREEDY)
def greedy_one_to_one(spark, d):
    e = _sides(spark, d)
    return pairing.one_to_one(e.where("event_type = 'view'").select("key", "id", "t"), e.where("event_type = 'error'").select("key", "id", "t"), 600.0, "key", "greedy")


@query("nearest_unused", state.NEAREST_UNUSED)
def nearest_unused(spark, d):
    e = _sides(spark, d)
    return pairing.one_to_one(e.where("event_type = 'view'").select("key", "id", "t"), e.where("event_type = 'error'").select("key", "id", "t"), 600.0, "key")


@query("gravity_filter", state.GRAVITY)
def gravity_filter(spark, d):
    e = _events(spark, d).select("user_id", F.col("event_id").alias("id"), "t", *((F.lit(9.8) * f(F.col("value") / 50)).alias(n) for f, n in ((F.sin, "ax"), (F.cos, "ay"))), F.lit(0.1).alias("az"))
    return _r(sequence.gravity_filter(e, "user_id", gap=40000.0, tau=20000.0), "confidence", "up_x", "up_y", "up_z")


@query("hysteresis", state.HYSTERESIS)
def hysteresis(spark, d):
    e = _events(spark, d).select("user_id", F.col("event_id").alias("id"), "t", (F.col("value") * 3.6).alias("angle"))
    return sequence.hysteresis(e, "user_id", "angle", hold=20000.0)


@query("rate_limited", state.RATE_LIMITED + " SELECT user_id, event_id AS id, taken FROM s")
def rate_limited(spark, d):
    return sequence.rate_limit(_events(spark, d).select("user_id", F.col("event_id").alias("id"), "t"), "user_id", 86400.0)


@query("reverse_delete_cover", state.REVERSE_DELETE)
def reverse_delete_cover(spark, d):
    seen = io.table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 16).alias("block"), "l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("weight"))
    return select.redundant_views(seen, "block", "l_suppkey", "l_partkey", "weight")


@query("global_gains", state.GAINS)
def global_gains(spark, d):
    seen = io.table(spark, d, "lineitem").groupBy("l_partkey", (F.col("l_suppkey") % 6).alias("view")).agg(F.avg("l_extendedprice").alias("v"))
    a, b = seen.select("l_partkey", F.col("view").alias("a"), F.col("v").alias("va")), seen.select("l_partkey", F.col("view").alias("b"), F.col("v").alias("vb"))
    ratios = a.join(b, "l_partkey").where("a < b").groupBy("a", "b").agg(F.percentile(F.ln(F.col("va") / F.col("vb")), F.lit(0.5)).alias("ratio"))
    return _r(select.global_gains(ratios, "a", "b", "ratio"), "gain")


def _event_stream(spark, d):
    stream = jobs.read_table(spark, f"{d}/events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("t", F.unix_micros("ts") / 1e6)


@query("stream_pairing", state.STREAM_PAIRS)
def stream_pairing(spark, d):
    rows = _event_stream(spark, d).where("event_type in ('view', 'error')").select("user_id", F.col("event_id").alias("id"), "t", "ts", F.when(F.col("event_type") == "view", "a").otherwise("b").alias("kind"))
    return jobs.run_to_table(jobs.stream_pairing(rows, "user_id", 43200.0), "pairs")


@query("stream_gap_sessions", state.STREAM_SESSIONS)
def stream_gap_sessions(spark, d):
    rows = _event_stream(spark, d).select("user_id", "ts")
    end = io.table(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY")).first()[0]
    out = jobs.run_to_table(jobs.stream_gap_sessions(jobs.with_end(rows, end), "user_id", "2 hours", "1 hour"), "sessions").where("user_id is not null")
    return _r(out.select("user_id", *((F.unix_micros(c) / 1e6).alias(c) for c in ("start", "end")), "n"), "start", "end")


@query("stream_rate_limit", state.RATE_LIMITED + " SELECT user_id AS key, event_id AS id, t FROM s WHERE taken")
def stream_rate_limit(spark, d):
    return jobs.run_to_table(jobs.stream_rate_limit(_event_stream(spark, d).select("user_id", F.col("event_id").alias("id"), "t"), "user_id", 86400.0), "taken")


@query("stream_receipts", "SELECT DISTINCT user_id, event_type FROM events")
def stream_receipts(spark, d):
    return jobs.run_to_table(jobs.stream_receipts(_event_stream(spark, d).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "60 days"), "receipts").select("user_id", "event_type")
