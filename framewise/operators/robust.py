"""Robust and coverage-aware aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import materialise


def percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Per key exact percentiles of value with linear interpolation, one column for each entry of `at`.

    No task holds a key: equal values are counted first, (key, value) is
    range-partitioned, and each partition's counts (one row a key and
    partition) say which partitions hold a wanted rank; only these are ranked.
    Null values don't count; a key without values gives nulls, a null key is a
    key, and an empty table gives no rows.
    """
    key = F.struct(F.lit(0).alias("_0"), *keys)
    counts = df.groupBy(key.alias("_k"), F.col(value).cast("double").alias("_v")).agg(F.count(F.col(value)).alias("_c"))
    parted = materialise(counts.repartitionByRange("_k", "_v").withColumn("_part", F.spark_partition_id()), "ranked")
    own = Window.partitionBy("_k")
    before = F.sum("_size").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = parted.groupBy("_k", "_part").agg(F.sum("_c").alias("_size")).select("_k", "_part", "_size", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_size").over(own).alias("_n"))
    place = {name: (F.col("_n") - 1) * F.lit(float(p)) for name, p in at.items()}
    wanted = [end(x).cast("long") for x in place.values() for end in (F.floor, F.ceil)]
    within = lambda rank, low, high: (rank >= low) & (rank < high)
    held = sizes.where(reduce(lambda x, y: x | y, (within(r, F.col("_before"), F.col("_before") + F.col("_size")) for r in wanted)))
    last = F.sum("_c").over(Window.partitionBy("_part", "_k").orderBy("_v")) + F.col("_before")
    ranked = parted.where("_c > 0").join(held.drop("_size"), ["_k", "_part"]).withColumn("_last", last)
    value_at = lambda rank: F.max(F.when(within(rank.cast("long"), F.col("_last") - F.col("_c"), F.col("_last")), F.col("_v")))
    ends = [end for name, x in place.items() for end in (value_at(F.floor(x)).alias(f"_lo_{name}"), value_at(F.ceil(x)).alias(f"_hi_{name}"), F.max(x - F.floor(x)).alias(f"_at_{name}"))]
    picked = ranked.groupBy("_k").agg(*ends)
    between = [F.when(F.col(f"_at_{name}") == 0, F.col(f"_lo_{name}")).otherwise(F.col(f"_lo_{name}") * (1 - F.col(f"_at_{name}")) + F.col(f"_hi_{name}") * F.col(f"_at_{name}")).alias(name) for name in at]
    return sizes.select("_k").distinct().join(picked, "_k", "left").select(*(F.col("_k")[k].alias(k) for k in keys), *between)


def with_percentiles(own: DataFrame, df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """own (one row a key) with percentiles of df's value; null keys meet."""
    ranks = percentiles(df, keys, value, at).select(F.struct(F.lit(0).alias("_0"), *keys).alias("_k"), *at)
    return own.withColumn("_k", F.struct(F.lit(0).alias("_0"), *keys)).join(ranks, "_k", "left").drop("_k")


def distribution(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, min, median, mean, p90, p95 and max with linear interpolation."""
    own = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return with_percentiles(own, df, keys, value, {"median": 0.5, "p90": 0.9, "p95": 0.95}).select(*keys, "n", "min", "median", "mean", "p90", "p95", "max")


def rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def saturated_loss(error: Column, cap: float) -> Column:
    """Mean of min(|error|, cap)^2 over known errors."""
    return F.avg(F.when(error.isNotNull(), F.pow(F.least(F.abs(error), F.lit(cap)), 2)))


def capped_rmse(error: Column, cap: float) -> Column:
    """Root mean square with errors cut at cap and missing ones counted as cap."""
    return F.sqrt(F.avg(F.pow(F.coalesce(F.least(F.abs(error), F.lit(cap)), F.lit(cap)), 2)))


def share(condition: Column, default: float) -> Column:
    """The share of rows that meet a condition; default without rows where it is known."""
    return F.coalesce(F.avg(condition.cast("double")), F.lit(default))


def f_score(precision: Column, completeness: Column) -> Column:
    total = precision + completeness
    return F.when(total > 0, 2 * precision * completeness / total).otherwise(0.0)


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(weight)


def median_mad(df: DataFrame, keys: list[str], value: str, limit: float, least: int = 1) -> DataFrame:
    """Per key the median and the median absolute deviation, and whether the latter stays within limit over least rows."""
    middle = with_percentiles(df.groupBy(*keys).agg(F.count(value).alias("n")), df, keys, value, {"median": 0.5}).select(*keys, "median", "n")
    middle = materialise(middle, "medians")
    spread = percentiles(df.join(middle, keys).withColumn("_d", F.abs(F.col(value) - F.col("median"))), keys, "_d", {"mad": 0.5})
    return middle.join(spread, keys).withColumn("accepted", (F.col("mad") <= limit) & (F.col("n") >= least))


def irls_consensus(df: DataFrame, keys: list[str], value: str, weight: str, rounds: int = 5, scale: float = 0.035, cap: float = 0.5) -> DataFrame:
    """Per key a weighted mean whose weights, cut at cap times the largest, shrink by scale over the residual; rounds unrolled.

    A key's rows move once: each round is a window over the same partitioning.
    """
    own = Window.partitionBy(*keys)
    first = F.least(F.col(weight) / F.greatest(F.max(weight).over(own), F.lit(1e-8)), F.lit(cap))
    df = df.withColumn("_w", first).withColumn("_c", F.col("_w"))
    for k in range(rounds):
        df = df.withColumn("_m", F.sum(F.col("_c") * F.col(value)).over(own) / F.greatest(F.sum("_c").over(own), F.lit(1e-8)))
        if k < rounds - 1:
            df = df.withColumn("_c", F.col("_w") * F.least(F.lit(1.0), scale / F.greatest(F.abs(F.col(value) - F.col("_m")), F.lit(1e-8))))
    return df.groupBy(*keys).agg(F.max("_m").alias("consensus"), F.count(F.lit(1)).alias("n"))


def moments(df: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """Population covariances of every pair of axes, as one aggregation."""
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.covar_pop(a, b).alias(f"cov_{a}_{b}") for a, b in pairs))


def normal_equations(df: DataFrame, keys: list[str], jacobian: list[Column], residual: Column, weight: Column | None = None) -> DataFrame:
    """Sums of J'J (upper half) and J'r per key."""
    w = F.lit(1.0) if weight is None else weight
    sums = [F.sum(w * a * b).alias(f"jj_{i}_{j + i}") for i, a in enumerate(jacobian) for j, b in enumerate(jacobian[i:])]
    return df.groupBy(*keys).agg(*sums, *(F.sum(w * a * residual).alias(f"jr_{i}") for i, a in enumerate(jacobian)))


def argmax(df: DataFrame, keys: list[str], view: str, weight: str) -> DataFrame:
    """The view of the largest weight; of equal ones the smallest view."""
    return df.groupBy(*keys).agg(F.max(F.struct(F.col(weight).alias("w"), (-F.col(view)).alias("v"))).alias("_b")).select(*keys, (-F.col("_b.v")).alias(view), F.col("_b.w").alias(weight))


def vote_cells(df: DataFrame, cells: list[Column], names: list[str], index: str, top: int = 12) -> DataFrame:
    """The cells with most votes, of equal ones the first seen."""
    votes = df.groupBy(*(c.alias(n) for c, n in zip(cells, names, strict=True))).agg(F.count(F.lit(1)).alias("votes"), F.min(index).alias("first_index"))
    return votes.orderBy(F.desc("votes"), "first_index").limit(top)


def stage_summary(df: DataFrame, stage: str, value: str) -> DataFrame:
    """Per stage the total, count, p50, p95 and its share of everything."""
    own = with_percentiles(df.groupBy(stage).agg(F.sum(value).alias("total"), F.count(value).alias("n")), df, [stage], value, {"p50": 0.5, "p95": 0.95})
    whole = own.agg(F.sum("total").alias("_all"))
    return own.crossJoin(F.broadcast(whole)).select(stage, "total", "n", "p50", "p95", (F.col("total") / F.col("_all")).alias("share"))


def baseline_speedup(df: DataFrame, variant: str, run: str, value: str, baseline) -> DataFrame:
    """The median over runs of each run's median per variant, and the baseline's over it."""
    runs = materialise(percentiles(df, [variant, run], value, {"_m": 0.5}), "run-medians")
    own = with_percentiles(runs.groupBy(variant).agg(F.count(F.lit(1)).alias("runs")), runs, [variant], "_m", {"median": 0.5})
    base = own.where(F.col(variant) == baseline).select(F.col("median").alias("_base"))
    return own.crossJoin(F.broadcast(base)).select(variant, "median", "runs", (F.col("_base") / F.col("median")).alias("speedup"))


def bounds(df: DataFrame, keys: list[str], axes: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Percentile bounds of each axis, their centre, and half the diagonal."""
    own = reduce(lambda own, a: with_percentiles(own, df, keys, a, {f"{a}_lo": low, f"{a}_hi": high}), axes, df.select(*keys).distinct())
    centre = [((F.col(f"{a}_lo") + F.col(f"{a}_hi")) / 2).alias(f"{a}_centre") for a in axes]
    half = F.sqrt(reduce(lambda x, y: x + y, (F.pow(F.col(f"{a}_hi") - F.col(f"{a}_lo"), 2) for a in axes))) / 2
    return own.select(*own.columns, *centre, half.alias("half_diagonal"))


def stationary(df: DataFrame, keys: list[str], value: str, t: str = "t") -> DataFrame:
    """Mean, scatter, peak deviation, slope over time and the largest shift between three blocks in order."""
    own = Window.partitionBy(*keys)
    marked = df.withColumns({"_m": F.avg(value).over(own), "_block": F.ntile(3).over(own.orderBy(t))})
    blocks = marked.groupBy(*keys, "_block").agg(F.avg(value).alias("_b")).groupBy(*keys).agg((F.max("_b") - F.min("_b")).alias("block_shift"))
    dev = F.col(value) - F.col("_m")
    return marked.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), rmse(dev).alias("scatter"), F.max(F.abs(dev)).alias("peak"), F.regr_slope(value, t).alias("drift")).join(blocks, keys)


def landmarks(df: DataFrame, keys: list[str], view: str, axes: list[str], least: int = 2) -> DataFrame:
    """Per landmark the median of each axis over the views that see it, and their number; fewer views than least make none."""
    views = df.groupBy(*keys).agg(F.count_distinct(view).alias("views")).where(F.col("views") >= least)
    return reduce(lambda own, a: with_percentiles(own, df, keys, a, {a: 0.5}), axes, views).select(*keys, "views", *axes)


def mean_direction(df: DataFrame, keys: list[str], axes: tuple[str, str, str], weight: str, limit: float = 15.0) -> DataFrame:
    """Per key the weighted mean direction (ux, uy, uz), the largest angle to it in degrees (spread), and whether that stays within limit.

    Two aggregations; rows without a positive weight or a length take no part.
    """
    length = F.sqrt(sum((F.col(a) * F.col(a) for a in axes[1:]), F.col(axes[0]) * F.col(axes[0])))
    unit = df.where(F.col(weight) > 0).withColumn("_l", length).where("_l > 0").select(*keys, F.col(weight).alias("_w"), *((F.col(a) / F.col("_l")).alias(f"_{k}") for k, a in zip("xyz", axes, strict=True)))
    sums = unit.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.col("_w") * F.col(f"_{k}")).alias(f"_s{k}") for k in "xyz"))
    size = F.sqrt(F.col("_sx") * F.col("_sx") + F.col("_sy") * F.col("_sy") + F.col("_sz") * F.col("_sz"))
    mean = sums.where(size > 0).select(*keys, "n", *((F.col(f"_s{k}") / size).alias(f"u{k}") for k in "xyz"))
    dot = F.col("_x") * F.col("ux") + F.col("_y") * F.col("uy") + F.col("_z") * F.col("uz")
    spread = unit.join(mean, keys).groupBy(*keys).agg(F.degrees(F.acos(F.least(F.greatest(F.min(dot), F.lit(-1.0)), F.lit(1.0)))).alias("spread"))
    return mean.join(spread, keys).withColumn("accepted", F.col("spread") <= limit)


def normal_scatter(faces: DataFrame, key: str, normal: tuple[str, str, str], area: str) -> DataFrame:
    """Per vertex the area-weighted scatter of the normals of its faces: sums of the six products."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    return faces.groupBy(key).agg(*(F.sum(F.col(area) * F.col(normal[i]) * F.col(normal[j])).alias(f"s_{i}{j}") for i, j in pairs), F.sum(area).alias("area"))


def face_means(faces: DataFrame, scores: DataFrame) -> DataFrame:
    """(face, score): the mean score of a face's corners (face, a, b, c) that have one (id, score); null without any."""
    corners = faces.select("face", F.explode(F.array("a", "b", "c")).alias("id"))
    return corners.join(scores.select("id", "score"), "id", "left").groupBy("face").agg(F.avg("score").alias("score"))
