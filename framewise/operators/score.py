"""Scorecards, gates and reason cascades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .robust import capped_rmse, distribution, f_score, rmse, share, with_percentiles


def first_reason(rules: list[tuple[str, Column]], accepted: str = "accepted") -> Column:
    """The name of the first rule that a row breaks; a null test counts as broken."""
    out = None
    for name, broken in rules:
        broken = F.coalesce(broken, F.lit(True))
        out = F.when(broken, name) if out is None else out.when(broken, name)
    return F.lit(accepted) if out is None else out.otherwise(accepted)


def failure_category(message: Column, prefixes: list[tuple[str, str]], other: str = "other") -> Column:
    """The category of the first prefix that a message starts with."""
    out = F.when(message.isNull() | (message == ""), "none")
    for prefix, name in prefixes:
        out = out.when(message.startswith(prefix), name)
    return out.otherwise(other)


def view_metrics(observed: DataFrame, rendered: DataFrame, keys: list[str], view: str, value: str, tolerance: float, cap: float) -> DataFrame:
    """Per view: rows, hits, precision, completeness, F and capped RMSE; unmatched observations count as cap."""
    joined = observed.join(rendered.select(*keys, F.col(value).alias("_r")), keys, "left")
    error = F.col("_r") - F.col(value)
    hit = F.coalesce(F.abs(error) <= tolerance, F.lit(False))
    own = joined.groupBy(view).agg(F.count(F.lit(1)).alias("n"), F.count("_r").alias("hits"), share(F.when(F.col("_r").isNotNull(), hit), 0.0).alias("precision"), share(hit, 0.0).alias("completeness"), capped_rmse(error, cap).alias("rmse"))
    return own.withColumn("f_score", f_score(F.col("precision"), F.col("completeness")))


def trajectory_score(df: DataFrame, keys: list[str], axes: list[tuple[str, str]], order: list[str]) -> DataFrame:
    """RMSE of the distance between two tracks after moving the first row of each onto the other; axes: (estimate, truth)."""
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    off = {f"_d{k}": (F.col(a) - F.first(a).over(own)) - (F.col(b) - F.first(b).over(own)) for k, (a, b) in enumerate(axes)}
    length = F.sqrt(sum((F.pow(F.col(k), 2) for k in off), F.lit(0.0)))
    return df.withColumns(off).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rmse(length).alias("rmse"))


def contribution(df: DataFrame, view: str, sample: str) -> DataFrame:
    """Per view the samples that it sees, and those that no other view sees."""
    seen = df.select(view, sample).distinct()
    n = seen.groupBy(sample).agg(F.count(F.lit(1)).alias("_views"))
    return seen.join(n, sample).groupBy(view).agg(F.count(F.lit(1)).alias("visible"), F.count_if(F.col("_views") == 1).alias("only_here"))


def pair_agreement(df: DataFrame, a: str, b: str, tests: str, fraction: str, worst: int = 30) -> DataFrame:
    """Ordered view pairs with the lowest weighted fraction over at least one test."""
    own = df.groupBy(a, b).agg(F.sum(tests).alias("tests"), (F.sum(F.col(tests) * F.col(fraction)) / F.sum(tests)).alias("agreement"))
    return own.orderBy("agreement", a, b).limit(worst)


def held_out_gate(df: DataFrame, before: str, after: str, worse: float = 1.1, better: float = 0.98) -> DataFrame:
    """One row: no pair worse than the factor, and the whole better by at least 2 %."""
    return df.agg(F.count_if(F.col(after) > worse * F.col(before)).alias("worse"), F.avg(before).alias("before"), F.avg(after).alias("after")).withColumn("accepted", (F.col("worse") == 0) & (F.col("after") <= better * F.col("before")))


def edge_events(df: DataFrame, keys: list[str], low: Column, order: list[str]) -> DataFrame:
    """Rows at which a condition begins ('low') or ends ('recovered')."""
    own = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_low", F.coalesce(low, F.lit(False))).withColumn("_was", F.coalesce(F.lag("_low").over(own), F.lit(False)))
    return marked.where("_low <> _was").withColumn("event", F.when(F.col("_low"), "low").otherwise("recovered")).drop("_low", "_was")


def lag_evidence(df: DataFrame, keys: list[str], lag: str, limit: float = 20.0) -> DataFrame:
    """p95 of |lag|, how many are over limit, and the share that is known."""
    own = df.groupBy(*keys).agg(F.count_if(F.abs(F.col(lag)) > limit).alias("over"), F.avg(F.col(lag).isNotNull().cast("double")).alias("known"))
    return with_percentiles(own, df.withColumn("_lag", F.abs(F.col(lag))), keys, "_lag", {"p95": 0.95}).select(*keys, "p95", "over", "known")


def session_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return distribution(df, keys, value)


def validate_stream(df: DataFrame, keys: list[str], sequence: str, t: str, start: str, end: str) -> DataFrame:
    """Rows that break a rule, with the first one: identity seen before, sequence or time not growing, time outside its interval."""
    own = Window.partitionBy(*keys).orderBy(t, sequence)
    twice = F.count(F.lit(1)).over(Window.partitionBy(*keys, sequence)) > 1
    back = F.col(sequence) <= F.coalesce(F.lag(sequence).over(own), F.col(sequence) - 1)
    still = F.col(t) <= F.coalesce(F.lag(t).over(own), F.col(t) - 1)
    outside = ~F.col(t).between(F.col(start), F.col(end))
    return df.withColumns({"_twice": twice, "_back": back, "_still": still}).withColumn("reason", first_reason([("repeated identity", F.col("_twice")), ("sequence", F.col("_back")), ("time", F.col("_still")), ("interval", outside)])).where("reason <> 'accepted'").drop("_twice", "_back", "_still")


def fusion_plan(blocks: Column, free_bytes: Column, block_bytes: int = 81_920, least: int = 256 << 20) -> Column:
    """Whether ceil(1.02 blocks) and a workspace of half of it (least at least) stay within 80 % of what is free."""
    need = F.ceil(blocks * 1.02) * block_bytes
    return F.struct(need.alias("bytes"), (need + F.greatest(F.lit(least), need / 2) <= free_bytes * 0.8).alias("fits"))


def frame_identity(generation: Column, colour: Column, depth: Column, stamp: Column) -> Column:
    """What tells a frame apart: generation and both sequence numbers, or else generation and time stamp."""
    return F.when(colour.isNotNull() & depth.isNotNull(), F.concat_ws("/", generation.cast("string"), colour.cast("string"), depth.cast("string"))).otherwise(F.concat_ws("@", generation.cast("string"), stamp.cast("string")))


def evidence_summary(df: DataFrame, keys: list[str], generation: str, sequence: str, complete: Column) -> DataFrame:
    """Distinct (generation, sequence) observations, and intervals that are complete and not."""
    own = F.count_distinct(F.struct(generation, sequence))
    return df.groupBy(*keys).agg(own.alias("observations"), F.count_if(complete).alias("complete"), F.count_if(~F.coalesce(complete, F.lit(False))).alias("incomplete"))


def quality_state(requested: Column, failed: Column, report: Column, valid: Column) -> Column:
    """not_requested, failed, missing, invalid or passed: the first that holds."""
    return first_reason([("not_requested", ~requested), ("failed", failed), ("missing", report.isNull()), ("invalid", ~valid)], "passed")


def disagreement(before: DataFrame, after: DataFrame, ident: str, support: str) -> DataFrame:
    """One row: frames in both runs, those whose support differs, those in one run only."""
    a, b = before.select(ident, F.col(support).alias("_a"), F.lit(True).alias("_x")), after.select(ident, F.col(support).alias("_b"), F.lit(True).alias("_y"))
    both = F.col("_x").isNotNull() & F.col("_y").isNotNull()
    return a.join(b, ident, "full").agg(F.count_if(both).alias("both"), F.count_if(both & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("differ"), F.count_if(~both).alias("one_only"))


def fallback(primary: DataFrame, second: DataFrame, ident: str, result: str, names: tuple[str, str] = ("primary", "second")) -> DataFrame:
    """(ident, result, method): primary's result, or else the second method's; null without either."""
    a, b = primary.select(ident, F.col(result).alias("_a")), second.select(ident, F.col(result).alias("_b"))
    method = F.when(F.col("_a").isNotNull(), names[0]).when(F.col("_b").isNotNull(), names[1])
    return a.join(b, ident, "left").select(ident, F.coalesce("_a", "_b").alias(result), method.alias("method"))


def method_counts(results: DataFrame, names: tuple[str, str] = ("primary", "second")) -> DataFrame:
    """One row: how often the second method was tried, and how often it gave a result."""
    tried = F.coalesce(F.col("method") != names[0], F.lit(True))
    return results.agg(F.count_if(tried).alias("attempts"), F.count_if(F.col("method") == names[1]).alias("verified"))


def run_comparison(a: DataFrame, b: DataFrame, ident: str, axes: tuple[str, ...]) -> DataFrame:
    """One row: positions in both runs, in one only, and the mean and largest distance between them."""
    left, right = a.select(ident, F.struct(*axes).alias("_a")), b.select(ident, F.struct(*axes).alias("_b"))
    gap = F.sqrt(sum((F.pow(F.col("_a")[x] - F.col("_b")[x], 2) for x in axes[1:]), F.pow(F.col("_a")[axes[0]] - F.col("_b")[axes[0]], 2)))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return left.join(right, ident, "full").agg(F.count_if(both).alias("both"), F.count_if(~both).alias("one_only"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("largest_gap"))


def measurement_summary(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Per key and metric count, min, median, mean, p90, p95 and max of known values; metrics without a known value stay, with n = 0.

    Metrics are unpivoted first, so one pass ranks them all.
    """
    long = df.unpivot(keys, metrics, "metric", "value") if keys else df.select(*metrics).unpivot([], metrics, "metric", "value")
    return distribution(long, [*keys, "metric"], "value")
