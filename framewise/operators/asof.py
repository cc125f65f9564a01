"""As-of, nearest and range joins on time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_nearest(probe: DataFrame, reference: DataFrame, tolerance: float, keys: tuple[str, ...] = (), t: str = "t", how: str = "inner") -> DataFrame:
    """Each probe row with the nearest reference row (the earlier of two equally near; of one time the least by its columns in order) within tolerance.

    Time is dealt into buckets as wide as the tolerance and each reference row
    goes to its own and both adjacent buckets, so one window per (keys,
    bucket) sees all that may match and no window holds a whole stream.
    Reference columns are prefixed with ref_. Reference rows may be reused.
    """
    width = tolerance if tolerance > 0 else 1
    bucket = F.floor(F.col(t) / width)
    own = [c for c in reference.columns if c not in keys]
    ref = reference.where(F.col(t).isNotNull()).groupBy(*keys, F.col(t).alias("_t")).agg(F.min(F.struct(*own)).alias("_ref"))
    ref = ref.select(*keys, F.explode(F.array(*(F.floor(F.col("_t") / width) + k for k in (-1, 0, 1)))).alias("_bucket"), "_t", "_ref")
    one = probe.select(*keys, bucket.alias("_bucket"), F.col(t).alias("_t"), F.struct(*probe.columns).alias("_probe"))
    both = one.unionByName(ref, allowMissingColumns=True)
    # Both windows run from their first row on; one that looks ahead costs a key's rows squared.
    order = lambda *by: Window.partitionBy(*keys, "_bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    before = F.last("_ref", True).over(order("_t", F.col("_probe").isNotNull()))
    after = F.last("_ref", True).over(order(F.desc("_t"), F.col("_probe").isNotNull()))
    found = both.withColumns({"_before": before, "_after": after}).where("_probe is not null")
    gap = lambda c: F.abs(F.col("_t") - F.col(c)[t])
    best = F.when(F.col("_after").isNull() | (gap("_before") <= gap("_after")), F.col("_before")).otherwise(F.col("_after"))
    found = found.withColumn("_best", best).withColumn("_best", F.when(gap("_best") <= tolerance, F.col("_best")))
    if how == "inner":
        found = found.where("_best is not null")
    return found.select(*(F.col("_probe")[c].alias(c) for c in probe.columns), *(F.col("_best")[c].alias(f"ref_{c}") for c in own))


def asof_backward(probe: DataFrame, reference: DataFrame, keys: tuple[str, ...], chunk: float, max_age: float | None = None, t: str = "t", how: str = "left") -> DataFrame:
    """Each probe row with the latest reference row not after it, per key; also the mode in force at t.

    A key's time is cut into chunks. Windows run per (keys, chunk), and what
    an earlier chunk hands on (its last reference row, one row a chunk) is
    found by a window over the chunks' rows, so a hot key is spread over tasks.
    """
    own = [c for c in reference.columns if c not in keys]
    piece = F.floor(F.col(t) / chunk).alias("_chunk")
    ref = reference.where(F.col(t).isNotNull()).select(*keys, piece, F.col(t).alias("_t"), F.struct(t, *(c for c in own if c != t)).alias("_ref"))
    one = probe.select(*keys, piece, F.col(t).alias("_t"), F.struct(*probe.columns).alias("_probe"))
    carry = ref.groupBy(*keys, "_chunk").agg(F.max("_ref").alias("_last"))
    steps = one.select(*keys, "_chunk").distinct().join(carry, [*keys, "_chunk"], "full")
    over = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select(*keys, "_chunk", F.last("_last", True).over(over).alias("_carried"))
    both = one.unionByName(ref, allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_chunk").orderBy("_t", F.col("_probe").isNotNull(), "_ref").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_here", F.last("_ref", True).over(order)).where("_probe is not null").join(steps, [*keys, "_chunk"], "left")
    best = F.coalesce("_here", "_carried")
    if max_age is not None:
        best = F.when(F.col("_t") - best[t] <= max_age, best)
    found = found.withColumn("_best", best)
    if how == "inner":
        found = found.where("_best is not null")
    return found.select(*(F.col("_probe")[c].alias(c) for c in probe.columns), *(F.col("_best")[c].alias(f"ref_{c}") for c in own))


def range_join(probe: DataFrame, reference: DataFrame, radius: float, keys: tuple[str, ...] = (), t: str = "t") -> DataFrame:
    """All pairs within radius of each other in time, as a bucketed equi-join."""
    bucket = F.floor(F.col(t) / radius)
    own = [c for c in reference.columns if c not in keys]
    ref = reference.select(*keys, F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_bucket"), *(F.col(c).alias(f"ref_{c}") for c in own))
    return probe.withColumn("_bucket", bucket).join(ref, [*keys, "_bucket"]).where(F.abs(F.col(t) - F.col(f"ref_{t}")) <= radius).drop("_bucket")


def count_in_range(probe: DataFrame, reference: DataFrame, radius: float, keys: tuple[str, ...], ident: str, t: str = "t") -> DataFrame:
    """Each probe row with the number of reference rows within radius (0 included)."""
    met = range_join(probe.select(*keys, t, ident), reference.select(*keys, t), radius, keys, t).groupBy(ident).agg(F.count(F.lit(1)).alias("n_near"))
    return probe.join(met, ident, "left").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
