"""Grid aggregation and confidence-weighted folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cell


def downsample(df: DataFrame, axes: dict[str, float], values: tuple[str, ...] = ()) -> DataFrame:
    """One row per occupied cell: i_<axis> keys, means of the axes and of values, and the count."""
    keys = [cell(F.col(a), s).alias(f"i_{a}") for a, s in axes.items()]
    return df.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in (*axes, *values)), F.count(F.lit(1)).alias("n"))


def occupied(df: DataFrame, axes: dict[str, float]) -> DataFrame:
    """Distinct cells."""
    return df.select(*(cell(F.col(a), s).alias(f"i_{a}") for a, s in axes.items())).distinct()


def weighted_fold(df: DataFrame, keys: list[Column], distance: Column, weight: Column, truncation: float, colours: dict[str, Column] | None = None) -> DataFrame:
    """The running weighted mean of truncated distances, as sums: any order gives the same, and partial sums combine before the shuffle.

    Rows under -truncation or without positive weight take no part; distances
    over truncation count as 1.
    """
    gate = (distance >= -truncation) & (weight > 0)
    kept = df.where(gate)
    mean = lambda v: F.sum(weight * v) / F.sum(weight)
    more = [mean(v).alias(n) for n, v in (colours or {}).items()]
    return kept.groupBy(*keys).agg(mean(F.least(distance / truncation, F.lit(1.0))).alias("tsdf"), F.sum(weight).alias("w"), F.count(F.lit(1)).alias("n"), *more)


def fold_into(state: DataFrame, update: DataFrame, keys: list[str]) -> DataFrame:
    """Joins an earlier fold (keys, tsdf, w, n) with a later one."""
    both = state.unionByName(update.select(*state.columns))
    return both.groupBy(*keys).agg((F.sum(F.col("w") * F.col("tsdf")) / F.sum("w")).alias("tsdf"), F.sum("w").alias("w"), F.sum("n").alias("n"))


def observation_statistics(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Mean weight of valid observations, and the share of them with weight 0."""
    valid = F.col(weight).isNotNull()
    return df.groupBy(*keys).agg(F.avg(weight).alias("mean_weight"), (F.count_if(valid & (F.col(weight) <= 0)) / F.count_if(valid)).alias("rejected"))
