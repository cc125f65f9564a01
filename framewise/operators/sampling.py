"""Top-k, stratified and evenly spaced samples, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import broadcast_if_small, materialise


def numbered(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """df with row numbers from 1 over all rows in order (which should be total), without one task for all.

    Rows are range-partitioned; each partition counts its own, and the counts
    (one row a partition) add up to its offset.
    """
    parted = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = parted.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    offset = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(offset, F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.join(broadcast_if_small(offsets), "_part").withColumn(name, own + F.col("_offset")).drop("_part", "_offset")


def linspace(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """size rows evenly spaced over df in order: positions floor(k (n - 1) / (size - 1))."""
    rows = numbered(df, order)
    n = df.count()
    if n <= size:
        return rows
    # A row is a spot where some k has floor(k (n - 1) / (size - 1)) at its position: the least k that reaches it must not pass it.
    at, last = F.col("rn") - 1, max(size - 1, 1)
    k = F.ceil(at * last / F.lit(n - 1))
    spot = lambda k: (k >= 0) & (k < size) & (F.floor(k * (n - 1) / last) == at)
    return rows.where(spot(k) | spot(k - 1) | spot(k + 1))


def every_kth(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """Every k-th row so that at most `most` stay."""
    step = max(1, -(-df.count() // most))
    return numbered(df, order).where(F.pmod(F.col("rn") - 1, F.lit(step)) == 0)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows per key; Spark limits each partition's rows before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def stratified_top_k(df: DataFrame, cell: str, order: list[Column], k: int, start: Column | None = None) -> DataFrame:
    """k rows taken by turns from the cell with fewest taken so far (start: taken before), best first.

    A cell gives at most k rows, so ranks are limited per cell before the final order.
    """
    rank = F.row_number().over(Window.partitionBy(cell).orderBy(*order))
    ranked = df.withColumn("_rank", rank).where(F.col("_rank") <= k)
    return ranked.withColumn("turn", F.col("_rank") - 1 + (F.lit(0) if start is None else start)).orderBy("turn", cell).limit(k).drop("_rank")


def splits(number: str, parts: int = 2) -> Column:
    """Disjoint parts by remainder."""
    return F.pmod(F.col(number), F.lit(parts))


def hold_out(df: DataFrame, keys: list[str], order: list[str], every: int = 5) -> DataFrame:
    """df with held_out: every fifth row per key, or the last of fewer."""
    own = Window.partitionBy(*keys)
    n, rn = F.count(F.lit(1)).over(own), F.row_number().over(own.orderBy(*order))
    return df.withColumn("held_out", F.when(n >= every, F.pmod(rn, F.lit(every)) == 0).otherwise(rn == n))


def ends(df: DataFrame, keys: list[str], order: list[str], first: int = 2, last: int = 6) -> DataFrame:
    """The first and the last rows per key of those that have more; all of others."""
    up = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    down = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(o) for o in order)))
    return df.withColumns({"_up": up, "_down": down}).where((F.col("_up") <= first) | (F.col("_down") <= last)).drop("_up", "_down")


def interleave(df: DataFrame, group: str, order: list[str], ident: str) -> DataFrame:
    """Groups by turns: rank within the group, then group; of repeated idents the first place.

    Ranks are numbers over all rows less those of the group's first row, so no
    task holds a group.
    """
    rows = numbered(df.select(*dict.fromkeys((ident, group, *order))), [group, *order], "_rn")
    starts = materialise(rows.groupBy(F.col(group).alias("_group")).agg(F.min("_rn").alias("_start")), "group-starts")
    met = rows.join(broadcast_if_small(starts), F.col(group).eqNullSafe(F.col("_group"))).withColumn("turn", (F.col("_rn") - F.col("_start") + 1).cast("int"))
    place = met.groupBy(ident).agg(F.min(F.struct("turn", group)).alias("_p"))
    return place.select(ident, F.col("_p.turn").alias("turn"), F.col(f"_p.{group}").alias(group))


def best_per_run(df: DataFrame, keys: list[str], order: list[str], score: str, runs: int) -> DataFrame:
    """Each key's rows in order cut into runs of equal size, and the best row of each."""
    cut = df.withColumn("run", F.ntile(runs).over(Window.partitionBy(*keys).orderBy(*order)))
    others = [c for c in df.columns if c not in (*keys, score)]
    return cut.groupBy(*keys, "run").agg(F.max(F.struct(score, *others)).alias("_b")).select(*keys, "run", f"_b.{score}", *(f"_b.{c}" for c in others))


def area_sample(df: DataFrame, area: str, ident: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement in proportion to area: how often each row was drawn.

    Each row's draws are the grid points (k + u) / n that fall into its share
    of the summed areas, so no draw is moved; sums run per range partition.
    """
    rows = numbered(df.where(F.col(area) > 0), [ident])
    parts = materialise(rows.withColumn("_p", F.floor(F.col("rn") / 65536)), "areas")
    sums = parts.groupBy("_p").agg(F.sum(area).alias("_s"))
    base = sums.withColumn("_base", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("_all", F.sum("_s").over(Window.partitionBy()))
    up = F.col("_base") + F.sum(area).over(Window.partitionBy("_p").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    u = (seed * 0.618033988749895) % 1.0
    spot = lambda c: F.ceil(c / F.col("_all") * n - u)
    return parts.join(broadcast_if_small(materialise(base, "area-sums")), "_p").withColumn("_up", up).select(*df.columns, (spot(F.col("_up")) - spot(F.col("_up") - F.col(area))).alias("draws"))


def quota_fill(df: DataFrame, view: str, ident: str, order: list[Column], quota: int, capacity: int) -> DataFrame:
    """(ident, quota_met): landmarks up to a capacity: each view's first quota ones in order, then the best of the others.

    df: one row per (view, ident); order ranks idents alike in every view.
    Ranks are limited per view before the final order.
    """
    rank = F.row_number().over(Window.partitionBy(view).orderBy(*order, ident))
    own = df.withColumn("_due", rank <= quota)
    chosen = own.groupBy(ident).agg(F.max("_due").alias("quota_met"), *(F.first(c, True).alias(c) for c in df.columns if c not in (view, ident)))
    return chosen.orderBy(F.desc("quota_met"), *order, ident).limit(capacity).select(ident, "quota_met")


def replenish(candidates: DataFrame, held: DataFrame, cell: str, order: list[Column], ident: str, per_cell: int, total: int) -> DataFrame:
    """Candidates that fill grid cells up to per_cell with what they hold already, best first by turns, up to total rows with what is held.

    held: (cell) one row per point that is still there or cools down in it.
    """
    taken = held.groupBy(cell).agg(F.count(F.lit(1)).alias("_held"))
    room = total - held.count()
    own = candidates.join(taken, cell, "left").withColumn("_held", F.coalesce("_held", F.lit(0)))
    ranked = own.withColumn("turn", F.col("_held") + F.row_number().over(Window.partitionBy(cell).orderBy(*order, ident)))
    return ranked.where(F.col("turn") <= per_cell).orderBy("turn", cell).limit(max(room, 0)).drop("_held")
