"""Set operations and idempotent ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in order. An aggregation, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in (*order, *rest)))


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last in order (an upsert)."""
    rest = [c for c in df.columns if c not in (*keys, *order)]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_r")).select(*keys, *(F.col("_r")[c].alias(c) for c in (*order, *rest)))


def receipts(df: DataFrame, stream: str, sequence: str, digest: str, arrival: str) -> DataFrame:
    """df with status per upload: stored (first of its sequence), replayed (same digest again) or conflict."""
    first = df.groupBy(stream, sequence).agg(F.min(F.struct(arrival, digest)).alias("_f"))
    joined = df.join(first, [stream, sequence])
    status = F.when(F.col(arrival) == F.col(f"_f.{arrival}"), "stored").when(F.col(digest).eqNullSafe(F.col(f"_f.{digest}")), "replayed").otherwise("conflict")
    return joined.withColumn("status", status).drop("_f")


def accepted_prefix(df: DataFrame, stream: str, sequence: str) -> DataFrame:
    """Rows of each stream up to its first missing sequence number (from 0)."""
    from pyspark.sql import Window

    own = Window.partitionBy(stream).orderBy(sequence)
    hole = F.col(sequence) != F.row_number().over(own) - 1
    return df.withColumn("_h", F.sum(hole.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))).where("_h = 0").drop("_h")


def quarantine(df: DataFrame, ident: list[str], scope: list[str]) -> DataFrame:
    """Rows whose ident never occurs twice within one scope; one such scope excludes the ident everywhere."""
    bad = df.groupBy(*ident, *scope).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*ident).distinct()
    return df.join(bad, ident, "left_anti")


def prefix_merge(old: DataFrame, new: DataFrame, segment: str, sequence: str, values: list[str]) -> DataFrame:
    """Per segment the longer of two journals, and whether their common prefix agrees.

    Returns segment, n_old, n_new, n_merged, conflict.
    """
    a = old.select(segment, sequence, F.struct(*values).alias("_a"), F.lit(1).alias("_in_a"))
    b = new.select(segment, sequence, F.struct(*values).alias("_b"), F.lit(1).alias("_in_b"))
    both = a.join(b, [segment, sequence], "full")
    sums = both.groupBy(segment).agg(F.count("_in_a").alias("n_old"), F.count("_in_b").alias("n_new"), F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("_differ"))
    return sums.select(segment, "n_old", "n_new", F.greatest("n_old", "n_new").alias("n_merged"), (F.col("_differ") > 0).alias("conflict"))


def member_audit(members: DataFrame, used: DataFrame, ident: str, size: Column) -> DataFrame:
    """Members and their size by whether they are used; each member counts once."""
    own = members.groupBy(ident).agg(F.max(size).alias("_size"))
    flag = used.select(ident).distinct().withColumn("_u", F.lit(True))
    return own.join(flag, ident, "left").groupBy(F.coalesce("_u", F.lit(False)).alias("used")).agg(F.count(F.lit(1)).alias("members"), F.sum("_size").alias("size"))


def fingerprint(df: DataFrame, keys: list[str], columns: list[Column]) -> DataFrame:
    """An order-free digest of each key's rows: four 60-bit parts of each row's hash are summed, and the sums are hashed.

    Sums combine before the shuffle, so no task holds a key's rows; repeated
    rows count. Null columns count as "~". An empty table without keys gives
    one row of n = 0.
    """
    row = F.sha2(F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("~")) for c in columns)).cast("binary"), 256)
    part = lambda k: F.conv(F.substring("_h", 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")
    sums = df.select(*keys, row.alias("_h")).groupBy(*keys).agg(*(F.sum(part(k)).alias(f"_s{k}") for k in range(4)), F.count(F.lit(1)).alias("n"))
    return sums.select(*keys, F.sha2(F.concat_ws("-", *(F.col(f"_s{k}").cast("string") for k in range(4))).cast("binary"), 256).alias("fingerprint"), "n")


def tolerant_compare(a: DataFrame, b: DataFrame, ident: str, columns: list[str], tolerance: float = 1e-10) -> DataFrame:
    """Rows of both by ident with the first column that differs: numbers by tolerance, others by equality; null where all agree."""
    left, right = a.select(ident, F.struct(*columns).alias("_a")), b.select(ident, F.struct(*columns).alias("_b"))
    both = left.join(right, ident, "full")
    kinds = dict(a.dtypes)
    differ = []
    for c in columns:
        x, y = F.col("_a")[c], F.col("_b")[c]
        same = x.eqNullSafe(y)
        if kinds[c] in ("double", "float"):
            same = same | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))
        differ.append(F.when(~same, F.lit(c)))
    return both.select(ident, F.coalesce(*differ).alias("first_difference"))


def disjoint(a: DataFrame, b: DataFrame, ident: str) -> bool:
    return a.select(ident).intersect(b.select(ident)).isEmpty()
