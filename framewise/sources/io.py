"""Readers and writers of recorded streams. All read through Spark, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed schemas of journal streams.
IMAGE_ROW = "sequence long, capture_generation string, timestamp_s double, device_timestamp_ticks long, device_timestamp_unwrapped_s double, estimated_host_monotonic_s double, host_receipt_monotonic_s double"
ACCELERATION_ROW = "sequence long, capture_generation string, valid boolean, reason string, host_monotonic_s double, read_start_s double, read_end_s double, raw_counts array<int>, acceleration_m_s2 array<double>"
STATUS_ROW = "recording_segment string, started_at double, closed boolean, complete boolean, dropped_reads long, rows long"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds(column: str):
    """Seconds of a timestamp with or without a zone, to the microsecond."""
    return F.unix_micros(F.col(column).cast("timestamp")) / 1e6


def journal(spark: SparkSession, path: str, schema: str = IMAGE_ROW) -> DataFrame:
    """Rows of JSON-lines journals with the folder that they came from; broken lines are dropped."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).withColumn("recording_segment", name)


def inventory(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Segments with their rows; a missing or open status means incomplete, and only checkpointed rows count."""
    n = rows.groupBy("recording_segment").agg(F.count(F.lit(1)).alias("found"))
    joined = n.join(status, "recording_segment", "left")
    return joined.select("recording_segment", "started_at", F.least("found", F.coalesce("rows", F.lit(0))).alias("usable"), F.coalesce(F.col("closed") & F.col("complete") & (F.col("dropped_reads") == 0), F.lit(False)).alias("complete"))


def checkpointed(rows: DataFrame, status: DataFrame) -> DataFrame:
    """Rows within each segment's checkpointed prefix."""
    own = Window.partitionBy("recording_segment").orderBy("sequence")
    return rows.withColumn("_n", F.row_number().over(own)).join(status.select("recording_segment", "rows"), "recording_segment").where("_n <= rows").drop("_n", "rows")


def timestamp_text(spark: SparkSession, path: str) -> DataFrame:
    """(t, fields) of text files with a time first in each line; comments and blank lines are skipped, and a time that is no number is null."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != "")).select(parts[0].try_cast("double").alias("t"), F.slice(parts, 2, 1 << 20).alias("fields"))


def strided(df: DataFrame, index: str, stride: int = 1, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Every stride-th row from offset, the first limit of them."""
    own = df.where((F.col(index) >= offset) & (F.pmod(F.col(index) - offset, F.lit(stride)) == 0))
    return own.where(F.col(index) < offset + limit * stride) if limit else own


def delta_encode(df: DataFrame, keys: list[str], x: str, value: str, bits: int = 16) -> DataFrame:
    """df with delta: the horizontal difference modulo 2^bits."""
    own = Window.partitionBy(*keys).orderBy(x)
    return df.withColumn("delta", F.pmod(F.col(value) - F.coalesce(F.lag(value).over(own), F.lit(0)), F.lit(1 << bits)))


def delta_decode(df: DataFrame, keys: list[str], x: str, delta: str = "delta", bits: int = 16) -> DataFrame:
    """df with value: the running sum of deltas modulo 2^bits."""
    own = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.pmod(F.sum(delta).over(own), F.lit(1 << bits)))


def raw_to_mm(df: DataFrame, lookup: DataFrame, code: str = "code") -> DataFrame:
    """Raw codes to millimetres by a table of up to 2,048 (code, mm) rows (a larger one is an error); codes outside it or without distance give null. Code 0 is a code."""
    if lookup.count() > 2048:
        raise ValueError("more than 2048 codes")
    return df.join(F.broadcast(lookup), code, "left")


def report(df: DataFrame, path: str) -> None:
    """CSV and JSON copies of a report."""
    df.write.option("header", True).csv(f"{path}/csv")
    df.write.json(f"{path}/json")


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    """A project as one Parquet table per part; the manifest goes last, so that a folder with one is whole."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n, 1) for n in tables], "part string, version int").write.parquet(f"{path}/manifest")


def import_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {r.part: spark.read.parquet(f"{path}/{r.part}") for r in spark.read.parquet(f"{path}/manifest").collect()}


def missing_members(archive: DataFrame, local: DataFrame, digest: str) -> DataFrame:
    """Members of an archive whose digest no local capture has."""
    return archive.join(local.select(digest).distinct(), digest, "left_anti")


def compact(frames: DataFrame, accepted: str, index: str) -> DataFrame:
    """Accepted frames under new consecutive indices, with the old ones."""
    from ..operators.sampling import numbered

    return numbered(frames.where(F.col(accepted)), [index], "_n").select(F.col(index).alias("old_index"), (F.col("_n") - 1).alias("new_index"))
