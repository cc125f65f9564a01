"""The shared folder, lineage cuts by written tables, and broadcasts behind a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

#: A side of a join is broadcast up to this many measured bytes; a row counts for ROW_BYTES and its values.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 32


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where the setting is unset on one machine (local master) a temporary
    folder is set; on a cluster an unset setting is an error, as a folder of
    one machine would lose rows of the others.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="framewise-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _width(column, kind: DataType):
    """Bytes that a value takes, about: texts by their length, arrays by their elements."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(kind, ArrayType):
        each = F.transform(column, lambda x: _width(x, kind.elementType))
        return F.coalesce(F.aggregate(each, F.lit(0).cast("long"), lambda a, b: a + b + 8), F.lit(0).cast("long"))
    if isinstance(kind, StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(0).cast("long"))
    return F.lit(8).cast("long")


def table_bytes(df: DataFrame) -> int:
    """The measured size of df's rows in memory, about: one aggregation over df, which should be materialised."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES).cast("long"))
    return df.agg(F.sum(row)).first()[0] or 0


def broadcast_if_small(df: DataFrame, row_bytes: int | None = None, limit: int | None = None) -> DataFrame:
    """Hints a broadcast when the measured bytes of df stay under limit (BROADCAST_BYTES); else a sort-merge join.

    With row_bytes rows are counted instead. df should be materialised.
    """
    size = table_bytes(df) if row_bytes is None else df.count() * row_bytes
    return F.broadcast(df) if size <= (BROADCAST_BYTES if limit is None else limit) else df.hint("merge")
