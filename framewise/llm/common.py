"""Helpers that the training-text operators share."""

from __future__ import annotations

import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import BROADCAST_BYTES, broadcast_if_small, materialise, shared_dir, table_bytes

__all__ = ["BROADCAST_BYTES", "LOWER", "broadcast_if_small", "held_out", "join_by_count", "materialise", "shared_dir", "sorted_runs", "table_bytes", "words"]

#: Rows of one key that a task of a join takes, at most about.
HOT = 65_536

#: A-Z to a-z on bytes; other bytes stay.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def held_out(doc_id: str, mod: int, rest: int = 2):
    """Whether crc32 of the id as text leaves that rest. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def words(text: bytes | None) -> list[bytes]:
    """The words of a text, parted by space and 0x09-0x0D, with A-Z lowered."""
    return text.translate(LOWER).split() if text else []


def join_by_count(left: DataFrame, right: DataFrame, key: str, count: str, spread: str, how: str = "inner") -> DataFrame:
    """left joined with right on key. right: materialised, one row a key, with the number of left's rows that have it.

    A small right side is broadcast. Otherwise keys of more than HOT rows are
    dealt into parts by a hash of the column spread, so that none of them is
    the work of one task.
    """
    if table_bytes(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), key, how)
    hot = materialise(right.where(F.col(count) > HOT).select(key, F.ceil(F.col(count) / HOT).cast("int").alias("_parts")), "hot-keys")
    if hot.isEmpty():
        return left.join(right.hint("merge"), key, how)
    parts, hot = F.coalesce("_parts", F.lit(1)), broadcast_if_small(hot)
    left = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), parts).cast("int")).drop("_parts")
    right = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right.hint("merge"), [key, "_part"], how).drop("_part")


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows that agree in the first columns, of batches that are sorted by them; only one run is held."""
    held: list[pa.RecordBatch] = []
    at = None
    for b in batches:
        rows = list(zip(*(b.column(k).to_pylist() for k in range(keys)), strict=True))
        start = 0
        for k in range(len(rows)):
            if rows[k] != at:
                if k > start:
                    held.append(b.slice(start, k - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, at = [], k, rows[k]
        if len(rows) > start:
            held.append(b.slice(start))
    if held:
        yield pa.Table.from_batches(held)
