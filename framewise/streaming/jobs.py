"""Stateful pairing, gap sessions, rate limits and idempotent ingestion as streams.

State is keyed by stream key (and so by generation). Streams are read with
declared schemas, and every job ends in a file sink with a checkpoint in the
shared folder, so that a restart goes on where it stopped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.geometry import wrap_delta
from ..plans.shared import shared_dir

#: Depth rows that wait for a colour row, and colour rows that wait for depth.
HISTORY = 8


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file or folder as a stream."""
    schema = spark.read.parquet(path).schema
    at = PurePosixPath(path.partition("://")[2] or path)
    parent = path[: -len(at.name) - 1]
    return spark.readStream.schema(schema).option("pathGlobFilter", at.name).option("recursiveFileLookup", "false").parquet(parent)


def with_end(stream: DataFrame, end) -> DataFrame:
    """A finite stream with one more row behind it, null but for ts = end, that moves the watermark past all windows still open.

    Drop it, by its null key, from what was written: a filter in the stream
    would move before the watermark.
    """
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/end-{uuid.uuid4().hex}"
    row = spark.createDataFrame([(end,)], "ts timestamp").select(*(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields))
    row.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there now (availableNow) into Parquet files, and reads them."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def pair_step(waiting: list[tuple[float, int]], pending: tuple[float, int] | None, depth: list[tuple[float, int]], colour: list[tuple[float, int]], tolerance: float) -> tuple[list, tuple | None, list[tuple]]:
    """Feeds a batch in time order through the pairer: (waiting depth, pending colour, pairs).

    Only the newest colour row waits; it is decided when depth has reached its
    time, by the nearest depth row (the first of two), and used or not it is
    done. The depth row and older ones are consumed.
    """
    pairs = []
    for t, kind, i in sorted([(t, 0, i) for t, i in depth] + [(t, 1, i) for t, i in colour]):
        if kind:
            pending = (t, i)
        else:
            waiting = [*waiting, (t, i)][-HISTORY:]
        if pending is not None and waiting and waiting[-1][0] >= pending[0]:
            k = min(range(len(waiting)), key=lambda k: (abs(waiting[k][0] - pending[0]), k))
            if abs(waiting[k][0] - pending[0]) <= tolerance:
                pairs.append((pending[1], waiting[k][1], pending[0], waiting[k][0]))
                waiting = waiting[k + 1 :]
            pending = None
    return waiting, pending, pairs


def stream_pairing(stream: DataFrame, key: str, tolerance: float, quiet: str = "10 minutes") -> DataFrame:
    """Pairs per key from a stream (key, id, t double, ts timestamp, kind 'a' or 'b'); state ends when event time is quiet past a key's last row."""
    ms = int(pd.Timedelta(quiet).total_seconds() * 1000)

    def run(group_key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, ids, wait_t, wait_i = state.get if state.exists else ([], [], None, None)
        waiting, pending = list(zip(times, ids, strict=True)), None if wait_t is None else (wait_t, wait_i)
        rows = pd.concat(frames)
        side = lambda k: list(zip(rows.loc[rows.kind == k, "t"].tolist(), rows.loc[rows.kind == k, "id"].tolist(), strict=True))
        waiting, pending, pairs = pair_step(waiting, pending, side("b"), side("a"), tolerance)
        state.update(([t for t, _ in waiting], [i for _, i in waiting], pending and pending[0], pending and pending[1]))
        last = int(rows["ts"].max().timestamp() * 1000)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + ms)
        yield pd.DataFrame([(group_key[0], *p) for p in pairs], columns=["key", "a_id", "b_id", "a_t", "b_t"])

    return stream.withWatermark("ts", quiet).groupBy(key).applyInPandasWithState(run, "key long, a_id long, b_id long, a_t double, b_t double", "times array<double>, ids array<long>, pending_t double, pending_id long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_gap_sessions(stream: DataFrame, key: str, gap: str, late: str) -> DataFrame:
    """Sessions per key that a gap without rows ends: key, start, end, n. Stream: ts timestamp. A session is out once the watermark passed it; for a finite stream see with_end."""
    sessions = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), key).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"))
    return sessions.select(key, "start", "end", "n")


def stream_rate_limit(stream: DataFrame, key: str, interval: float) -> DataFrame:
    """Rows (key, id, t) that follow the last taken one of their key by interval."""

    def run(group_key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        taken = []
        for row in pd.concat(frames).sort_values(["t", "id"]).itertuples():
            if last is None or row.t - last + 1e-9 >= interval:
                last = row.t
                taken.append((group_key[0], row.id, row.t))
        state.update((last,))
        yield pd.DataFrame(taken, columns=["key", "id", "t"])

    return stream.groupBy(key).applyInPandasWithState(run, "key long, id long, t double", "last double", "append", GroupStateTimeout.NoTimeout)


def stream_receipts(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each upload once: later rows of the same keys within the watermark are dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def stream_windows(stream: DataFrame, keys: list[str], width: str, late: str) -> DataFrame:
    """Rows per tumbling window and key, once the watermark passed the window."""
    own = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return own.select(F.col("w.start").alias("start"), *keys, "n")


def upsert_fold(stream: DataFrame, path: str, keys: list[str]):
    """Folds micro-batches (keys, tsdf, w, n) into a versioned table: each batch writes the next version whole, so a repeated batch gives the same and a failed one leaves the last."""
    from ..operators.voxel import fold_into

    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        before = f"{path}/version={number - 1}"
        state = spark.read.parquet(before) if number else batch.limit(0)
        fold_into(state, batch, keys).write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()


def wrapped_delta_ms(a, b):
    """Milliseconds between wrapping 60 MHz ticks, for streams that carry ticks."""
    return wrap_delta(a, b, 60_000.0)
