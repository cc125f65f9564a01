"""Printed marks with an identity: gates of one picture and candidates by shared marks."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .sampling import top_k
from .sequence import bank_lists, bank_pairs


def _distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def mark_gate(marks: DataFrame, frame: str, ident: str, key: str, corners: str, near: float = 5.0, side: float = 20.0) -> DataFrame:
    """marks with state: repeated, overlapping, small or usable (the first that holds).

    corners: four structs (x, y) in order. A key that a frame holds twice is
    repeated. Two marks overlap when, in one of four turns, all corners lie
    within `near`; then their centres do too, so marks meet only in squares of
    that size and the ones around. A mark without corners is small.
    """
    centre = lambda axis: F.aggregate("_c", F.lit(0.0), lambda s, c: s + c[axis] / 4)
    shapes = marks.groupBy(frame, F.col(corners).alias("_c")).agg(F.min(ident).alias("_low"), F.max(ident).alias("_high"))
    own = shapes.withColumns({"_x": F.floor(centre("x") / near), "_y": F.floor(centre("y") / near)})
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in itertools.product((-1, 0, 1), repeat=2))))
    left = own.select(frame, F.col("_c").alias("_a"), "_x", "_y", moves.alias("_m"))
    left = left.select(frame, "_a", (F.col("_x") + F.col("_m.a")).alias("_x"), (F.col("_y") + F.col("_m.b")).alias("_y"))
    met = left.join(own.select(frame, F.col("_c").alias("_b"), "_low", "_high", "_x", "_y").hint("merge"), [frame, "_x", "_y"])
    turns = [F.greatest(*(_distance(F.col("_a")[i], F.col("_b")[(i + k) % 4]) for i in range(4))) for k in range(4)]
    # Of the marks near a shape, one has another ident than a mark's own if the smallest or the largest has.
    close = met.where(F.least(*turns) < near).groupBy(frame, F.col("_a").alias(corners)).agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    shortest = F.least(*(_distance(F.col(corners)[i], F.col(corners)[(i + 3) % 4]) for i in range(4)))
    twice = F.count(F.lit(1)).over(Window.partitionBy(frame, key)) > 1
    is_close = (F.col("_low") != F.col(ident)) | (F.col("_high") != F.col(ident))
    state = F.when(F.col("_twice"), "repeated").when(is_close, "overlapping").when(F.coalesce(shortest >= side, F.lit(False)), "usable").otherwise("small")
    return marks.withColumn("_twice", twice).join(close.hint("merge"), [frame, corners], "left").withColumn("state", state).select(*marks.columns, "state")


def _sorted(*columns: np.ndarray) -> list[np.ndarray]:
    """Columns of whole numbers in order of their rows; as one number a row where that fits, which sorts much faster."""
    low = [int(c.min()) if len(c) else 0 for c in columns]
    bits = [((int(c.max()) if len(c) else 0) - a).bit_length() for c, a in zip(columns, low, strict=True)]
    if sum(bits) > 62:
        order = np.lexsort(columns[::-1])
        return [c[order] for c in columns]
    key = np.zeros(len(columns[0]), np.int64)
    for c, a, n in zip(columns, low, bits, strict=True):
        key = (key << n) | (c - a)
    key, out = np.sort(key), []
    for a, n in zip(low[::-1], bits[::-1], strict=True):
        out.append((key & ((1 << n) - 1)) + a)
        key = key >> n
    return out[::-1]


def _most_shared(batches: Iterator[pa.RecordBatch], k: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (j, near, far) in order of j: per j the k values of its lists that occur most, of equal ones the largest. near counts back from j."""

    def best(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        j, parts = rows.column("j").to_numpy(), []
        for name in ("near", "far"):
            lists = rows.column(name).chunk(0)
            of, value = np.asarray(pc.list_parent_indices(lists)), lists.flatten().to_numpy().astype(np.int64)
            parts.append((j[of], j[of] - value if name == "near" else value))
        js, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        js, values = _sorted(js, values)
        first = np.flatnonzero(np.r_[len(js) > 0, (js[1:] != js[:-1]) | (values[1:] != values[:-1])][: len(js)])
        shared = np.diff(np.r_[first, len(js)])
        js, shared, values = _sorted(js[first], -shared, -values[first])
        shared, values = -shared, -values
        rank = np.arange(len(js)) - np.searchsorted(js, js) + 1
        kept = rank <= k
        return pa.RecordBatch.from_arrays([pa.array(x[kept]).cast(f.type) for x, f in zip((js, values, shared, rank), schema, strict=True)], schema=schema)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        j = batch.column(0)
        if held and held[-1].column(0)[-1] != j[len(j) - 1] or not held:
            # The last j of the batch may go on in the next one.
            start = int(np.searchsorted(j.to_numpy(), j[len(j) - 1].as_py()))
            whole = pa.Table.from_batches([*held, batch.slice(0, start)])
            if len(whole):
                yield best(whole)
            held = []
            batch = batch.slice(start)
        held.append(batch)
    if held:
        yield best(pa.Table.from_batches(held))


def shared_candidates(marks: DataFrame, frame: str, key: str, k: int = 5, **bank: int) -> DataFrame:
    """(j, i, shared, rank): each frame j's k earlier frames with most marks in common, of equal ones the latest.

    Earlier observers of a mark come from its bank (`sequence.bank_lists`), so
    a mark that all frames see gives a bounded number of partners a frame.
    Numbered frames shuffle one list a mark, of steps back, which are counted
    where the frame's lists meet; no pair of frames is shuffled.
    """
    kind = marks.schema[frame].dataType
    if not isinstance(kind, IntegralType):
        shared = bank_pairs(marks, key, frame, **bank).groupBy("j", "i").agg(F.count(F.lit(1)).alias("shared"))
        return top_k(shared, ["j"], [F.desc("shared"), F.desc("i")], k)
    j = F.col("j")
    lists = bank_lists(marks, key, frame, **bank).where(F.size("earlier") > 0).select(j.cast("long").alias("j"), F.col("earlier").cast("array<long>").alias("earlier"))
    fits = F.coalesce(F.try_subtract(j, F.array_min("earlier")) <= 2**31 - 1, F.lit(False))
    near, far = F.when(fits, F.transform("earlier", lambda i: (j - i).cast("int"))), F.when(~fits, F.col("earlier"))
    out = f"j {kind.simpleString()}, i {kind.simpleString()}, shared long, rank int"
    types = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64()}
    schema = pa.schema([("j", types[kind.simpleString()]), ("i", types[kind.simpleString()]), ("shared", pa.int64()), ("rank", pa.int32())])
    rows = lists.select("j", near.alias("near"), far.alias("far")).repartition("j").sortWithinPartitions("j")
    return rows.mapInArrow(lambda batches: _most_shared(batches, k, schema), out)
