"""Text features of whole documents: word shapes, pairs of shapes, repeats and hashed words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of a word's letters, of its end, and of its length.
CASES, ENDS, LENGTHS = 6, 6, 3
SHAPES = CASES * ENDS * LENGTHS
COARSE = CASES * ENDS
#: Buckets of hashed words.
HASHED = 1024
SIZE = SHAPES + COARSE * COARSE + 2 + HASHED
#: Bytes of a worker's cache of words, at most about.
CACHE = 32 << 20


def _shape(word: str) -> int:
    core = word.strip(".,;:?!'\"()-")
    if not core:
        case = 0
    elif any(c.isdigit() for c in core):
        case = 1
    elif not any(c.isalpha() for c in core):
        case = 2
    elif core.isupper() and len(core) > 1:
        case = 3
    elif core[0].isupper():
        case = 4
    else:
        case = 5
    last = word[-1]
    end = 0 if last.isalnum() else 1 if last in ".?" else 2 if last in ",;:" else 3 if last == "!" else 4 if word[-2:-1] == last else 5
    return (case * ENDS + end) * LENGTHS + (len(core) > 2) + (len(core) > 6)


class _Words(dict):
    """word -> shape + SHAPES * hashed bucket."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 130
        if self.held > CACHE:
            self.clear()
            self.held = len(word) + 130
        text = word.decode()
        self[word] = found = _shape(text) + SHAPES * (xxhash.xxh3_64_intdigest(text.lower().strip(".,;:?!'\"()-*$%&#|").encode()) % HASHED)
        return found


def counts(text: bytes | None, cache: _Words) -> tuple[np.ndarray, int]:
    """Counts of a text's features, and its number of words."""
    out = np.zeros(SIZE, np.float32)
    own = text.split() if text else []
    if not own:
        return out, 0
    both = np.fromiter(map(cache.__getitem__, own), np.int64, len(own))
    shape, bucket = both % SHAPES, both // SHAPES
    coarse = shape // LENGTHS
    out[:SHAPES] = np.bincount(shape, minlength=SHAPES)
    out[SHAPES : SHAPES + COARSE * COARSE] = np.bincount(coarse[:-1] * COARSE + coarse[1:], minlength=COARSE * COARSE)
    repeats = int(np.count_nonzero(both[1:] == both[:-1]))
    out[-HASHED - 2], out[-HASHED - 1] = repeats, len(own) - 1 - repeats
    out[-HASHED:] = np.bincount(bucket, minlength=HASHED)
    return out, len(own)


def weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Relative counts, damped and weighted by idf, each row of length 1 (or 0). Shapes and words weigh alike."""
    out = np.sqrt(raw)
    for a, b in ((0, SIZE - HASHED), (SIZE - HASHED, SIZE)):
        out[:, a:b] *= idf[a:b]
        norm = np.linalg.norm(out[:, a:b], axis=1, keepdims=True)
        out[:, a:b] /= np.where(norm > 0, norm, 1) * np.sqrt(2)
    return out


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents in which each feature occurs, and documents, over all rows. Sums of partitions meet by aggregation; SIZE numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, df, n = _Words(), np.zeros(SIZE, np.int64), 0
        for b in batches:
            for text in b.column(0):
                df += counts(text.as_py(), cache)[0] > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SIZE + 1), pa.int32()), pa.array(np.append(df, n), pa.int64())], ["feature", "n"])

    parts = docs.select(F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, "feature int, n long")
    df = np.zeros(SIZE + 1, np.int64)
    for k, n in parts.groupBy("feature").agg(F.sum("n")).collect():
        df[k] = n
    return df[:-1], int(df[-1])


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((n + 1) / (df + 1)) + 0.1).astype(np.float32)


def sample_features(docs: DataFrame, ids: DataFrame, text_col: str = "text") -> tuple[list[tuple], np.ndarray]:
    """The rows of ids (doc_id and more columns, of bounded number) and the counts of their texts, on the driver.

    ids is a bounded sample of labelled rows; its bound is the caller's
    documented parameter. Of rows that share an id the one with the least text
    counts.
    """
    more = [c for c in ids.columns if c != "doc_id"]
    joined = docs.select("doc_id", F.col(text_col).cast("string").cast("binary").alias("text")).join(F.broadcast(ids), "doc_id")
    joined = joined.groupBy("doc_id", *more).agg(F.min("text").alias("text"))
    at = len(more) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for b in batches:
            where, value = [], []
            for text in b.column(at):
                c = counts(text.as_py(), cache)[0]
                k = np.flatnonzero(c)
                where.append(k.astype(np.int32)), value.append(c[k])
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(where, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], [*b.schema.names[:at], "k", "v"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:at])
    rows = joined.mapInArrow(run, f"{kinds}, k array<int>, v array<float>").toArrow()
    head = [tuple(r.values()) for r in rows.select(rows.column_names[:at]).to_pylist()]
    order = sorted(range(len(head)), key=lambda i: tuple((x is None, x) for x in head[i]))
    x = np.zeros((len(head), SIZE), np.float32)
    for row, i in enumerate(order):
        x[row, rows.column("k")[i].values.to_numpy()] = rows.column("v")[i].values.to_numpy()
    return [head[i] for i in order], x
