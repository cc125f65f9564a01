"""Approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise, shared_dir
from .elias_fano import Levels, pack, write_shared

#: Trees, bits of a tree's hash strings, and the power of a band's rows that the trees offer together, with MORE, before the ascent ends (distinct rows).
TREES, BITS, POWER, MORE = 64, 32, 0.9, 128
#: Rows of a shard, and queries that meet a shard at once, at most about; partitions of their meetings, at most.
SHARD, QUERIES, VISITS = 32_768, 4_096, 10_000
#: A band of a shard has rows down to 1 / RATIO of its longest one's length, and LEAST rows at least, if there are.
RATIO, LEAST = 1.25, 256


def band_ends(lengths: np.ndarray) -> np.ndarray:
    """Where the bands of rows by falling length end."""
    ends, start = [], 0
    while start < len(lengths):
        alike = int(np.searchsorted(-lengths, -lengths[start] / RATIO, side="right"))
        start = min(max(alike, start + LEAST), len(lengths))
        ends.append(start)
    return np.array(ends, np.int64)


class Forest:
    """Sorted arrays of long hash strings, one per tree, over vectors of about one length.

    A string's bits are sides of random planes. Vectors get one more component
    that makes their lengths equal, so that nearness of direction is nearness
    by inner product.
    """

    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 7):
        self.exact, self.vectors = vectors, vectors.astype(np.float32)
        self.planes = self._planes(vectors.shape[1], trees, seed)
        squares = (self.vectors.astype(np.float64) ** 2).sum(axis=1)
        rest = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0)).astype(np.float32)
        keys = self._strings(self.vectors, rest)
        self.order = np.argsort(keys, axis=0, kind="stable").T.astype(np.int32)
        self.keys = np.take_along_axis(keys.T, self.order, axis=1)

    @classmethod
    def of(cls, exact: np.ndarray, vectors: np.ndarray, planes: np.ndarray, order: np.ndarray, keys: np.ndarray) -> Forest:
        """A forest made before."""
        own = cls.__new__(cls)
        own.exact, own.vectors, own.planes, own.order, own.keys = exact, vectors, planes, order, keys
        return own

    @staticmethod
    def _planes(dimensions: int, trees: int, seed: int) -> np.ndarray:
        return np.random.default_rng(seed).standard_normal((dimensions + 1, trees * BITS), np.float32)

    def _strings(self, vectors: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = []
        for k in range(0, len(vectors), 2048):
            part = np.concatenate([vectors[k : k + 2048], rest[k : k + 2048, None]], axis=1)
            bits = (part @ self.planes) > 0
            out.append(np.packbits(bits.reshape(len(part), -1, BITS), axis=2).view(">u4")[..., 0].astype(np.uint32))
        return np.concatenate(out) if out else np.zeros((0, self.planes.shape[1] // BITS), np.uint32)

    def candidates(self, queries: np.ndarray, power: float, own: list[np.ndarray], k: int):
        """Yields each query's candidate rows, without its own ones (row numbers).

        Each tree is descended to the longest prefix that it shares with the
        query; then all trees ascend together, a bit at a time, until they
        offer k distinct rows, and MORE and the band's rows to the power
        given, or all there are. A level is taken whole.
        """
        n, trees = len(self.vectors), len(self.keys)
        depths = range(BITS, 0, -1)
        seen = np.zeros(n, bool)
        for first in range(0, len(queries), 256):
            part = queries[first : first + 256]
            strings = self._strings(part.astype(np.float32), np.zeros(len(part), np.float32)).astype(np.int64)
            # Per level, tree and query the first row and the end of the shared prefix; the last level is the root.
            lo, hi = np.zeros((len(depths) + 1, trees, len(part)), np.int32), np.full((len(depths) + 1, trees, len(part)), n, np.int32)
            for level, depth in enumerate(depths):
                low = strings >> (BITS - depth) << (BITS - depth)
                high = low + (1 << (BITS - depth))
                for t in range(trees):
                    lo[level, t] = np.searchsorted(self.keys[t], low[:, t])
                    hi[level, t] = np.searchsorted(self.keys[t], high[:, t])
            sums = (hi - lo).sum(axis=1, dtype=np.int64)
            for q in range(len(part)):
                mine = own[first + q]
                need = min(n - len(mine), max(k, math.ceil(n**power) + MORE))
                level = int(np.argmax(sums[:, q] >= need))  # fewer offers can't be enough distinct rows
                old_lo = old_hi = lo[level, :, q]
                while True:
                    for t in range(trees):
                        seen[self.order[t, lo[level, t, q] : old_lo[t]]] = True
                        seen[self.order[t, old_hi[t] : hi[level, t, q]]] = True
                    seen[mine] = False
                    found = np.flatnonzero(seen)
                    if len(found) >= need:
                        break
                    old_lo, old_hi = lo[level, :, q], hi[level, :, q]
                    level += 1
                seen[found] = False
                yield found


class Shard:
    """Forests over one shard's vectors, a band of lengths each, the longest vectors first.

    In one forest over all, the component that evens out lengths would drown
    the directions of short vectors. A query goes through the bands in order
    and leaves off where no vector of a band is long enough to come among its
    best ones, which loses nothing.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, trees: int = TREES, seed: int = 7):
        lengths = np.linalg.norm(vectors.astype(np.float64), axis=1)
        order = np.argsort(-lengths, kind="stable")
        self.ids, self.lengths, self.ends = ids[order], lengths[order], band_ends(lengths[order])
        exact = vectors[order]
        self.bands = [Forest(exact[a:b], trees, seed) for a, b in self._spans()]

    def _spans(self) -> list[tuple[int, int]]:
        return list(zip([0, *self.ends[:-1]], self.ends, strict=True)) if len(self.ends) else []

    def image(self) -> bytes:
        """The shard as a file that Shard.mapped reads."""
        join = lambda name, axis: np.concatenate([getattr(f, name) for f in self.bands], axis=axis)
        return pack(ids=self.ids, lengths=self.lengths, ends=self.ends, exact=join("exact", 0), vectors=join("vectors", 0), order=join("order", 1), keys=join("keys", 1))

    @classmethod
    def mapped(cls, path: str, seed: int = 7) -> Shard:
        """A shard in a file of the shared folder, memory-mapped."""
        own, level = cls.__new__(cls), Levels.from_path(path)
        own.ids, own.lengths, own.ends = level.ids, level.lengths, level.ends
        planes = Forest._planes(level.vectors.shape[1], len(level.keys), seed)
        own.bands = [Forest.of(level.exact[a:b], level.vectors[a:b], planes, level.order[:, a:b], level.keys[:, a:b]) for a, b in own._spans()]
        return own

    def search(self, queries: np.ndarray, query_ids: np.ndarray, k: int, power: float = POWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of each query's k best candidates, by double-precision inner products, ties to smaller ids."""
        asked = queries.astype(np.float64)
        sizes = np.linalg.norm(asked, axis=1)
        ids, scores = [np.zeros(0, np.int64)] * len(asked), [np.zeros(0, np.float64)] * len(asked)
        worst = np.full(len(asked), -np.inf)  # a query's k-th best score so far
        for forest, (start, end) in zip(self.bands, self._spans(), strict=True):
            longest = float(self.lengths[start])
            open_ = np.flatnonzero(worst <= longest * sizes * (1 + 1e-9))
            band = self.ids[start:end]
            order = np.argsort(band, kind="stable")
            left, right = (np.searchsorted(band, query_ids[open_], side, sorter=order) for side in ("left", "right"))
            own = [order[a:b] for a, b in zip(left, right, strict=True)]
            for q, found in zip(open_, forest.candidates(queries[open_], power, own, k), strict=True):
                if len(found) > k:
                    rough = forest.vectors[found] @ queries[q].astype(np.float32)
                    found = found[rough >= np.partition(rough, -k)[-k] - 4e-6 * longest * sizes[q]]
                all_ids = np.concatenate([ids[q], band[found]])
                all_scores = np.concatenate([scores[q], forest.exact[found].astype(np.float64) @ asked[q]])
                best = np.lexsort((all_ids, -all_scores))[:k]
                ids[q], scores[q] = all_ids[best], all_scores[best]
                if len(best) == k:
                    worst[q] = scores[q][-1]
        rows = np.repeat(np.arange(len(asked)), [len(x) for x in ids])
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        return rows, join(ids, np.int64), join(scores, np.float64)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v, dim) of rows with an id whose vectors are neither null nor zero and hold finite numbers only."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim"))


def build_forests(rows: DataFrame) -> DataFrame:
    """(dim, shard, path): every row indexed once; each shard of about SHARD rows, dealt by a hash, is a file of forests, one a band of lengths, of the shared folder."""
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    shards = max(1, math.ceil(rows.count() / SHARD))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def build(group: pa.Table) -> pa.Table:
        dim, shard = group.column("dim")[0].as_py(), group.column("shard")[0].as_py()
        ids, v = group.column("id").to_numpy(), _vectors(group)
        path = f"{folder}/{dim}-{shard}"
        write_shared(path, Shard(ids, v).image())
        return pa.table({"dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "path": [path]})

    return materialise(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, path string"), "forests")


def _vectors(group: pa.Table) -> np.ndarray:
    v = group.column("v").combine_chunks()
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy().reshape(group.num_rows, -1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", power: float = POWER) -> DataFrame:
    """Each query's k nearest rows by inner product: query_id, rank, vec_id, score.

    Every row is indexed, once. Blocks of queries visit the forests of their
    dimension, which are mapped from the shared folder, so that only queries
    are copied to shards; the k best of each shard meet in a ranking by query.
    A query's own id is no candidate. With fewer candidates than k all are
    returned. Equal vectors share their hash strings, and a prefix is taken
    with all its rows, so ties are whole. Null, zero and non-finite vectors
    take no part; queries that repeat an id are searched each by its own
    vector, equal ones once, and none of them is a candidate of another; empty
    tables give no rows; extra columns are not read.
    """
    forests, asked = build_forests(usable(vectors, id_col, vector_col)), usable(queries, id_col, vector_col).dropDuplicates(["id", "v"])
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    visits = asked.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int")).join(broadcast_if_small(forests), "dim")

    def visit(group: pa.Table) -> pa.Table:
        shard = Shard.mapped(group.column("path")[0].as_py())
        ids, v = group.column("id").to_numpy(), _vectors(group)
        q, i, s = shard.search(v, ids, k, power)
        mark = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in v], np.uint64).view(np.int64)
        return pa.table({"query_id": ids[q], "mark": mark[q], "vec_id": i, "score": s})

    # As many tasks as visits, which are few rows but much work.
    visits = visits.repartition(min(max(1, forests.count() * blocks), VISITS), "path", "block")
    found = visits.groupBy("path", "block").applyInArrow(visit, "query_id long, mark long, vec_id long, score double")
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
