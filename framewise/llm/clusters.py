"""Centroid clustering with Yinyang bounds, in exact integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Components of a vector, what they are multiplied by, clusters and rounds.
DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Groups that the centroids are parted into, once, and the rounds of that.
GROUPS, GROUP_ROUNDS = 4, 5
#: Vectors with a component this large are returned without a cluster: sums of their squared distances may not fit a long.
LARGE = 1 << 20
#: Integers up to this one give exact products and sums in double precision.
_EXACT = 1 << 22

STATE = "vec_id string, v array<int>, cluster int, upper double, lower array<double>, distance long"


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to centroids."""
    if not len(v) or not len(c):
        return np.zeros((len(v), len(c)), np.int64)
    if max(np.abs(v).max(), np.abs(c).max()) <= _EXACT:
        f, g = v.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)[None, :]).astype(np.int64)
    return np.stack([((v.astype(np.int64) - x) ** 2).sum(1) for x in c.astype(np.int64)], axis=1)


def grouped(c: np.ndarray, groups: int) -> np.ndarray:
    """A group for each centroid: some rounds of clustering the centroids themselves."""
    groups = max(1, min(groups, len(c)))
    mid = c[:groups].astype(np.float64)
    for _ in range(GROUP_ROUNDS):
        of = ((c[:, None, :] - mid[None]) ** 2).sum(2).argmin(1)
        mid = np.stack([c[of == g].mean(0) if (of == g).any() else mid[g] for g in range(groups)])
    return of


class Assigner:
    """Assigns integer vectors to the nearest of some centroids, by bounds that earlier rounds left.

    ``upper`` bounds the distance to the own centroid from above, ``lower`` has
    one bound for each group of centroids, from below, on the distance to any
    of them but the own one. Bounds follow the centroids' moves. A vector whose
    upper bound is under all lower ones keeps its centroid (the global filter,
    once more with the exact upper bound); of the others, only groups whose
    lower bound doesn't exceed the upper one are looked at (the group filter),
    and all centroids of these are scanned exactly. Bounds leave room for
    rounding; equal distances always come to the scan, where the smaller number wins.
    """

    def __init__(self, centroids: np.ndarray, group: np.ndarray, before: np.ndarray | None = None):
        self.c, self.group, self.n = centroids, group, int(group.max()) + 1
        self.moved = None
        if before is not None:
            self.moved = np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
            self.group_moved = np.array([self.moved[group == g].max(initial=0) for g in range(self.n)])

    def first(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cluster, upper and lower by a scan of all centroids."""
        d = squared(v, self.c)
        own = d.argmin(1)
        return own.astype(np.int32), np.sqrt(d[np.arange(len(v)), own]), self._lower(d, own)

    def _lower(self, d: np.ndarray, own: np.ndarray) -> np.ndarray:
        rest = d.astype(np.float64)
        rest[np.arange(len(d)), own] = np.inf
        return np.sqrt(np.stack([rest[:, self.group == g].min(1, initial=np.inf) for g in range(self.n)], axis=1))

    def own(self, v: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Exact squared distances to the own centroids."""
        return ((v.astype(np.int64) - self.c[cluster]) ** 2).sum(1)

    def again(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cluster, upper and lower after the centroids moved."""
        cluster, upper, lower = cluster.copy(), upper + self.moved[cluster], lower - self.group_moved
        may = lambda low, up: low <= up + 1e-6 * (1 + up)
        at = np.flatnonzero(may(lower.min(1), upper))
        exact = self.own(v[at], cluster[at])
        upper[at] = np.sqrt(exact)
        still = may(lower[at].min(1), upper[at])
        at, exact = at[still], exact[still]
        if not len(at):
            return cluster, upper, lower
        none = np.iinfo(np.int64).max
        d = np.full((len(at), len(self.c)), none)
        seen = may(lower[at], upper[at, None])
        for g in range(self.n):
            rows, members = np.flatnonzero(seen[:, g]), np.flatnonzero(self.group == g)
            if len(rows):
                d[np.ix_(rows, members)] = squared(v[at[rows]], self.c[members])
        old = cluster[at]
        d[np.arange(len(at)), old] = exact
        new = d.argmin(1)
        fresh = self._lower(np.where(d == none, np.inf, d), new)
        lower[at] = np.where(seen, fresh, np.minimum(lower[at], fresh))
        cluster[at], upper[at] = new, np.sqrt(d[np.arange(len(at)), new])
        return cluster, upper, lower


def _assigned(state: DataFrame, work: Assigner, final: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
            if work.moved is None:
                cluster, upper, lower = work.first(v)
            else:
                old = b.column(4).flatten().to_numpy().reshape(b.num_rows, -1)
                cluster, upper, lower = work.again(v, b.column(2).to_numpy(), b.column(3).to_numpy(), old)
            low = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * work.n), pa.array(lower.ravel()))
            distance = pa.array(work.own(v, cluster)) if final else pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(upper), low, distance], ["vec_id", "v", "cluster", "upper", "lower", "distance"])

    return state.mapInArrow(run, STATE.replace("vec_id string", f"vec_id {state.schema['vec_id'].dataType.simpleString()}"))


def yinyang(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, groups: int = GROUPS, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Components count as floor(64 * x). Only vectors of the given dimension
    without null or non-finite components are returned. Centroids start as the
    vectors with the smallest SHA-256 of ``1:<vec_id>`` (of equal ones the
    smaller vector; a null id never starts one; fewer vectors than clusters
    start fewer). Each round assigns every vector and replaces each centroid
    that has vectors by their mean, rounded down; then all are assigned once
    more. The bounds of a vector are written beside it each round; sums of a
    round combine in every task, so one large cluster isn't one task's.
    The driver holds the centroids only: clusters times dimensions integers.

    Repeated ids and vectors are rows of their own. Vectors with a component of
    LARGE or more in size take no part, and have a null cluster, distance and
    digest. inertia is null where a sum doesn't fit a long. No vectors, or
    none with an id, give no clusters. Extra columns aren't read.
    """
    x = F.col(vec_col)
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select(F.col(id_col).alias("vec_id"), x.cast("array<double>").alias("x")).where((F.size("x") == dimensions) & finite)
    small = F.forall("x", lambda c: F.abs(c) < LARGE)
    state = materialise(kept.where(small).select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE).cast("int")).alias("v")), "clusters-vectors")
    seed = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    start = state.where("vec_id is not null").select(seed.alias("h"), "v").orderBy("h", "v").limit(clusters).collect()
    large = kept.where(~small).select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"))))
    if not start:
        none = state.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"))))
        return none.unionAll(large).select("*", F.lit(None).cast("long").alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))

    at, before = np.array([r.v for r in start], np.int64), None
    group = grouped(at, groups)
    state = state.select("*", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("upper"), F.lit(None).cast("array<double>").alias("lower"), F.lit(None).cast("long").alias("distance"))
    for k in range(rounds + 1):
        state = materialise(_assigned(state, Assigner(at, group, before), k == rounds), "clusters-state")
        if k < rounds:
            before, at = at, at.copy()
            sums = state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(F.get("v", F.lit(i))) for i in range(dimensions))).alias("s"))
            for r in sums.collect():  # one row a cluster
                at[r.cluster] = [s // r.n for s in r.s]

    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(at.tolist())]
    named = vectors.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    per = materialise(state.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")), "clusters-inertia")
    total = per.agg(F.when(F.count("cluster_inertia") == F.count(F.lit(1)), F.try_sum("cluster_inertia")).alias("s")).first().s
    done = state.select("vec_id", "cluster", "distance").join(F.broadcast(per), "cluster").join(F.broadcast(named), "cluster")  # clusters rows each
    cols = ("vec_id", "cluster", "distance", "cluster_inertia")
    done = done.select(*cols, F.lit(total).cast("long").alias("inertia"), "centroid_sha256")
    return done.unionAll(large.select(*cols, F.lit(total).cast("long").alias("inertia"), F.lit(None).cast("string")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The rounds, one after the other."""
    parts = [
        f"kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept) ORDER BY h, v LIMIT {CLUSTERS})",
    ]
    for i in range(ROUNDS + 1):
        far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"d{i} AS (SELECT r, k, CAST({far} AS BIGINT) AS d FROM kept, c{i})")
        parts.append(f"a{i} AS (SELECT r, k, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if i < ROUNDS:
            parts.append(f"u{i} AS (SELECT k, j, sum(v[j]) AS s, count(*) AS n FROM kept JOIN a{i} USING (r), LATERAL (SELECT unnest(range(1, {DIMENSIONS + 1})) AS j) GROUP BY k, j)")
            parts.append(f"m{i} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM u{i} GROUP BY k)")
            parts.append(f"c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (k))")
    last = f"SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN kept USING (r) JOIN c{ROUNDS} USING (k)"
    return "WITH " + ",\n".join(parts) + "\n" + last


SQL = _sql()
