"""Nearest-neighbour joins over vectors and points."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..functions.geometry import cell
from ..plans.shared import materialise

#: Rows of a block: the fewest, the most, and how many blocks a side is cut into between the two. Pairs looked at in one step.
LEAST_BLOCK, MOST_BLOCK, BLOCKS, PAIRS = 1024, 16384, 16, 1 << 20


def _blocks(rows: int) -> int:
    return max(1, -(-rows // MOST_BLOCK), min(BLOCKS, -(-rows // LEAST_BLOCK)))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows; null components are NaN."""
    flat = column.combine_chunks().flatten() if column.null_count == 0 else None
    if flat is None or flat.null_count or len(flat) % max(1, len(column)) or len(np.unique(np.diff(column.combine_chunks().offsets.to_numpy()))) > 1:
        return np.array(column.to_pylist(), np.float64)
    return flat.to_numpy().astype(np.float64).reshape(len(column), -1)


def _apart(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, decimals: int) -> np.ndarray:
    """Distances of the pairs of rows i, j, a bounded number at a time."""
    step = max(1, PAIRS // max(1, a.shape[1]))
    parts = [np.round(np.sqrt(((b[j[x : x + step]] - a[i[x : x + step]]) ** 2).sum(axis=1)), decimals) for x in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _searched(b: np.ndarray, kind: type) -> tuple[np.ndarray, float]:
    """What _candidates multiplies by, in floats of a kind, and the largest square: made once for all steps over b."""
    sb = (b * b).sum(axis=1)
    return np.concatenate([b, np.ones((len(b), 1)), sb[:, None]], axis=1).astype(kind).T, sb.max()


def _candidates(a: np.ndarray, b: tuple[np.ndarray, float], k: int, decimals: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs among which are each a's k nearest of b (as _searched gives it), ties of rounded distances too: squares by one product in floats of b's kind, with room for its error."""
    wide_b, most_b = b
    kind, n = wide_b.dtype.type, wide_b.shape[1]
    sa = (a * a).sum(axis=1)
    wide = np.concatenate([-2 * a, sa[:, None], np.ones((len(a), 1))], axis=1).astype(kind) @ wide_b
    bound = wide
    if n > 64 * k:  # the k-th of the least ones of groups is no less than the k-th of all
        each = n // max(8 * k, 256) or 8
        bound = wide[:, : n // each * each].reshape(len(a), each, -1).min(axis=1)
    kth = np.partition(bound, k - 1, axis=1)[:, k - 1].astype(np.float64) if k < bound.shape[1] else bound.max(axis=1).astype(np.float64)
    error = 4 * (a.shape[1] + 8) * np.finfo(kind).eps * (sa + most_b)
    reach = np.sqrt(np.maximum(kth + error, 0)) + 2 * 10.0**-decimals
    limit = ((reach * reach + error) * (1 + 4 * np.finfo(kind).eps)).astype(kind)
    return np.divmod(np.flatnonzero(wide <= limit[:, None]), n)


def _best(a: np.ndarray, ia: np.ndarray, b: np.ndarray, ib: np.ndarray, k: int, decimals: int, other: bool) -> list[np.ndarray]:
    """For each row of a its k nearest of b, by rounded distance and id: ids of both, distances."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    # An id may stand on several rows; all of them are left out.
    most = k + (int(np.unique(ib, return_counts=True)[1].max()) if other and len(ib) else 0)
    most = min(most, len(ib))
    middle = b.mean(axis=0) if len(b) else 0.0
    with np.errstate(all="ignore"):
        ca, cb = a - middle, b - middle
        plain = bool(np.abs(ca).max(initial=0) < 1e15 and np.abs(cb).max(initial=0) < 1e15)
    step = max(1, PAIRS // max(1, len(b)))
    searched = _searched(cb, np.float32) if plain and len(b) else None
    for x in range(0, len(a) if len(b) else 0, step):
        n = len(a[x : x + step])
        if plain:
            i, j = _candidates(ca[x : x + step], searched, most, decimals)
            if len(i) > 16 * most * n:
                i, j = _candidates(ca[x : x + step], _searched(cb, np.float64), most, decimals)
        else:  # components that are not finite or overflow: every pair
            i, j = (g.ravel() for g in np.indices((n, len(b))))
        if other:
            apart = ia[x + i] != ib[j]
            i, j = i[apart], j[apart]
        with np.errstate(all="ignore"):
            d = _apart(a[x : x + step], b, i, j, decimals)
        order = np.lexsort((ib[j], d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((ia[x + i[first]], ib[j[first]], d[first]))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _met(a: DataFrame, b: DataFrame, k: int, ident: str, vector: str, decimals: int, other: bool, both: bool) -> DataFrame:
    """The k nearest of each row in each block of the other side: back (whether the row is of b), a_id, b_id, distance.

    A side met with itself meets each pair of blocks once, for both of them.
    """
    own = a is b
    n_a = _blocks(a.count())
    n_b = n_a if own else _blocks(b.count())
    whole = F.col(vector) if a.schema[vector].dataType == b.schema[vector].dataType == ArrayType(FloatType()) else F.col(vector).cast("array<double>")
    part = lambda n: F.pmod(F.xxhash64(ident), F.lit(n)).cast("int")
    side = lambda df, ask, n, lo, hi: df.select(F.lit(ask).alias("ask"), part(n).alias("_p"), F.col(ident).cast("long").alias("id"), whole.alias("v")).withColumn("_o", F.explode(F.sequence(lo, hi)))
    p, zero = F.col("_p"), F.lit(0)
    left = side(a, True, n_a, p if own else zero, F.lit(n_b - 1)).select("ask", p.alias("x"), F.col("_o").alias("y"), "id", "v")
    right = side(b, False, n_b, zero, p if own else F.lit(n_a - 1)).select("ask", F.col("_o").alias("x"), p.alias("y"), "id", "v")

    def meet(group: pa.Table) -> pa.Table:
        ask, ids, v = group.column("ask").to_numpy(), group.column("id").to_numpy(), _matrix(group.column("v"))
        q, qi, r, ri = v[ask], ids[ask], v[~ask], ids[~ask]
        there = _best(q, qi, r, ri, k, decimals, other)
        back = [c[:0] for c in there]
        if both or own and group.column("x")[0] != group.column("y")[0]:
            back = _best(r, ri, q, qi, k, decimals, other)
        cat = [np.concatenate(c) for c in zip(there, back, strict=True)]
        side = np.repeat([bool(0), both], [len(there[0]), len(back[0])])
        return pa.table({"back": side, "a_id": cat[0], "b_id": cat[1], "distance": cat[2]})

    pairs = n_a * (n_a + 1) // 2 if own else n_a * n_b
    return left.unionByName(right).repartition(pairs, "x", "y").groupBy("x", "y").applyInArrow(meet, "back boolean, a_id long, b_id long, distance double")


def _ranked(met: DataFrame, k: int) -> DataFrame:
    own = Window.partitionBy("a_id").orderBy("distance", "b_id")
    return met.select("a_id", "b_id", "distance").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def nearest_k(a: DataFrame, b: DataFrame, k: int, ident: str, vector: str, decimals: int = 6, other: bool = False) -> DataFrame:
    """Each row of a with its k nearest rows of b by Euclidean distance: a_id, b_id, distance, rank.

    Exact and in blocks: rows are dealt into blocks, block pairs meet in
    tasks that keep k per row, and a ranking joins them, so that neither side
    is broadcast and no pair of rows is shuffled. A product of matrices finds
    the pairs that may be among the k; these are measured exactly. Distances
    are rounded to decimals before ranking; ties go to the smaller id. other
    leaves out equal ids. The same DataFrame on both sides takes half the work.
    """
    return _ranked(_met(a, b, k, ident, vector, decimals, other, False), k)


def _both_ways(a: DataFrame, b: DataFrame, k: int, ident: str, vector: str, decimals: int = 6) -> tuple[DataFrame, DataFrame]:
    """nearest_k of a in b and of b in a, from one pass over the blocks."""
    if a is b:
        near = materialise(nearest_k(a, b, k, ident, vector, decimals), "nearest")
        return near, near
    met = materialise(_met(a, b, k, ident, vector, decimals, False, True), "nearest")
    return _ranked(met.where("not back"), k), _ranked(met.where("back"), k)


def mutual_nearest(a: DataFrame, b: DataFrame, ident: str, vector: str) -> DataFrame:
    """Pairs that are each other's nearest: a_id, b_id, distance."""
    there, back = _both_ways(a, b, 1, ident, vector)
    return there.join(back.select(F.col("a_id").alias("b_id"), F.col("b_id").alias("a_id")), ["a_id", "b_id"]).select("a_id", "b_id", "distance")


def mutual_ratio(a: DataFrame, b: DataFrame, ident: str, vector: str, ratio: float = 0.75) -> DataFrame:
    """Mutual nearest pairs that are nearer, strictly, than ratio times the second nearest, both ways; a second must exist."""

    def passing(near: DataFrame) -> DataFrame:
        two = near.groupBy("a_id").agg(F.min_by("b_id", "rank").alias("b_id"), F.min_by("distance", "rank").alias("distance"), F.max("distance").alias("second"), F.count(F.lit(1)).alias("n"))
        return two.where((F.col("n") == 2) & (F.col("distance") < ratio * F.col("second")))

    there, back = _both_ways(a, b, 2, ident, vector)
    return passing(there).join(passing(back).select(F.col("a_id").alias("b_id"), F.col("b_id").alias("a_id")), ["a_id", "b_id"]).select("a_id", "b_id", "distance")


def reciprocal_shortlist(rows: DataFrame, ident: str, vector: str, nearest: int = 12, keep: int = 3) -> DataFrame:
    """Pairs i < j among each other's nearest, each id with its keep best."""
    near = materialise(nearest_k(rows, rows, nearest, ident, vector, other=True).select("a_id", "b_id", "distance"), "nearest")
    both = near.join(near.select(F.col("a_id").alias("b_id"), F.col("b_id").alias("a_id")), ["a_id", "b_id"])
    own = Window.partitionBy("a_id").orderBy("distance", "b_id")
    kept = both.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= keep)
    return kept.select(F.least("a_id", "b_id").alias("i"), F.greatest("a_id", "b_id").alias("j"), "distance").distinct()


def radius_nearest(a: DataFrame, b: DataFrame, axes: tuple[str, ...], radius: float, ident: str, decimals: int = 9) -> DataFrame:
    """Each row of a with the nearest row of b strictly within radius: a_id, b_id, distance; distances are rounded to decimals, ties go to the smaller id.

    Rows of one place are one point, of b that of the smallest id. Points meet
    by grid cells and their neighbours, first by fine cells, which hold a few
    points each where points lie dense; a point with none nearer than a cell's
    width goes on to cells four times as wide, up to the radius.
    """
    keys = [f"_c{k}" for k in range(len(axes))]
    offsets = list(itertools.product((-1, 0, 1), repeat=len(axes)))
    moves = F.explode(F.array(*(F.struct(*(F.lit(o).alias(k) for o, k in zip(move, keys, strict=True))) for move in offsets)))
    at = {side: [f"_{side}{x}" for x in axes] for side in "ab"}
    left = materialise(a.select(*(F.col(x).alias(f"_a{x}") for x in axes)).distinct(), "asked-places")
    spots = materialise(b.groupBy(*(F.col(x).alias(f"_b{x}") for x in axes)).agg(F.min(ident).alias("b_id")), "places")
    d = F.sqrt(sum((F.pow(F.col(p) - F.col(q), 2) for p, q in zip(at["a"], at["b"], strict=True)), F.lit(0.0)))
    per = spots.groupBy(*(cell(F.col(x), radius).alias(k) for x, k in zip(at["b"], keys, strict=True))).agg(F.count(F.lit(1)).cast("double").alias("n"))
    dense = per.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0  # points of the cell of a point, on average
    found = None
    for level in range(math.ceil(math.log(dense / 32, 4 ** len(axes))) if dense > 64 else 0, -1, -1):
        width = radius / 4**level
        here = left.select(*at["a"], *(cell(F.col(x), width).alias(k) for x, k in zip(at["a"], keys, strict=True)))
        there = spots.select("b_id", *at["b"], moves.alias("_m"))
        there = there.select("b_id", *at["b"], *((cell(F.col(x), width) + F.col("_m")[k]).alias(k) for x, k in zip(at["b"], keys, strict=True)))
        met = here.join(there.hint("merge"), keys).withColumn("distance", F.round(d, decimals)).where(d < radius)
        near = met.groupBy(*at["a"]).agg(F.min(F.struct("distance", "b_id")).alias("_b"))
        if level:  # what may tie after rounding lies within the width too
            near = near.where(F.col("_b.distance") + 2 * 10.0**-decimals < width)
        near = materialise(near, "near-places")
        found = near if found is None else found.unionByName(near)
        if level:
            left = materialise(left.join(near.hint("merge"), at["a"], "left_anti"), "asked-places")
    rows = a.select(F.col(ident).alias("a_id"), *(F.col(x).alias(f"_a{x}") for x in axes))
    return rows.join(found.hint("merge"), at["a"]).groupBy("a_id").agg(F.min("_b").alias("_b")).select("a_id", "_b.b_id", "_b.distance")


def bin_join(a: DataFrame, b: DataFrame, bins: list[str], ident: str, per_bucket: int = 6) -> DataFrame:
    """Pairs whose quantised coordinates differ by one at most in each dimension; b gives per_bucket rows (smallest ids) a bucket."""
    own = Window.partitionBy(*bins).orderBy(ident)
    held = b.withColumn("_rn", F.row_number().over(own)).where(F.col("_rn") <= per_bucket)
    moves = F.array(*(F.array(*map(F.lit, m)) for m in itertools.product((-1, 0, 1), repeat=len(bins))))
    left = a.select(F.col(ident).alias("a_id"), *(F.col(x).alias(f"_{x}") for x in bins), F.explode(moves).alias("_m"))
    left = left.select("a_id", *((F.col(f"_{x}") + F.col("_m")[k]).alias(x) for k, x in enumerate(bins)))
    return left.join(held.select(F.col(ident).alias("b_id"), *bins), bins).select("a_id", "b_id")


def projective_match(points: DataFrame, depth: DataFrame, tolerance: float = 0.015, share: float = 0.01) -> DataFrame:
    """points (view, px, py, z) with the depth measured at their pixel: agree, in front (free space) or hidden."""
    joined = points.join(depth.select("view", "px", "py", F.col("z").alias("measured")), ["view", "px", "py"], "left")
    slack = F.greatest(F.lit(tolerance), share * F.col("z"))
    state = F.when(F.col("measured").isNull(), "missing").when(F.abs(F.col("measured") - F.col("z")) <= slack, "agree").when(F.col("measured") > F.col("z"), "free").otherwise("hidden")
    return joined.withColumn("state", state)


def pairs_apart(df: DataFrame, keys: list[str], index: str, least: int) -> DataFrame:
    """(keys, i, j): all pairs of a key's rows whose indices lie at least that far apart. Keys are small groups (views of a scene); pairs grow with their squares."""
    other = df.select(*keys, F.col(index).alias("j"))
    return df.select(*keys, F.col(index).alias("i")).join(other, keys).where(F.col("j") - F.col("i") >= least)


def with_earlier_results(pairs: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """pairs with the columns of results by (source, target, method) or any other keys, and cached: whether there was one. Of repeated results the last by its columns counts."""
    rest = [c for c in results.columns if c not in keys]
    last = results.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_r"))
    return pairs.join(last, keys, "left").select(*pairs.columns, *(F.col("_r")[c].alias(c) for c in rest), F.col("_r").isNotNull().alias("cached"))


def surface_agreement(near: DataFrame, a: DataFrame, b: DataFrame, distance: float = 0.03, cosine: float = 0.85) -> DataFrame:
    """near (a_id, b_id, distance) with agrees: close, and normals (id, nx, ny, nz) along one line."""
    side = lambda df, n: df.select(F.col("id").alias(f"{n}_id"), *(F.col(f"n{x}").alias(f"_{n}{x}") for x in "xyz")).hint("merge")
    dot = F.abs(F.col("_ax") * F.col("_bx") + F.col("_ay") * F.col("_by") + F.col("_az") * F.col("_bz"))
    return near.join(side(a, "a"), "a_id").join(side(b, "b"), "b_id").select("a_id", "b_id", "distance", ((F.col("distance") < distance) & (dot > cosine)).alias("agrees"))


def cloud_gap(a: DataFrame, b: DataFrame, axes: tuple[str, ...], radius: float, ident: str) -> DataFrame:
    """One row: the mean distance from each cloud to the nearest point of the other (radius where none is nearer), and the mean of both."""

    def mean(one: DataFrame, other: DataFrame, name: str) -> DataFrame:
        near = radius_nearest(one, other, axes, radius, ident).select(F.col("a_id").alias(ident), "distance")
        return one.select(ident).join(near.hint("merge"), ident, "left").agg(F.avg(F.coalesce("distance", F.lit(radius))).alias(name))

    return mean(a, b, "forward").crossJoin(mean(b, a, "backward")).withColumn("symmetric", (F.col("forward") + F.col("backward")) / 2)
