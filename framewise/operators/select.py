"""Redundancy selection and small sequential choices."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import materialise
from .graph import connected_components


class Thinning:
    """One group's samples, sorted, with how many more views and near-best views of each, and then of the null one, may go."""

    def __init__(self, samples: np.ndarray, spare: np.ndarray, good: np.ndarray):
        self.samples, self.spare = samples, np.stack([spare, good])

    def stays(self, held: bool, at: np.ndarray, good: np.ndarray) -> bool:
        """Whether a view with samples at those places (good: near the best there) stays; if it goes, its samples can spare fewer."""
        best = at[good]
        if held or (self.spare[0, at] <= 0).any() or (self.spare[1, best] <= 0).any():
            return True
        np.subtract.at(self.spare[0], at, 1)
        np.subtract.at(self.spare[1], best, 1)
        return False


def redundant_views(df: DataFrame, group: str, view: str, sample: str, weight: str, least: int = 3, near_best: float = 0.9, protected: Column | None = None) -> DataFrame:
    """(group, view, kept): views go, smallest first, as long as each of their samples keeps min(its views, least) and a near-best one.

    What a sample can spare and in which order views may go come from
    aggregations and windows; only the pass over a group's views, in that
    order, is sequential: a group's samples, then its views' rows, stream
    through a task, which holds two numbers a sample and one view. df: one row
    per (view, sample) that it sees.
    """
    seen = df.where(F.col(weight) > 0).select(F.col(group).alias("_g"), F.col(view).alias("_view"), F.col(sample).alias("_s"), F.col(weight).alias("_w"), (F.lit(False) if protected is None else F.coalesce(protected, F.lit(False))).alias("_p"))
    own, seen_by = Window.partitionBy("_g", "_s"), Window.partitionBy("_g", "_view")
    seen = materialise(seen.withColumn("_good", F.col("_w") >= near_best * F.max("_w").over(own)).drop("_w"), "seen")
    n = F.count(F.lit(1))
    spare = seen.groupBy("_g", "_s").agg((n - F.least(n, F.lit(least))).alias("_a"), (F.count_if("_good") - 1).alias("_b"))
    order = seen.withColumns({"_n": F.count(F.lit(1)).over(seen_by), "_p": F.max("_p").over(seen_by)})
    nothing, kind = F.lit(None), seen.schema["_s"].dataType
    rows = spare.select("_g", nothing.cast("long").alias("_n"), nothing.cast(seen.schema["_view"].dataType).alias("_view"), "_s", nothing.cast("boolean").alias("_p"), nothing.cast("boolean").alias("_good"), "_a", "_b")
    rows = rows.unionByName(order.select("_g", "_n", "_view", "_s", "_p", "_good", nothing.cast("long").alias("_a"), nothing.cast("long").alias("_b")))
    rows = rows.withColumns({"_null": F.col("_s").isNull(), "_s": F.coalesce("_s", F.lit("0").cast(kind))})
    rows = rows.repartition("_g").sortWithinPartitions("_g", F.col("_n").asc_nulls_first(), "_view", "_null", "_s")
    names, kinds = [group, view, "kept"], dict(df.dtypes)

    def run(batches):
        here, head, state = None, [], None
        open_ = None  # the view that the rows so far end with: key, held, places, which are good
        for b in batches:
            g, views = b.column("_g").to_pylist(), b.column("_view").to_pylist()
            n = b.column("_n").to_numpy(zero_copy_only=False).astype(float)
            s = b.column("_s").to_numpy(zero_copy_only=False)
            none, held, good = (b.column(c).fill_null(False).to_numpy(zero_copy_only=False).astype(bool) for c in ("_null", "_p", "_good"))
            spare = [b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("_a", "_b")]
            starts = [0, *(k for k in range(1, len(g)) if g[k] != g[k - 1] or views[k] != views[k - 1] or np.isnan(n[k]) != np.isnan(n[k - 1]))]
            done = []
            for lo, hi in zip(starts, [*starts[1:], len(g)], strict=True):
                if np.isnan(n[lo]):
                    if open_:
                        done.append((*open_[0], state.stays(open_[1], np.concatenate(open_[2]), np.concatenate(open_[3]))))
                        open_ = None
                    head = head if head and here == g[lo] else []
                    head.append((s[lo:hi][~none[lo:hi]], spare[0][lo:hi], spare[1][lo:hi]))
                    here = g[lo]
                    continue
                if head:
                    state, head = Thinning(*(np.concatenate(c) for c in zip(*head, strict=True))), []
                at = np.where(none[lo:hi], len(state.samples), np.searchsorted(state.samples, s[lo:hi]))
                if open_ and open_[0] == (g[lo], views[lo]):
                    open_[2].append(at), open_[3].append(good[lo:hi])
                    continue
                if open_:
                    done.append((*open_[0], state.stays(open_[1], np.concatenate(open_[2]), np.concatenate(open_[3]))))
                open_ = ((g[lo], views[lo]), bool(held[lo]), [at], [good[lo:hi]])
            yield table(done, b)
        if open_:
            yield table([(*open_[0], state.stays(open_[1], np.concatenate(open_[2]), np.concatenate(open_[3])))], b)

    def table(done: list[tuple], b: pa.RecordBatch) -> pa.RecordBatch:
        columns, arrow = zip(*done, strict=True) if done else ([],) * 3, (b.column("_g").type, b.column("_view").type, pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, arrow, strict=True)], names=names)

    return rows.mapInArrow(run, f"{group} {kinds[group]}, {view} {kinds[view]}, kept boolean")


def even_positions(count: int, n: int) -> np.ndarray:
    return np.arange(n) * (count - 1) // max(n - 1, 1)


def within_budget(taken: np.ndarray, pairs: np.ndarray, room: int) -> np.ndarray:
    """taken with the positions of those pairs that fit whole, in order, into room more places.

    Up to the first pair that doesn't fit all are taken at once; of those
    after it only pairs with one new position can still fit.
    """
    flat, first = np.unique(pairs.ravel(), return_index=True)
    new = np.zeros(pairs.size, bool)
    new[first[~np.isin(flat, taken)]] = True
    used = np.cumsum(new.reshape(pairs.shape).sum(axis=1))
    fits = int(np.searchsorted(used, room, "right"))
    taken = np.union1d(taken, pairs[:fits].ravel())
    if fits < len(pairs) and room - (used[fits - 1] if fits else 0) == 1:
        for pair in pairs[fits:]:
            fresh = np.setdiff1d(pair, taken)
            if len(fresh) == 1:
                return np.union1d(taken, fresh)
    return taken


def halved_gaps(taken: np.ndarray, n: int) -> np.ndarray:
    """taken with n more positions, each in the middle of the largest gap (the first of equal ones)."""
    heap = [(a - b, a, b) for a, b in zip(taken[:-1].tolist(), taken[1:].tolist(), strict=True)]
    heapq.heapify(heap)
    more = []
    for _ in range(n):
        _, a, b = heapq.heappop(heap)
        middle = (a + b) // 2
        more.append(middle)
        heapq.heappush(heap, (a - middle, a, middle))
        heapq.heappush(heap, (middle - b, middle, b))
    return np.union1d(taken, more).astype(np.int64)


def keyframes(count: int, limit: int, hints: tuple[tuple[int, int], ...] = ()) -> list[int]:
    """limit of count positions: evenly spaced; with hints half evenly, then paired hints, then even ones again, then the middles of the largest gaps."""
    limit = min(count, max(2, limit))
    if not hints or count <= limit:
        return even_positions(count, limit).tolist()
    taken = np.unique(even_positions(count, max(2, limit // 2)))
    taken = within_budget(taken, np.array(hints, np.int64), limit - len(taken))
    more = np.setdiff1d(even_positions(count, limit), taken)[: limit - len(taken)]
    taken = np.union1d(taken, more)
    return halved_gaps(taken, limit - len(taken)).tolist()


def tolerance_dedup(values: list[float], tolerance: float) -> list[bool]:
    """Which values stay when each must lie tolerance off every one kept before."""
    kept: list[float] = []
    out = []
    for v in values:
        new = all(abs(v - k) >= tolerance for k in kept)
        if new:
            kept.append(v)
        out.append(new)
    return out


#: Views of a graph of gains that are solved at once, at most.
MOST_VIEWS = 4_096


def global_gains(edges: DataFrame, a: str, b: str, log_ratio: str, low: float = 2 / 3, high: float = 1.5) -> DataFrame:
    """(view, gain): least squares of view log gains from pairwise log ratios, one anchor (the smallest view) per component, clipped.

    The normal equations of a component are summed in Spark, one row per
    linked pair of views, and solved in the component's own task. A component
    of more than MOST_VIEWS views is an error.
    """
    known = edges.where(F.col(log_ratio).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(log_ratio).cast("double").alias("r"))
    labels = connected_components(known.select("a", "b"), "a", "b")
    both = known.unionAll(known.select(F.col("b"), F.col("a"), -F.col("r")))
    sums = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("r")).join(labels.withColumnRenamed("id", "a"), "a")

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        views, at = np.unique(rows["a"], return_inverse=True)
        if len(views) > MOST_VIEWS:
            raise ValueError(f"{len(views)} views in one component")
        to = np.searchsorted(views, rows["b"])
        m, r = np.zeros((len(views), len(views))), np.zeros(len(views))
        np.add.at(m, (at, at), rows["n"])
        np.add.at(m, (at, to), -rows["n"])
        np.add.at(r, to, rows["r"])
        log = np.append(0.0, np.linalg.solve(m[1:, 1:], r[1:]))
        return pd.DataFrame({"view": views, "gain": np.clip(np.exp(log), low, high)})

    return sums.groupBy("component").applyInPandas(solve, f"view {dict(edges.dtypes)[a]}, gain double")
