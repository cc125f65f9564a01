"""Operators on ordered streams per key."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import wrap_delta
from ..plans.shared import materialise
from .robust import with_percentiles


#: Unbroken runs of a key that go to one task together.
RUNS = 256


def _order(keys: tuple[str, ...], t: str, ties: tuple[str, ...] = ()):
    return Window.partitionBy(*keys).orderBy(t, *ties)


def gaps(df: DataFrame, keys: tuple[str, ...], t: str = "t", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with gap: the time since the key's row before."""
    return df.withColumn("gap", F.col(t) - F.lag(t).over(_order(keys, t, ties)))


def islands(df: DataFrame, keys: tuple[str, ...], t: str, limit: float | Column, name: str = "segment", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with a number per run of rows that no gap above limit parts."""
    own = _order(keys, t, ties)
    gap = F.col(t) - F.lag(t).over(own)
    flag = F.when(gap > limit, 1).otherwise(0)
    return df.withColumn("_cut", flag).withColumn(name, F.sum("_cut").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def interval_stats(df: DataFrame, keys: tuple[str, ...], long_gap: float, t: str = "t", ties: tuple[str, ...] = ()) -> DataFrame:
    """Per key: rows, span, gaps above long_gap, intervals that aren't positive, and (n - 1) / span."""
    span = F.max(t) - F.min(t)
    return gaps(df, keys, t, ties).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), span.alias("span"), F.count_if(F.col("gap") > long_gap).alias("n_gaps"), F.count_if(F.col("gap") <= 0).alias("n_not_positive"), F.when(span > 0, (F.count(F.lit(1)) - 1) / span).alias("rate")
    )


def adaptive_segments(df: DataFrame, keys: tuple[str, ...], floor: float = 2.0, factor: float = 3.0, least: int = 4, t: str = "t", ties: tuple[str, ...] = ()) -> DataFrame:
    """df with limit and segment; a key's limit is max(floor, factor * median positive interval) with least intervals, else floor.

    Medians come from range-partitioned ranks; the running cut count is a
    window per key, which spills. Rows of a null key take no part.
    """
    known = gaps(df, keys, t, ties)
    positive = known.select(*keys, F.when(F.col("gap") > 0, F.col("gap")).alias("_gap"))
    own = with_percentiles(positive.groupBy(*keys).agg(F.count("_gap").alias("_n")), positive, list(keys), "_gap", {"_median": 0.5})
    limits = own.select(*keys, F.when(F.col("_n") >= least, F.greatest(F.lit(float(floor)), factor * F.col("_median"))).otherwise(float(floor)).alias("limit"))
    joined = known.join(limits, list(keys))
    own = _order(keys, t, ties).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn("segment", F.sum(F.when(F.col("gap") > F.col("limit"), 1).otherwise(0)).over(own)).drop("gap")


def split_segments(df: DataFrame, keys: tuple[str, ...], size: int = 16, overlap: int = 2, t: str = "t", ties: tuple[str, ...] = ()) -> DataFrame:
    """Segments (keys) cut into fragments of size rows; the overlap rows before each come along with owned = false."""
    place = F.row_number().over(_order(keys, t, ties)) - 1
    own = df.withColumn("_n", place).withColumn("fragment", F.floor(F.col("_n") / size)).withColumn("owned", F.lit(True))
    context = own.where(F.pmod("_n", F.lit(size)) >= size - overlap).withColumns({"fragment": F.col("fragment") + 1, "owned": F.lit(False)})
    last = own.groupBy(*keys).agg(F.max("fragment").alias("_last"))
    context = context.join(last, list(keys)).where("fragment <= _last").drop("_last")
    return own.unionByName(context).drop("_n")


def unwrap_clock(df: DataFrame, keys: tuple[str, ...], tick: str, order: str, ticks_per_s: float = 60e6) -> DataFrame:
    """df with elapsed_s: the running sum of signed wrap-safe tick differences in the order of arrival."""
    own = Window.partitionBy(*keys).orderBy(order)
    delta = F.coalesce(wrap_delta(F.col(tick), F.lag(tick).over(own)), F.lit(0))
    return df.withColumn("_d", delta).withColumn("elapsed_s", F.sum("_d").over(own.rowsBetween(Window.unboundedPreceding, 0)) / ticks_per_s).drop("_d")


def rolling_offset(df: DataFrame, keys: tuple[str, ...], value: str, order: str, rows: int = 128) -> DataFrame:
    """df with the least value of the last rows, and their spread."""
    own = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)
    return df.withColumns({"offset": F.min(value).over(own), "spread": F.max(value).over(own) - F.min(value).over(own)})


def rolling_mean(df: DataFrame, keys: tuple[str, ...], value: str, order: str, rows: int = 12) -> DataFrame:
    return df.withColumn("mean", F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - rows, 0)))


def asymmetric_ema(df: DataFrame, keys: tuple[str, ...], value: str, order: tuple[str, ...], up: float = 0.5, down: float = 0.1) -> DataFrame:
    """Per key the rows and the last smoothed value: quick upwards, slow downwards; a previous 0 restarts.

    Rows are sorted within partitions and folded as they stream by, so a hot
    key is one task's, but never in its memory.
    """
    kinds = dict(df.dtypes)
    rows = df.select(*keys, *order, F.col(value).cast("double").alias("_v")).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        at, n, mean, done = None, 0, None, []
        for b in batches:
            for *key, v in zip(*(b[k].tolist() for k in (*keys, "_v")), strict=True):
                if key != at:
                    if at is not None:
                        done.append((*at, n, mean))
                    at, n, mean = key, 0, None
                n += 1
                if not math.isnan(v):
                    mean = mean + (up if v > mean else down) * (v - mean) if mean else v
            yield pd.DataFrame(done, columns=[*keys, "n", "smoothed"])
            done = []
        if at is not None:
            yield pd.DataFrame([(*at, n, mean)], columns=[*keys, "n", "smoothed"])

    return rows.mapInPandas(run, ", ".join([f"{k} {kinds[k]}" for k in keys] + ["n long", "smoothed double"]))


def travel_distance(df: DataFrame, keys: tuple[str, ...], axes: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """df with step and the distance travelled so far."""
    own = Window.partitionBy(*keys).orderBy(*order)
    step = F.sqrt(sum((F.pow(F.col(a) - F.lag(a).over(own), 2) for a in axes), F.lit(0.0)))
    return df.withColumn("step", F.coalesce(step, F.lit(0.0))).withColumn("travelled", F.sum("step").over(own.rowsBetween(Window.unboundedPreceding, 0)))


def loss_episodes(df: DataFrame, keys: tuple[str, ...], failed: Column, order: tuple[str, ...], ident: str) -> DataFrame:
    """df with failed, episode (runs of failures so far), consecutive (failures in a row), last_good, and probe (the first three of a run, then every fourth)."""
    own = Window.partitionBy(*keys).orderBy(*order)
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("failed", F.coalesce(failed, F.lit(False)))
    df = df.withColumn("_first", (F.col("failed") & ~F.coalesce(F.lag("failed").over(own), F.lit(False))).cast("int"))
    df = df.withColumns({"episode": F.sum("_first").over(so_far), "_good": F.sum((~F.col("failed")).cast("int")).over(so_far), "last_good": F.last(F.when(~F.col("failed"), F.col(ident)), True).over(so_far)})
    run = Window.partitionBy(*keys, "_good").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("consecutive", F.when(F.col("failed"), F.sum(F.col("failed").cast("int")).over(run)).otherwise(0))
    return df.withColumn("probe", F.col("failed") & ((F.col("consecutive") <= 3) | (F.pmod("consecutive", F.lit(4)) == 0))).drop("_first", "_good")


def best_of_recent(df: DataFrame, keys: tuple[str, ...], score: str, valid: str, t: str = "t", age: float = 0.3, rows: int = 5) -> DataFrame:
    """df with best_t: the time of the best row by (valid, score, time) among the last rows within age."""
    own = Window.partitionBy(*keys).orderBy(t).rowsBetween(1 - rows, 0)
    recent = F.collect_list(F.struct(F.col(valid).alias("valid"), F.col(score).alias("score"), F.col(t).alias("at"))).over(own)
    return df.withColumn("_recent", recent).withColumn("best_t", F.array_max(F.filter("_recent", lambda x: F.col(t) - x["at"] <= age))["at"]).drop("_recent")


def bounded_history(df: DataFrame, keys: tuple[str, ...], t: str = "t", window: float = 8.0, rows: int = 256) -> DataFrame:
    """df with n_recent (rows within window, rows at most) and recent_from (the time from which they are whole)."""
    micros = F.round(F.col(t) * 1e6).cast("long")
    by_time = F.count(F.lit(1)).over(Window.partitionBy(*keys).orderBy(micros).rangeBetween(-round(window * 1e6), 0))
    oldest = F.lag(t, rows - 1).over(Window.partitionBy(*keys).orderBy(t))
    return df.withColumns({"n_recent": F.least(by_time, F.lit(rows).cast("long")), "recent_from": F.greatest(F.col(t) - window, F.coalesce(oldest, F.col(t) - window))})


def changes_only(df: DataFrame, keys: tuple[str, ...], state: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Rows whose state differs from the key's row before."""
    own = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumns({"_now": F.struct(*state), "_n": F.row_number().over(own)}).withColumn("_was", F.lag("_now").over(own))
    return marked.where((F.col("_n") == 1) | ~F.col("_now").eqNullSafe(F.col("_was"))).drop("_now", "_was", "_n")


def trails(df: DataFrame, ident: str, frame: str, segment: tuple[str, ...] = ()) -> DataFrame:
    """df with linked (the id stood in the frame just before), trail (a number per unbroken path) and age in frames."""
    own = Window.partitionBy(*segment, ident).orderBy(frame)
    df = df.withColumn("linked", F.coalesce(F.lag(frame).over(own) == F.col(frame) - 1, F.lit(False)))
    df = df.withColumn("trail", F.sum((~F.col("linked")).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("age", F.row_number().over(Window.partitionBy(*segment, ident, "trail").orderBy(frame)) - 1)


def lifetimes(df: DataFrame, ident: str, frame: str) -> DataFrame:
    """Per id: first and last frame, observations, age, and whether it is in the last frame of all."""
    last = df.agg(F.max(frame).alias("_end"))
    return df.groupBy(ident).agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count(F.lit(1)).alias("observations")).crossJoin(F.broadcast(last)).select(ident, "first_frame", "last_frame", "observations", (F.col("last_frame") - F.col("first_frame")).alias("age"), (F.col("last_frame") == F.col("_end")).alias("retained"))


def extrapolate(df: DataFrame, keys: tuple[str, ...], value: str, t: str = "t", ratio: float = 2.0) -> DataFrame:
    """df with predicted: constant velocity from the two rows before; null when this step is over ratio times theirs."""
    own = Window.partitionBy(*keys).orderBy(t)
    step = F.lag(t, 1).over(own) - F.lag(t, 2).over(own)
    ahead = (F.col(t) - F.lag(t, 1).over(own)) / step
    return df.withColumn("predicted", F.when((step > 0) & (ahead <= ratio), F.lag(value, 1).over(own) + (F.lag(value, 1).over(own) - F.lag(value, 2).over(own)) * ahead))


def interpolate(df: DataFrame, keys: tuple[str, ...], value: str, t: str = "t") -> DataFrame:
    """df with filled: value, or between the known values around it by time, or the nearest known one at the ends."""
    back = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(F.desc(t)).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    df = df.withColumn("_k", known).withColumns({"_a": F.last("_k", True).over(back), "_b": F.last("_k", True).over(ahead)})
    share = (F.col(t) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    between = F.when(F.col("_b.t") > F.col("_a.t"), F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * share)
    return df.withColumn("filled", F.coalesce(between, F.col("_a.v"), F.col("_b.v"))).drop("_k", "_a", "_b")


def _medians(rows: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Medians along axis 1 of the known first values of each sorted row; nan sorts last."""
    rows, at = np.sort(rows, axis=1), known.reshape(-1, *[1] * (rows.ndim - 1))
    low, high = (np.take_along_axis(rows, np.broadcast_to(k, (len(rows), 1, *rows.shape[2:])), axis=1)[:, 0] for k in ((at - 1) // 2, at // 2))
    return (low + high) / 2


def _recent(v: np.ndarray, at: np.ndarray, start: np.ndarray, history: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of the last rows of the run that began at start, and the median distance from it."""
    rows = at[:, None] - np.arange(history - 1, -1, -1)
    window = np.where((rows >= start[:, None])[:, :, None], v[np.maximum(rows, 0)], np.nan)
    known = np.minimum(at - start + 1, history)
    middle = _medians(window, known)
    return middle, _medians(np.linalg.norm(window - middle[:, None], axis=2), known)


class Gravity:
    """The fold of `gravity_filter` over samples that come in pieces; between two it holds the last history rows.

    cut: no run goes on from the row before. A run is also broken by samples
    whose length is far from g, and after a smoothed vector that has all but vanished.
    """

    def __init__(self, g: float = 9.80665, tau: float = 0.12, history: int = 8):
        self.g, self.tau, self.history = g, tau, history
        self.t, self.v, self.up = np.zeros(0), np.zeros((0, 3)), np.zeros((0, 3))
        self.start, self.lost = np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, cut: np.ndarray, t: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per sample valid, confidence and the unit vector up (nan where there is none)."""
        g, history, held, n = self.g, self.history, len(self.t), len(self.t) + len(t)
        cut = np.concatenate([np.zeros(held, bool), cut])
        t, v = np.concatenate([self.t, t]), np.concatenate([self.v, v])
        norm = np.linalg.norm(v, axis=1)
        usable = np.abs(norm - g) <= 0.3 * g
        cut |= ~(usable & np.append(False, usable[:-1]))
        start = np.maximum.accumulate(np.where(cut, np.arange(n), 0))
        if held:  # the run that the rows before left open
            start[:held] = self.start
            same = (start < held) & (np.arange(n) >= held)
            start[same] = np.maximum(start[same], held if self.lost[-1] else self.start[-1])
        first = start.copy()
        up, middle, scatter = np.full((n, 3), np.nan), np.zeros((n, 3)), np.zeros(n)
        up[:held] = self.up
        lost = np.append(self.lost, np.zeros(n - held, bool))
        stay = np.exp(-np.maximum(np.diff(t, prepend=np.nan), 0.001) / self.tau)
        at = held + np.flatnonzero(usable[held:])
        middle[at], scatter[at] = _recent(v, at, start[at], history)
        end = np.append(np.flatnonzero(np.append(False, first[1:] != first[:-1])), n)
        # All runs advance by one row at once.
        place = at - first[at]
        at = at[np.argsort(place, kind="stable")]
        for now in np.split(at, np.cumsum(np.bincount(place))[:-1]) if len(at) else ():
            fresh = start[now] == now
            before = np.where(fresh[:, None], middle[now], up[now - 1])
            up[now] = middle[now] + np.where(fresh, 0.0, stay[now])[:, None] * (before - middle[now])
            for k in now[np.linalg.norm(up[now], axis=1) < 0.25 * g].tolist():
                lost[k] = True
                stop = end[np.searchsorted(end, k, "right")]
                start[k + 1 : stop] = k + 1
                next_ = np.arange(k + 1, min(k + history, stop))
                if len(next_):
                    middle[next_], scatter[next_] = _recent(v, next_, start[next_], history)
        good = usable & ~lost
        size = np.linalg.norm(up, axis=1)
        sure = np.exp(-(((norm - g) / (0.07 * g)) ** 2) - (scatter / (0.08 * g)) ** 2) * np.minimum(1, np.minimum(np.arange(n) - start + 1, history) / 5)
        sure = np.where(good, sure, 0.0)
        unit = np.where(good[:, None], up / size[:, None], np.nan)
        last = max(0, n - history)
        self.t, self.v, self.up, self.lost, self.start = t[last:], v[last:], up[last:], lost[last:], np.maximum(start[last:] - last, 0)
        return (sure >= 0.15)[held:], sure[held:], unit[held:]


def gravity_rows(t: np.ndarray, v: np.ndarray, g: float = 9.80665, tau: float = 0.12, gap: float = 0.25, history: int = 8) -> pd.DataFrame:
    """Per sample of one stream valid, confidence, up_x, up_y, up_z."""
    t, v = np.asarray(t, float), np.asarray(v, float).reshape(len(t), 3)
    step = np.diff(t, prepend=np.nan)
    valid, sure, up = Gravity(g, tau, history).add(~((step > 0) & (step <= gap)), t, v)
    return pd.DataFrame({"valid": valid, "confidence": sure, "up_x": up[:, 0], "up_y": up[:, 1], "up_z": up[:, 2]})


def gravity_filter(df: DataFrame, key: str, t: str = "t", axes: tuple[str, str, str] = ("ax", "ay", "az"), ident: str = "id", gap: float = 0.25, tau: float = 0.12) -> DataFrame:
    """Gravity per sample of each key: rolling medians, smoothed within unbroken runs.

    The fold resets at gaps, at times that don't advance and at samples far
    off g, so a key is cut there into groups of RUNS runs, which are dealt to
    tasks. Rows stream through a task in order, many runs at once; a long run
    is one task's, but never in its memory.
    """
    kinds = dict(df.dtypes)
    own, g = _order((key,), t, (ident,)), 9.80665
    rows = df.select(key, ident, F.col(t).cast("double").alias("_t"), *(F.col(a).cast("double").alias(f"_v{k}") for k, a in enumerate(axes)), t)
    step = F.col(t) - F.lag(t).over(own)
    length = F.sqrt(sum((F.col(f"_v{k}") * F.col(f"_v{k}") for k in range(3)), F.lit(0.0)))
    goes_on = F.coalesce((step > 0) & (step <= gap) & (F.abs(length - g) <= 0.31 * g), F.lit(False))
    rows = rows.withColumn("_cut", ~goes_on)
    rows = rows.withColumn("_group", F.floor(F.sum(F.col("_cut").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)) / RUNS))
    rows = rows.repartition(key, "_group").sortWithinPartitions(key, "_group", t, ident).select(key, ident, "_cut", "_t", "_v0", "_v1", "_v2")

    def run(batches):
        fold = Gravity(g, tau)
        for b in batches:
            column = lambda name: b.column(name).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
            cut = b.column("_cut").to_numpy(zero_copy_only=False).astype(bool)
            valid, sure, up = fold.add(cut, column("_t"), np.stack([column(f"_v{k}") for k in range(3)], axis=1))
            found = [pa.array(valid), pa.array(sure), *(pa.array(up[:, k], from_pandas=True) for k in range(3))]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column(ident), *found], names=[key, ident, "valid", "confidence", "up_x", "up_y", "up_z"])

    return rows.mapInArrow(run, f"{key} {kinds[key]}, {ident} {kinds[ident]}, valid boolean, confidence double, up_x double, up_y double, up_z double")


def fold(df: DataFrame, key: str, order: list[str], values: list[str], ident: str, function, result: str, kind: str) -> DataFrame:
    """(key, ident, result) by a sequential function of each key's ordered columns; for state that no window can express."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(order)
        return pd.DataFrame({key: rows[key].to_numpy(), ident: rows[ident].to_numpy(), result: function(*(rows[v].tolist() for v in values))})

    kinds = dict(df.dtypes)
    return df.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {ident} {kinds[ident]}, {result} {kind}")


def followed(links: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at): the rows that starts (keys, at) reach along links (keys, at, next).

    Links double in length each round, so rounds grow with the logarithm of
    the longest way; each is written to the shared folder.
    """
    jump = materialise(links.where("next is not null"), "links")
    known = materialise(starts.select(*keys, "at").distinct(), "followed")
    while not jump.isEmpty():
        ahead = known.join(jump, [*keys, "at"]).select(*keys, F.col("next").alias("at"))
        known = materialise(known.unionAll(ahead).distinct(), "followed")
        then = jump.select(*keys, F.col("at").alias("next"), F.col("next").alias("_then"))
        jump = materialise(jump.join(then, [*keys, "next"]).select(*keys, "at", F.col("_then").alias("next")), "links")
    return known


def hysteresis(df: DataFrame, key: str, angle: str, t: str = "t", ident: str = "id", hold: float = 0.3, least: float = 60.0) -> DataFrame:
    """(key, ident, turn): the display turn after each row, 0 at first; another quarter must lie least degrees off and last for hold.

    For each of the four turns that may be in force, rows of one quarter that
    lie far enough off form runs, and the first row past the hold would turn
    to that quarter. From such a row on, the next one under its own quarter
    follows, and the real turns are those that the first one under 0 leads to.
    Windows are per key and spill; no row's state is carried in Python.
    """
    own = Window.partitionBy(key).orderBy(t, ident)
    back = Window.partitionBy(key).orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(key, ident, t, F.col(angle).alias("_a")).withColumn("at", F.row_number().over(own))
    rows = rows.withColumn("_q", (F.floor((F.pmod("_a", F.lit(360)) + 45) / 90) * 90 % 360).cast("int"))
    turns = (0, 90, 180, 270)
    for k in turns:
        far = (F.col("_q") != k) & (F.abs(F.pmod(F.col("_a") - k + 180, F.lit(360)) - 180) >= least)
        rows = rows.withColumn("_w", F.when(far, F.col("_q"))).withColumn("_s", F.col("_w").isNotNull() & ~F.col("_w").eqNullSafe(F.lag("_w").over(own)))
        rows = rows.withColumn("_since", F.last(F.when(F.col("_s"), F.col(t)), True).over(own))
        rows = rows.withColumn("_due", F.col("_w").isNotNull() & ~F.col("_s") & (F.col(t) - F.col("_since") >= hold))
        rows = rows.withColumn(f"_e{k}", F.col("_due") & ~F.coalesce(F.lag("_due").over(own), F.lit(False)))
    rows = materialise(rows.drop("_w", "_s", "_since", "_due", "_a"), "turns")
    some = rows.where(" or ".join(f"_e{k}" for k in turns)).select(key, "at", "_q", *(f"_e{k}" for k in turns))
    ahead = F.coalesce(*(F.when(F.col("_q") == k, F.last(F.when(F.col(f"_e{k}"), F.col("at")), True).over(back)) for k in turns))
    links = some.withColumn("next", ahead).select(key, "at", "next")
    real = followed(links, some.where("_e0").groupBy(key).agg(F.min("at").alias("at")), [key]).withColumn("_real", F.lit(True))
    met = rows.join(real, [key, "at"], "left")
    turn = F.last(F.when(F.col("_real"), F.col("_q")), True).over(Window.partitionBy(key).orderBy("at"))
    return met.select(key, ident, F.coalesce(turn, F.lit(0)).alias("turn"))


def rate_limit(df: DataFrame, key: str, interval: float, t: str = "t", ident: str = "id", fps: float | None = None) -> DataFrame:
    """(key, ident, taken): whether a row is the key's first or follows the last taken one by interval, rounded up to whole frames.

    Each row's next taken one, were it taken, is the first row past the
    interval: found by one window over rows and their own times plus interval.
    The taken rows are those that the first one leads to.
    """
    wait = math.ceil(interval * fps - 1e-9) / fps if fps else interval
    rows = df.select(key, ident, t).withColumn("at", F.row_number().over(_order((key,), t, (ident,))))
    rows = materialise(rows, "limited")
    asked = rows.select(key, (F.col(t) + wait - 1e-9).alias("_t"), F.col("at").alias("_from"))
    both = rows.select(key, F.col(t).alias("_t"), "at").unionByName(asked, allowMissingColumns=True)
    down = Window.partitionBy(key).orderBy(F.desc("_t"), F.col("at").isNull(), F.desc("at"))
    links = both.withColumn("next", F.last("at", True).over(down)).where("_from is not null and next > _from").select(key, F.col("_from").alias("at"), "next")
    taken = followed(links, rows.where("at = 1"), [key]).withColumn("_taken", F.lit(True))
    return rows.join(taken, [key, "at"], "left").select(key, ident, F.coalesce("_taken", F.lit(False)).alias("taken"))


def moved(t: list[float], x: list[float], distance: float, wait: float) -> list[bool]:
    """Which rows are taken when each must lie distance from the last taken, and at least wait after it."""
    last, out = None, []
    for now, at in zip(t, x, strict=True):
        take = last is None or (now - last[0] >= wait and abs(at - last[1]) >= distance)
        last = (now, at) if take else last
        out.append(take)
    return out


def motion_triggered(df: DataFrame, key: str, position: str, distance: float, wait: float, t: str = "t", ident: str = "id") -> DataFrame:
    return fold(df, key, [t, ident], [t, position], ident, lambda a, b: moved(a, b, distance, wait), "taken", "boolean")


def path_edges(df: DataFrame, keys: tuple[str, ...], index: str, accepted: str) -> DataFrame:
    """(keys, from_index, to_index): accepted rows joined to the accepted row just before them, if that is the index before."""
    own = Window.partitionBy(*keys).orderBy(index)
    before = df.where(F.col(accepted)).withColumn("from_index", F.lag(index).over(own))
    return before.where(F.col("from_index") == F.col(index) - 1).select(*keys, "from_index", F.col(index).alias("to_index"))


def temporal_pairs(df: DataFrame, keys: tuple[str, ...], index: str, reach: int = 3) -> DataFrame:
    """(keys, i, j) with i the 1st to reach-th row before j: offsets are exploded and met by an equi-join on the index."""
    later = df.select(*keys, F.col(index).alias("j"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("_d")).withColumn("i", F.col("j") - F.col("_d"))
    return later.drop("_d").join(df.select(*keys, F.col(index).alias("i")), [*keys, "i"]).select(*keys, "i", "j")


def bank_lists(df: DataFrame, tag: str, index: str, first: int = 5, every: int = 4, spread: int = 27, last: int = 8) -> DataFrame:
    """(tag, j, earlier): each observer j of a tag with a list of earlier observers: the first ones, the last `spread` of every fourth, and the last ones before it.

    All are rows at fixed places before it in the tag's order, or in that of
    every fourth row, so windows find them and no row is copied.
    """
    n = F.col("_n")
    own = Window.partitionBy(tag).orderBy("j")
    ranked = df.select(tag, F.col(index).alias("j")).where(F.col(tag).isNotNull()).distinct().withColumn("_n", F.row_number().over(own) - 1)
    head = F.coalesce(*(F.when(n % every == k, F.lag("j", k).over(own)) for k in range(every)))
    start = [F.when(n > k, F.nth_value("j", k + 1).over(own.rowsBetween(Window.unboundedPreceding, 0))) for k in range(first)]
    ranked = ranked.select("*", head.alias("_head"), (n % every).alias("_turn"), F.array(*start, *(F.lag("j", k).over(own) for k in range(1, last + 1))).alias("_around"))
    turn = Window.partitionBy(tag, "_turn").orderBy("j")
    back = lambda k: F.lag("_head", k).over(turn)
    heads = F.array(*(F.when(F.col("_turn") == 0, back(k + 1)).otherwise(back(k)) for k in range(spread)))
    ranked = ranked.select(tag, "j", "_around", heads.alias("_heads"))
    return ranked.select(tag, "j", F.array_compact(F.array_distinct(F.concat("_around", "_heads"))).alias("earlier"))


def bank_pairs(df: DataFrame, tag: str, index: str, first: int = 5, every: int = 4, spread: int = 27, last: int = 8) -> DataFrame:
    """(tag, i, j): each observer j of a tag with each of its earlier observers in `bank_lists`."""
    return bank_lists(df, tag, index, first, every, spread, last).select(tag, F.explode("earlier").alias("i"), "j")


def interval_complete(asked_from: Column, asked_to: Column, held_from: Column, held_to: Column, slack: float = 0.001) -> Column:
    """Whether what is held covers what was asked for, to a slack of 1 ms."""
    return F.coalesce((asked_from >= held_from - slack) & (asked_to <= held_to + slack), F.lit(False))


def paced_interval(df: DataFrame, keys: tuple[str, ...], latency: str, order: tuple[str, ...], fps: float = 10.0, head_room: float = 1.15, rows: int = 8) -> DataFrame:
    """df with interval: the median latency of the last rows times head_room, rounded up to whole frames."""
    last = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - rows, 0)
    wait = F.percentile(latency, F.lit(0.5)).over(last) * head_room
    return df.withColumn("interval", F.ceil(wait * fps - 1e-9) / fps)


def batches(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], batchable: Column, origin: str, size: int = 100) -> DataFrame:
    """df with batch: a number per key of what is sent at once.

    Only neighbours in order that are batchable and of one origin share a
    batch, of at most size rows; any other row is a barrier and goes alone. A
    null test isn't batchable, and null origins are alike.
    """
    own = Window.partitionBy(*keys).orderBy(*order)
    flags = df.withColumn("_ok", F.coalesce(batchable, F.lit(False)))
    joins = F.col("_ok") & F.coalesce(F.lag("_ok").over(own), F.lit(False)) & F.lag(origin).over(own).eqNullSafe(F.col(origin))
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    runs = flags.withColumn("_new", (~joins).cast("int")).withColumn("_run", F.sum("_new").over(so_far))
    place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(*order)) - 1
    cut = runs.withColumn("_start", (F.pmod(place, F.lit(size)) == 0).cast("int"))
    return cut.withColumn("batch", F.sum("_start").over(so_far) - 1).drop("_ok", "_new", "_run", "_start")
