"""Rigid motions between views by consensus of whole marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import inverse, middle_eigenvalue
from ..plans.shared import materialise
from .fit import P, Q, rigid_fit

_PLACES = [a + b for k, a in enumerate("xyz") for b in "xyz"[k:]]


def _flatness(group) -> DataFrame:
    """group with _spread: the middle eigenvalue of its points' covariance; 0 for points along a line."""
    own = group.agg(*(F.covar_samp(f"p{a}", f"p{b}").alias(f"_{a}{b}") for a, b in _PLACES), F.count(F.lit(1)).alias("_n"))
    return own.withColumn("_spread", middle_eigenvalue(*(F.col(f"_{c}") for c in _PLACES)))


def corner_support(corners: DataFrame, poses: DataFrame, camera: tuple[float, float, float, float], pixels: float = 3.0, metres: float = 0.025) -> DataFrame:
    """corners joined with the poses of their pair, with off_px, off_m and good: both views project a corner to within pixels of where the other one saw it, in front of the camera, and the points lie within metres.

    A pose and its inverse are taken apart before the join, once a pose, and
    each step of a corner is a number of its own, computed once.
    """
    fx, fy, cx, cy = camera
    ways = {"_f": (F.col("pose"), P, "qu", "qv"), "_r": (F.col("_back"), Q, "pu", "pv")}
    rest = [c for c in poses.columns if c not in ("pair", "pose")]
    numbers = poses.select("pair", "pose", *rest, inverse(F.col("pose")).alias("_back"))
    met = corners.join(numbers.select("pair", *rest, *(m[k].alias(f"{w}{k}") for w, (m, *_) in ways.items() for k in range(12))), "pair")
    put = lambda w, at, i: F.col(f"{w}{4 * i}") * F.col(at[0]) + F.col(f"{w}{4 * i + 1}") * F.col(at[1]) + F.col(f"{w}{4 * i + 2}") * F.col(at[2]) + F.col(f"{w}{4 * i + 3}")
    met = met.select(*corners.columns, *rest, *(put(w, at, i).alias(f"{w}_{x}") for w, (_, at, _, _) in ways.items() for i, x in enumerate("xyz")))
    met = met.withColumns({f"{w}_in": F.greatest(f"{w}_z", F.lit(1e-9)) for w in ways})
    miss = lambda w, u, v: F.sqrt(F.pow(fx * (F.col(f"{w}_x") / F.col(f"{w}_in")) + cx - F.col(u), 2) + F.pow(fy * (F.col(f"{w}_y") / F.col(f"{w}_in")) + cy - F.col(v), 2))
    gap = F.sqrt(sum((F.pow(F.col(f"_f_{a}") - F.col(f"q{a}"), 2) for a in "xyz"), F.lit(0.0)))
    ahead = (F.col("_f_z") > 0) & (F.col("_r_z") > 0)
    met = met.select(*corners.columns, *rest, ahead.alias("_ahead"), gap.alias("off_m"), F.greatest(*(miss(w, u, v) for w, (_, _, u, v) in ways.items())).alias("off_px"))
    return met.withColumn("good", F.col("_ahead") & (F.col("off_px") <= pixels) & (F.col("off_m") <= metres)).drop("_ahead")


def _agreed(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Per pose the matched marks and inliers, those with four good corners."""
    marks = judged.groupBy(*keys, "mark").agg(F.min("good").alias("_all"))
    return marks.groupBy(*keys).agg(F.count(F.lit(1)).alias("matched"), F.count_if("_all").alias("inliers"))


def _medians(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Per pose the median errors of all corners."""
    return judged.groupBy(*keys).agg(F.percentile("off_px", F.lit(0.5)).alias("pixels"), F.percentile("off_m", F.lit(0.5)).alias("metres"))


def mark_motion(corners: DataFrame, camera: tuple[float, float, float, float], share: float = 0.65, most: int = 64, pixels: float = 3.0, metres: float = 0.025, flat: float = 1e-6) -> DataFrame:
    """(pair, matched, inliers, support, pixels, metres, pose): the motion of a pair of views that most of their common marks agree on.

    corners: pair, mark, corner, the measured points px..pz and qx..qz of both
    views and their pixels pu, pv and qu, qv; four rows a mark. Hypotheses are
    the fit to all corners and one to each of the `most` largest marks (by
    the box of their pixels, ties: smaller mark), which makes them a fixed
    number a pair; all are a table, fitted from sums and scored in one
    aggregation over (hypothesis, corner); medians are taken of those with
    most supporting marks only. A mark supports a hypothesis with
    all corners or not at all. The first with most supporting marks, then the
    smallest median of pixels, is fitted again to its supporters, and holds if
    a share of all common marks supports that too.

    Pairs without such a motion give no row. Corners with nulls and marks
    without four corners take no part; points along a line (spread under
    flat) make no hypothesis. A final nonlinear refinement is not part of it.
    """
    seen = ["pair", "mark", "corner", *P, *Q, "pu", "pv", "qu", "qv"]
    rows = corners.select(*seen).dropna().dropDuplicates(["pair", "mark", "corner"])
    whole = rows.groupBy("pair", "mark").agg(F.count(F.lit(1)).alias("_n")).where("_n = 4").select("pair", "mark")
    rows = materialise(rows.join(whole, ["pair", "mark"]), "corners")
    box = (F.max("pu") - F.min("pu")) * (F.max("pv") - F.min("pv"))
    by_size = Window.partitionBy("pair").orderBy(F.desc("_box"), "mark")
    largest = rows.groupBy("pair", "mark").agg(box.alias("_box")).withColumn("h", F.row_number().over(by_size)).where(F.col("h") <= most)
    tried = rows.join(largest.select("pair", "mark", "h"), ["pair", "mark"]).unionByName(rows.withColumn("h", F.lit(0)))
    sound = _flatness(tried.groupBy("pair", "h")).where(F.col("_spread") >= flat).select("pair", "h")
    poses = materialise(rigid_fit(tried.join(sound, ["pair", "h"], "left_semi"), ["pair", "h"]).drop("n"), "hypotheses")
    agreed = _agreed(corner_support(rows, poses, camera, pixels, metres), ["pair", "h"]).where(F.col("inliers") >= share * F.col("matched")).where("inliers > 0")
    agreed = materialise(agreed.select("pair", "h", "inliers"), "agreed")
    most_of = agreed.groupBy("pair").agg(F.max("inliers").alias("inliers"))
    first = poses.join(agreed.join(most_of, ["pair", "inliers"]).select("pair", "h"), ["pair", "h"])
    middle = _medians(corner_support(rows, first, camera, pixels, metres), ["pair", "h"])
    best = first.join(middle, ["pair", "h"]).groupBy("pair").agg(F.max_by("pose", F.struct(-F.col("pixels"), -F.col("h"))).alias("pose"))
    best = materialise(best, "best")
    judged = corner_support(rows, best, camera, pixels, metres)
    supporters = judged.groupBy("pair", "mark").agg(F.min("good").alias("_all")).where("_all").select("pair", "mark")
    kept = materialise(rows.join(supporters, ["pair", "mark"], "left_semi"), "supporters")
    sound = _flatness(kept.groupBy("pair")).where(F.col("_spread") >= flat).select("pair")
    again = materialise(rigid_fit(kept.join(sound, "pair", "left_semi"), ["pair"]).drop("n"), "motions")
    judged = corner_support(rows, again, camera, pixels, metres)
    held = _agreed(judged, ["pair"]).withColumn("support", F.col("inliers") / F.col("matched")).where((F.col("inliers") > 0) & (F.col("support") >= share))
    return held.join(_medians(judged, ["pair"]), "pair").join(again, "pair").select("pair", "matched", "inliers", "support", "pixels", "metres", "pose")
