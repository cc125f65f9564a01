"""Planes in clouds and pages of faces, by rounds that are each an aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import materialise
from .sampling import top_k


def _planes(points: DataFrame, key: str, ident: str, axes: tuple[str, str, str], tries: int, turn: int) -> DataFrame:
    """(key, planes): for each key up to tries planes (nx, ny, nz, d) through three points, drawn by the order of hashed idents (equal ones by their axes)."""
    drawn = top_k(points.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(turn)), F.col(ident).cast("string")))), [key], [F.col("_h"), F.col(ident), *(F.col(a) for a in axes)], 3 * tries, "_rank")
    place = F.col("_rank") - 1
    corner = lambda k: F.max(F.when(place % 3 == k, F.struct(*(F.col(a).alias(n) for a, n in zip(axes, "xyz", strict=True))))).alias(f"_p{k}")
    three = drawn.groupBy(key, F.floor(place / 3).alias("_try")).agg(*(corner(k) for k in range(3))).where("_p2 is not null")
    a, b = ({n: F.col(f"_p{k}")[n] - F.col("_p0")[n] for n in "xyz"} for k in (1, 2))
    cross = {"x": a["y"] * b["z"] - a["z"] * b["y"], "y": a["z"] * b["x"] - a["x"] * b["z"], "z": a["x"] * b["y"] - a["y"] * b["x"]}
    length = F.sqrt(sum((cross[n] * cross[n] for n in "yz"), cross["x"] * cross["x"]))
    unit = three.withColumn("_l", length).where("_l > 1e-12").withColumns({f"_n{n}": cross[n] / F.col("_l") for n in "xyz"})
    offset = sum((F.col(f"_n{n}") * F.col("_p0")[n] for n in "yz"), F.col("_nx") * F.col("_p0")["x"])
    return unit.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_try"), F.col("_nx").alias("nx"), F.col("_ny").alias("ny"), F.col("_nz").alias("nz"), offset.alias("d")))).alias("_planes"))


def segment_planes(points: DataFrame, key: str, ident: str, axes: tuple[str, str, str], tolerance: float, least: int = 200, share: float = 0.1, rounds: int = 4, tries: int = 50) -> DataFrame:
    """(key, round, nx, ny, nz, d, n): up to `rounds` planes of each key, the one with most points within tolerance first.

    Each round draws `tries` planes through three hashed points, tests every
    point that no plane holds yet against them inside its own task, and sums
    the hits by key and plane (a partial aggregation, so a key of any size is
    shared out). Of equal planes the first drawn wins. A plane needs `least`
    points and `share` of the key's; a key without one takes no further part.
    `tries` bounds what a point is joined with. Points with a null take no part.
    """
    left = points.select(key, ident, *(F.col(a).cast("double").alias(a) for a in axes)).dropna()
    needs = materialise(left.groupBy(key).agg(F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) * share)).alias("_needs")), "plane-needs")
    left = materialise(left, "plane-points")
    found = None
    off = lambda p: F.abs(p["nx"] * F.col(axes[0]) + p["ny"] * F.col(axes[1]) + p["nz"] * F.col(axes[2]) - p["d"])
    for turn in range(rounds):
        planes = materialise(_planes(left, key, ident, axes, tries, turn), "planes")
        hits = left.join(planes, key).select(key, F.explode(F.filter("_planes", lambda p: off(p) <= tolerance)).alias("p")).groupBy(key, "p").agg(F.count(F.lit(1)).alias("n"))
        best = hits.groupBy(key).agg(F.max(F.struct("n", (-F.col("p._try")).alias("_first"), "p")).alias("_b")).join(needs, key).where("_b.n >= _needs")
        best = materialise(best.select(key, F.lit(turn).alias("round"), *(F.col(f"_b.p.{n}").alias(n) for n in ("nx", "ny", "nz", "d")), F.col("_b.n").alias("n")), "plane")
        found = best if found is None else found.unionByName(best)
        if turn + 1 == rounds or best.isEmpty():
            break
        held = best.select(key, F.struct("nx", "ny", "nz", "d").alias("_p"))
        left = materialise(left.join(held, key).where(off(F.col("_p")) > tolerance).drop("_p"), "plane-points")
    return found


def _running(faces: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """faces with _upto and _whole: the sums of value per key up to a row and in all, by range partitions."""
    parted = materialise(faces.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "running")
    sums = parted.groupBy(*keys, "_part").agg(F.sum(value).alias("_s"))
    own = Window.partitionBy(*keys)
    before = F.sum("_s").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*keys, "_part", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_s").over(own).alias("_whole"))
    so_far = F.sum(value).over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return parted.join(sums, [*keys, "_part"]).withColumn("_upto", F.col("_before") + so_far).drop("_part", "_before")


def face_pages(faces: DataFrame, ident: str, axes: tuple[str, ...], area: str, budget: float, rounds: int = 40) -> DataFrame:
    """(ident, page): faces cut in halves of equal area until no page of several faces exceeds the budget.

    A page is cut across its widest axis (of equal ones the first) where the
    summed area comes nearest to half, in order of the axis and ident; its
    halves are 2 page and 2 page + 1, from page 1 on. All pages of a round are
    cut together, over range partitions. Faces with a null or without an area
    are left out; ident is unique.
    """
    open_ = faces.select(ident, *(F.col(a).cast("double").alias(a) for a in axes), F.col(area)).dropna().where(F.col(area) > 0).withColumn("page", F.lit(1).cast("long"))
    open_, done = materialise(open_, "pages"), None
    for _ in range(rounds):
        spread = [F.struct((F.max(a) - F.min(a)).alias("w"), F.lit(-k).alias("k")) for k, a in enumerate(axes)]
        wide = open_.groupBy("page").agg(F.sum(area).alias("_a"), F.count(F.lit(1)).alias("_n"), F.greatest(*spread).alias("_w"))
        wide = materialise(wide.select("page", ((F.col("_a") > budget) & (F.col("_n") > 1)).alias("_cut"), (-F.col("_w.k")).alias("_axis")), "page-axes")
        met = materialise(open_.join(wide, "page"), "pages")
        rest = met.where("not _cut").select(ident, "page")
        done = rest if done is None else done.unionByName(rest)
        cut = met.where("_cut")
        if wide.where("_cut").isEmpty():
            return done
        at = _axis_value(axes)
        running = materialise(_running(cut.withColumn("_v", at), ["page"], ["_v", ident], area), "page-sums")
        near = F.struct(F.abs(F.col("_upto") - F.col("_whole") / 2).alias("o"), F.col("_v").alias("v"), F.col(ident).alias("i"))
        last = running.groupBy("page").agg(F.max(F.struct("_v", ident)).alias("_last"))
        spot = running.join(last, "page").where(F.struct("_v", ident) < F.col("_last")).groupBy("page").agg(F.min(near).alias("_at"))
        right = F.struct(F.col("_v").alias("v"), F.col(ident).alias("i")) > F.struct(F.col("_at.v").alias("v"), F.col("_at.i").alias("i"))
        open_ = materialise(running.join(spot, "page").withColumn("page", 2 * F.col("page") + right.cast("long")).select(ident, *axes, area, "page"), "pages")
    raise RuntimeError(f"pages did not settle in {rounds} rounds")


def _axis_value(axes: tuple[str, ...]) -> Column:
    """The coordinate on the axis that _axis names."""
    out = F.col(axes[0])
    for k, a in enumerate(axes[1:], 1):
        out = F.when(F.col("_axis") == k, F.col(a)).otherwise(out)
    return out
