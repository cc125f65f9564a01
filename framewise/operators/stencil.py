"""Neighbourhood operators on long grid tables (frame keys, x, y, value)."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import broadcast_if_small


def neighbours(df: DataFrame, keys: tuple[str, ...], x: str, y: str, value: str) -> DataFrame:
    """df with left, right, up and down: the values of adjacent cells, null where there is none."""
    row = Window.partitionBy(*keys, y).orderBy(x)
    column = Window.partitionBy(*keys, x).orderBy(y)
    at = lambda w, c, step: F.when(F.lag(c, step).over(w) == F.col(c) - step, F.lag(value, step).over(w))
    return df.withColumns({"left": at(row, x, 1), "right": at(row, x, -1), "up": at(column, y, 1), "down": at(column, y, -1)})


def clip_depth(df: DataFrame, depth: str, near: float, far: float, inside: Column | None = None) -> DataFrame:
    """Depths within [near, far] and inside; others become null."""
    keep = F.col(depth).between(near, far)
    return df.withColumn(depth, F.when(keep if inside is None else keep & inside, F.col(depth)))


def support_filter(df: DataFrame, keys: tuple[str, ...], x: str, y: str, depth: str, least: int = 2, floor: float = 15.0, share: float = 0.01) -> DataFrame:
    """df with support: the adjacent depths that differ by max(floor, share * depth) at most; and supported."""
    known = neighbours(df, keys, x, y, depth)
    slack = F.greatest(F.lit(floor), F.col(depth) * share)
    near = [F.when((F.col(n) > 0) & (F.abs(F.col(n) - F.col(depth)) <= slack), 1).otherwise(0) for n in ("left", "right", "up", "down")]
    return known.withColumn("support", sum(near[1:], near[0])).withColumn("supported", (F.col("support") >= least) & (F.col(depth) > 0)).drop("left", "right", "up", "down")


def edge_flags(df: DataFrame, keys: tuple[str, ...], x: str, y: str, z: str, floor: float = 0.02, share: float = 0.02) -> DataFrame:
    """df with edge: whether an adjacent depth differs by more than max(floor, share * z)."""
    known = neighbours(df, keys, x, y, z)
    slack = F.greatest(F.lit(floor), F.col(z) * share)
    far = [F.coalesce((F.col(n) > 0) & (F.abs(F.col(n) - F.col(z)) > slack), F.lit(False)) for n in ("left", "right", "up", "down")]
    return known.withColumn("edge", far[0] | far[1] | far[2] | far[3]).drop("left", "right", "up", "down")


def stable_samples(df: DataFrame, keys: tuple[str, ...], x: str, y: str, depth: str, least: int = 7, floor: float = 30.0, share: float = 0.04) -> DataFrame:
    """Cells with a depth whose 3 x 3 neighbourhood has least depths and a narrow spread, with the lower median."""
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in itertools.product((-1, 0, 1), repeat=2))))
    given = df.where(F.col(depth) > 0)
    around = given.select(*keys, x, y, depth, moves.alias("_m")).select(*keys, (F.col(x) + F.col("_m.a")).alias(x), (F.col(y) + F.col("_m.b")).alias(y), F.col(depth).alias("_d"))
    sums = around.groupBy(*keys, x, y).agg(F.array_sort(F.collect_list("_d")).alias("_all"))
    middle = F.element_at("_all", F.floor((F.size("_all") + 1) / 2).cast("int"))
    joined = given.join(sums, [*keys, x, y]).withColumn("median", middle)
    spread = F.element_at("_all", -1) - F.element_at("_all", 1)
    return joined.where((F.size("_all") >= least) & (spread <= F.greatest(F.lit(floor), share * F.col("median")))).drop("_all")


def z_buffer(df: DataFrame, cell: list[str], z: str, floor: float = 15.0, share: float = 0.01) -> DataFrame:
    """Rows whose z is within max(floor, share * nearest) of the nearest of their cell. The minimum combines before the shuffle."""
    near = df.groupBy(*cell).agg(F.min(z).alias("z_min"))
    return df.join(near, cell).where(F.col(z) <= F.col("z_min") + F.greatest(F.lit(floor), share * F.col("z_min")))


def bilinear(samples: DataFrame, grid: DataFrame, ident: str, px: str, py: str, value: str) -> DataFrame:
    """Values between four grid cells (x, y, value); null where one is missing."""
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in itertools.product((0, 1), repeat=2))))
    own = samples.select(ident, px, py, moves.alias("_m")).withColumns({"x": (F.floor(px) + F.col("_m.a")).cast("long"), "y": (F.floor(py) + F.col("_m.b")).cast("long")})
    wx = F.when(F.col("_m.a") == 1, F.col(px) - F.floor(px)).otherwise(1 - (F.col(px) - F.floor(px)))
    wy = F.when(F.col("_m.b") == 1, F.col(py) - F.floor(py)).otherwise(1 - (F.col(py) - F.floor(py)))
    met = own.withColumn("_w", wx * wy).where("_w > 0").join(grid.select("x", "y", value), ["x", "y"], "left")
    return met.groupBy(ident).agg(F.when(F.count_if(F.col(value).isNull()) == 0, F.sum(F.col("_w") * F.col(value))).alias(value))


def sharpness(df: DataFrame, keys: tuple[str, ...], x: str, y: str, value: str) -> DataFrame:
    """Per frame the variance of the four-neighbour Laplacian, and the mean absolute difference to the right and below. Cells at a border or a hole have no Laplacian."""
    known = neighbours(df, keys, x, y, value)
    bend = F.col("left") + F.col("right") + F.col("up") + F.col("down") - 4 * F.col(value)
    step = lambda c: F.abs(F.col(c) - F.col(value))
    n = F.count(step("right")) + F.count(step("down"))
    return known.groupBy(*keys).agg(F.var_pop(bend).alias("laplacian"), ((F.coalesce(F.sum(step("right")), F.lit(0.0)) + F.coalesce(F.sum(step("down")), F.lit(0.0))) / n).alias("difference"))


def colour_class(depth: Column, near: float, far: float) -> Column:
    """How a depth is shown: missing, excluded (outside the range) or included."""
    return F.when(depth.isNull() | (depth <= 0), "missing").when(~depth.between(near, far), "excluded").otherwise("included")


def fusion_gate(z: Column, px: Column, py: Column, measured: Column, weight: Column, width: int, height: int, most: float, truncation: float) -> Column:
    """Whether a sample may be folded in: before the camera, inside the picture, measured within range, trusted, and not far behind the surface."""
    inside = px.between(0, width - 1) & py.between(0, height - 1)
    return F.coalesce((z > 0) & inside & (measured > 0) & (measured <= most) & (weight > 0) & (measured - z >= -truncation), F.lit(False))


def usable_views(df: DataFrame, view: str, depth: str, cloud: str, pixels: int = 1000, points: int = 100) -> DataFrame:
    """Views with enough valid depths and enough distinct cloud cells."""
    own = df.groupBy(view).agg(F.count_if(F.col(depth) > 0).alias("pixels"), F.count_distinct(F.when(F.col(depth) > 0, F.col(cloud))).alias("points"))
    return own.where((F.col("pixels") >= pixels) & (F.col("points") >= points))


def box_in_view(boxes: DataFrame, planes: DataFrame, ident: str) -> DataFrame:
    """(ident, view): boxes (x0..z1) that a view's planes (view, plane, a, b, c, d; a x + b y + c z + d >= 0 is inside) don't cut off whole.

    Of each plane the box's farthest corner decides, so eight corners are one
    expression. planes: six a view; they meet every box by design, as a list,
    so no row is made for a box and a plane. Boxes of one ident count as one
    that all of them must pass; unknown distances decide nothing.
    """
    corners = [f"{a}{k}" for a in "xyz" for k in "01"]
    far = lambda box, p: sum((F.greatest(p[n] * box[f"{a}0"], p[n] * box[f"{a}1"]) for n, a in zip("abc", "xyz", strict=True)), p["d"])
    views = planes.groupBy("view").agg(F.collect_list(F.struct("a", "b", "c", "d")).alias("_p"))
    own = boxes.select(ident, F.struct(*corners).alias("_b")).repartition(ident).groupBy(ident).agg(F.collect_list("_b").alias("_b"))
    met = own.crossJoin(broadcast_if_small(views))
    known = F.exists("_b", lambda box: F.exists("_p", lambda p: far(box, p).isNotNull()))
    passed = F.forall("_b", lambda box: F.forall("_p", lambda p: F.coalesce(far(box, p) >= 0, F.lit(True))))
    return met.where(known & passed).select(ident, "view")


def triangles(df: DataFrame, keys: tuple[str, ...], x: str, y: str, depth: str, width: int, floor: float = 0.03, share: float = 0.02) -> DataFrame:
    """(keys, a, b, c): two triangles a grid square whose four depths are known and differ by max(floor, share * nearest) at most.

    Corners are numbered y * width + x. Each depth is handed to the four
    squares that it is a corner of, so one aggregation finds them.
    """
    given = df.where(F.col(depth) > 0)
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in itertools.product((0, 1), repeat=2))))
    corners = given.select(*keys, x, y, F.col(depth).alias("_d"), moves.alias("_m")).select(*keys, (F.col(x) - F.col("_m.a")).alias(x), (F.col(y) - F.col("_m.b")).alias(y), "_d")
    squares = corners.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_n"), F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    whole = squares.where((F.col("_n") == 4) & (F.col("_hi") - F.col("_lo") <= F.greatest(F.lit(floor), F.col("_lo") * share)))
    at = lambda dx, dy: (F.col(y) + dy) * width + F.col(x) + dx
    face = lambda *c: F.struct(*(at(*p).cast("long").alias(n) for n, p in zip("abc", c, strict=True)))
    return whole.select(*keys, F.explode(F.array(face((0, 0), (0, 1), (1, 0)), face((1, 0), (0, 1), (1, 1)))).alias("_f")).select(*keys, "_f.*")


def patch_moments(df: DataFrame, keys: tuple[str, ...], x: str, y: str, value: str, sizes: tuple[int, ...]) -> DataFrame:
    """df with mean_s, dx_s and dy_s for each odd size s: the least-squares plane of value over the s x s patch around a cell, null unless all its cells are there.

    Sums over a patch are differences of running sums, first along rows, then
    along columns, so the cost doesn't depend on the sizes, and all sizes share
    two windows. A row or column of a frame is the most that a window holds.
    """
    row, column = Window.partitionBy(*keys, y).orderBy(x), Window.partitionBy(*keys, x).orderBy(y)
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)

    def span(w, total: str, item: str, r: int) -> Column:
        return F.lead(total, r).over(w) - F.lag(total, r).over(w) + F.lag(item, r).over(w)

    whole = lambda w, at, r: F.coalesce(F.lead(at, r).over(w) - F.lag(at, r).over(w) == 2 * r, F.lit(False))
    out = df.withColumns({"_v": F.col(value).cast("double"), "_xv": F.col(value).cast("double") * F.col(x)})
    out = out.withColumns({"_tv": F.sum("_v").over(upto(row)), "_txv": F.sum("_xv").over(upto(row))})
    for s in sizes:
        r = s // 2
        ok = whole(row, x, r)
        out = out.withColumns({f"_n{s}": ok.cast("int"), f"_a{s}": F.when(ok, span(row, "_tv", "_v", r)).otherwise(0.0), f"_b{s}": F.when(ok, span(row, "_txv", "_xv", r) - F.col(x) * span(row, "_tv", "_v", r)).otherwise(0.0)})
        out = out.withColumn(f"_c{s}", F.col(y) * F.col(f"_a{s}"))
    out = out.withColumns({f"_t{m}{s}": F.sum(f"_{m}{s}").over(upto(column)) for s in sizes for m in "nabc"})
    for s in sizes:
        r = s // 2
        square = s * sum(2 * k * k for k in range(1, r + 1))
        total = {m: span(column, f"_t{m}{s}", f"_{m}{s}", r) for m in "nabc"}
        ok = whole(column, y, r) & (total["n"] == s)
        out = out.withColumns({f"mean_{s}": F.when(ok, total["a"] / (s * s)), f"dx_{s}": F.when(ok, total["b"] / square), f"dy_{s}": F.when(ok, (total["c"] - F.col(y) * total["a"]) / square)})
    return out.select(*df.columns, *(f"{m}_{s}" for s in sizes for m in ("mean", "dx", "dy")))


def incidence(df: DataFrame, keys: tuple[str, ...], x: str, y: str, z: str, camera: tuple[float, float, float, float], sizes: tuple[int, ...] = (7, 3), floor: float = 0.02, share: float = 0.02) -> DataFrame:
    """df with edge, fitted and cosine: how squarely a local plane of inverse depth meets the ray (camera: fx, fy, cx, cy).

    The first size whose patch is whole, without a hole or an edge, gives the
    plane; where none is, cosine is 0.5 and fitted false. A cell without depth has no plane.
    """
    fx, fy, cx, cy = camera
    flagged = edge_flags(df, keys, x, y, z, floor, share)
    usable = F.coalesce((F.col(z) > 0) & ~F.col("edge"), F.lit(False))
    good = patch_moments(flagged.where(usable).withColumn("_inverse", 1 / F.col(z)), keys, x, y, "_inverse", sizes)
    rx, ry = (F.col(x) - cx) / fx, (F.col(y) - cy) / fy
    angles = []
    for s in sizes:
        a, b, mean = F.col(f"dx_{s}") * fx, F.col(f"dy_{s}") * fy, F.col(f"mean_{s}")
        c = mean - a * rx - b * ry
        size = F.sqrt(a * a + b * b + c * c) * F.sqrt(1 + rx * rx + ry * ry)
        angles.append(F.when(mean.isNotNull(), F.least(F.greatest(mean / F.greatest(size, F.lit(1e-10)), F.lit(0.0)), F.lit(1.0))))
    fitted = F.coalesce(*angles)
    good = good.select(*flagged.columns, fitted.isNotNull().alias("fitted"), F.coalesce(fitted, F.lit(0.5)).alias("cosine"))
    return good.unionByName(flagged.where(~usable).withColumns({"fitted": F.lit(False), "cosine": F.lit(0.5)}))


def depth_weights(df: DataFrame, keys: tuple[str, ...], x: str, y: str, z: str, camera: tuple[float, float, float, float]) -> DataFrame:
    """incidence with weight: the observation weight by depth and angle; 0 for a hole, on an edge, or where a fitted plane is seen too flatly."""
    found = incidence(df, keys, x, y, z, camera)
    none = ~F.coalesce(F.col(z) > 0, F.lit(False)) | F.col("edge") | (F.col("fitted") & (F.col("cosine") < 0.25))
    near = F.pow(0.003 / (0.001 + 0.002 * F.col(z) * F.col(z)), F.lit(2))
    return found.withColumn("weight", F.when(none, 0.0).otherwise(F.least(F.greatest(near, F.lit(0.05)), F.lit(1.0)) * F.col("cosine") * F.col("cosine")))


def smooth_depth(df: DataFrame, keys: tuple[str, ...], x: str, y: str, z: str, sizes: tuple[int, ...] = (9, 5, 3), floor: float = 0.03, share: float = 0.02, most: float = 0.01) -> DataFrame:
    """df with smooth: depths by local planes of inverse depth, whose centre is the mean inverse depth.

    The first size whose patch is whole and crosses no jump, and that moves the
    depth by max(most, most * depth) at most, counts; other cells, holes and edges stay as they are.
    """
    known = neighbours(df, keys, x, y, z)
    jump = lambda n: F.coalesce((F.col(n) > 0) & (F.abs(F.col(n) - F.col(z)) > F.greatest(F.lit(floor), share * F.least(n, z))), F.lit(False))
    sides = ("left", "right", "up", "down")
    known = known.withColumn("_edge", jump(sides[0]) | jump(sides[1]) | jump(sides[2]) | jump(sides[3])).drop(*sides)
    usable = F.coalesce((F.col(z) > 0) & ~F.col("_edge"), F.lit(False))
    good = patch_moments(known.where(usable).withColumn("_inverse", 1 / F.col(z)), keys, x, y, "_inverse", sizes)
    near = [F.when(F.abs(1 / F.col(f"mean_{s}") - F.col(z)) <= F.greatest(F.lit(most), most * F.col(z)), 1 / F.col(f"mean_{s}")) for s in sizes]
    good = good.select(*df.columns, F.coalesce(*near, F.col(z).cast("double")).alias("smooth"))
    return good.unionByName(known.where(~usable).select(*df.columns, F.col(z).cast("double").alias("smooth")))
