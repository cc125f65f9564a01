"""Graph operators over edge tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import cell, compose, inverse, is_rigid, middle_eigenvalue, transform, travel, turn_degrees
from ..plans.shared import materialise
from .score import first_reason


def _both_ways(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(a, b) of each edge and of its reverse; edges are computed once."""
    ends = [F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in ((src, dst), (dst, src))]
    return edges.select(F.explode(F.array(*ends)).alias("_e")).select("_e.a", "_e.b")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 100) -> DataFrame:
    """(id, component): each vertex of an edge and the smallest id that it reaches.

    Each round takes the smallest label among neighbours (an aggregation that
    combines before the shuffle) and then twice the label's own label, which
    costs no edges, so the rounds grow with the logarithm to base four of the
    diameter. Each round is written to the
    shared folder. Null ends make no edge; an empty table gives no rows.
    """
    both = materialise(_both_ways(edges, src, dst).where("a is not null and b is not null").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "components")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        own = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        for _ in range(2):
            up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
            own = materialise(own.join(up, "component", "left").select("id", "old", F.least("component", "up").alias("component")), "components")
            labels = own.select("id", "component")
        if own.where("component < old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def component_sizes(components: DataFrame) -> DataFrame:
    """(component, size), to be ordered by (-size, component)."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def conflict_free(components: DataFrame, members: DataFrame, ident: str, view: str) -> DataFrame:
    """Components that hold no two members of one view: (component, size)."""
    own = components.join(members.select(F.col(ident).alias("id"), view), "id")
    return own.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.count_distinct(view).alias("_views")).where("size = _views").select("component", "size")


def reachable(edges: DataFrame, roots: DataFrame, src: str = "src", dst: str = "dst", directed: bool = False, rounds: int = 1000) -> DataFrame:
    """(id, hops) of all vertices reached from roots (id)."""
    out = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")) if directed else _both_ways(edges, src, dst)
    out = materialise(out.distinct(), "edges")
    known = front = materialise(roots.select("id").distinct().withColumn("hops", F.lit(0)), "reached")
    for hop in range(1, rounds + 1):
        step = front.join(out, front.id == out.a).select(F.col("b").alias("id")).distinct().join(known, "id", "left_anti").withColumn("hops", F.lit(hop))
        front = materialise(step, "front")
        if front.isEmpty():
            return known
        known = materialise(known.unionByName(front), "reached")
    raise RuntimeError(f"the frontier did not end in {rounds} rounds")


def _kruskal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (_ca, _cb, _rank), given in order, that join two trees."""
    up: dict = {}

    def root(v):
        while up.setdefault(v, v) != v:
            up[v] = v = up[up[v]]
        return v

    for batch in batches:
        joins = []
        for a, b in zip(batch.column("_ca").to_pylist(), batch.column("_cb").to_pylist(), strict=True):
            a, b = root(a), root(b)
            joins.append(a != b)
            up[a] = b
        yield batch.filter(pa.array(joins, pa.bool_()))


def _roots(best: DataFrame, rounds: int) -> DataFrame:
    """(c, root) of components (c, p) that each follow one best edge to p: the smaller of the two that follow one edge is the root, the others jump twice as far each time."""
    up = lambda df: df.select(F.col("c").alias("p"), F.col("p").alias("_up"))
    loose = best.join(up(best), "p").select("c", F.when((F.col("_up") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
    jumps = materialise(loose, "forest-jump")
    for _ in range(rounds):
        jumps = materialise(jumps.join(up(jumps), "p").select("c", F.col("_up").alias("p"), (F.col("_up") != F.col("p")).alias("_moved")), "forest-jump")
        if jumps.where("_moved").isEmpty():
            return jumps.select("c", F.col("p").alias("root"))
        jumps = jumps.select("c", "p")
    raise RuntimeError(f"the forest did not end in {rounds} rounds")


def spanning_forest(edges: DataFrame, score: str, src: str = "src", dst: str = "dst", rounds: int = 64, first: str | None = None, finish: int = 16384) -> DataFrame:
    """The maximum spanning forest by (first, -score, src, dst): Boruvka rounds, each an aggregation over the edges between components.

    With that total order the forest equals the one that takes edges greedily.
    A round at least halves the components and keeps the best edge between two
    of them; the last `finish` edges, a number that doesn't grow with the
    data, are taken in order by one task.
    """
    rank = F.struct((F.lit(0) if first is None else F.col(first)).alias("f"), (-F.col(score)).alias("s"), F.col(src).alias("a"), F.col(dst).alias("b"))
    found = lambda df: df.select(F.col("_rank.a").alias(src), F.col("_rank.b").alias(dst), (-F.col("_rank.s")).alias(score))
    between = lambda a, b: [F.least(a, b).alias("_ca"), F.greatest(a, b).alias("_cb")]
    open_ = edges.where(F.col(src) != F.col(dst)).groupBy(*between(F.col(src), F.col(dst))).agg(F.min(rank).alias("_rank"))
    taken = None
    for _ in range(rounds):
        open_ = materialise(open_, "forest-open")
        if open_.count() <= finish:
            last = open_.repartition(1).sortWithinPartitions("_rank").mapInArrow(_kruskal, open_.schema)
            return found(last if taken is None else taken.unionByName(last.select("_rank")))
        sides = open_.select(F.col("_ca").alias("c"), F.struct("_rank", F.col("_cb").alias("p")).alias("_b")).unionAll(open_.select("_cb", F.struct("_rank", F.col("_ca").alias("p"))))
        best = materialise(sides.groupBy("c").agg(F.min("_b").alias("_b")).select("c", "_b.p", "_b._rank"), "forest-step")
        step = best.select("_rank").distinct()
        taken = step if taken is None else taken.unionByName(step)
        roots = _roots(best.select("c", "p"), rounds)
        met = open_
        for side in ("_ca", "_cb"):
            met = met.join(roots.select(F.col("c").alias(side), F.col("root").alias(f"{side}_")), side)
        met = met.where("_ca_ <> _cb_")
        open_ = met.groupBy(*between(F.col("_ca_"), F.col("_cb_"))).agg(F.min("_rank").alias("_rank"))
    raise RuntimeError(f"the forest did not end in {rounds} rounds")


def propagate(tree: DataFrame, root: int, src: str = "src", dst: str = "dst", pose: str = "pose", rounds: int = 1000) -> DataFrame:
    """(id, world): poses composed along a tree from root; an edge's pose carries source points to its target."""
    identity = F.array(*(F.lit(float(k % 5 == 0)) for k in range(16)))
    links = tree.select(F.col(src).alias("a"), F.col(dst).alias("b"), inverse(F.col(pose)).alias("m")).unionAll(tree.select(F.col(dst), F.col(src), F.col(pose)))
    links = materialise(links, "links")
    front = known = materialise(tree.sparkSession.range(1).select(F.lit(root).cast("long").alias("id"), identity.alias("world")), "poses")
    for _ in range(rounds):
        step = front.join(links, front.id == links.a).select(F.col("b").cast("long").alias("id"), compose(F.col("world"), F.col("m")).alias("world"))
        front = materialise(step.join(known.select("id"), "id", "left_anti"), "front")
        if front.isEmpty():
            return known
        known = materialise(known.unionByName(front), "poses")
    raise RuntimeError(f"poses did not end in {rounds} rounds")


def ambiguous(hypotheses: DataFrame, key: str, score: str, position: str, share: float = 0.85, distance: float = 0.05) -> DataFrame:
    """Per key the best hypothesis, and whether one nearly as good lies apart from it."""
    best = hypotheses.groupBy(key).agg(F.max(F.struct(score, position)).alias("_b"))
    rival = (F.col(score) >= share * F.col(f"_b.{score}")) & (F.abs(F.col(position) - F.col(f"_b.{position}")) > distance)
    return hypotheses.join(best, key).groupBy(key).agg(F.max(f"_b.{score}").alias("best"), F.max(f"_b.{position}").alias("position"), F.max(rival).alias("ambiguous"))


def face_adjacency(faces: DataFrame) -> DataFrame:
    """Edges that exactly two faces (face, a, b, c) share: (u, v, left_face, right_face)."""
    sides = F.array(*(F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))))
    own = faces.select("face", F.explode(sides).alias("e")).groupBy("e.u", "e.v").agg(F.count(F.lit(1)).alias("_n"), F.min("face").alias("left_face"), F.max("face").alias("right_face"))
    return own.where("_n = 2").select("u", "v", "left_face", "right_face")


def ranked_forest(edges: DataFrame, kind: str, ranks: dict[str, int], score: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """The spanning forest that takes edges by the rank of their kind first, then by score; kinds without a rank take no part."""
    rank = F.lit(None).cast("int")
    for name, r in ranks.items():
        rank = F.when(F.col(kind) == name, r).otherwise(rank)
    known = edges.withColumn("_rank", rank).where("_rank is not null")
    return spanning_forest(known, score, src, dst, first="_rank").select(src, dst)


def large_components(edges: DataFrame, least: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component, size) of vertices in components of least vertices or more."""
    labels = connected_components(edges, src, dst)
    return labels.join(component_sizes(labels).where(F.col("size") >= least), "component").select("id", "component", "size")


def smooth(values: DataFrame, edges: DataFrame, weight: str, own: float = 3.0, rounds: int = 2) -> DataFrame:
    """(id, value) after rounds of weighted means over a vertex itself (weight `own`) and its neighbours.

    edges: src, dst and a weight, each edge once. An edge whose other end has
    no value doesn't count, and a vertex without edges keeps its value.
    """
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("_near"), F.col(weight).alias("_w"))
    both = materialise(both.unionAll(both.select(F.col("_near").alias("id"), F.col("id").alias("_near"), "_w")), "adjacency")
    for _ in range(rounds):
        met = both.join(values.select(F.col("id").alias("_near"), F.col("value").alias("_v")), "_near").where("_v is not null")
        sums = met.groupBy("id").agg(F.sum("_w").alias("_w"), F.sum(F.col("_w") * F.col("_v")).alias("_s"))
        mean = (own * F.col("value") + F.coalesce("_s", F.lit(0.0))) / (own + F.coalesce("_w", F.lit(0.0)))
        values = materialise(values.join(sums, "id", "left").select("id", mean.alias("value")), "smoothed")
    return values


def gauge_connected(sightings: DataFrame, root: int, size: tuple[float, float], least: int = 20, bend: float = 0.002, extent: float = 0.04) -> DataFrame:
    """(id, hops): the views that shared landmarks tie to root.

    sightings: landmark, view, px, py and the measured point x, y, z. A
    landmark ties its first view to each other one (a star, so its links grow
    with its views and not with their pairs). Two views are tied by at least
    `least` landmarks that, seen from either side, spread in two directions
    (the middle eigenvalue's share of the scatter exceeds bend) and over
    `extent` of the picture. A landmark counts once a view.
    """
    point = F.struct("px", "py", "x", "y", "z")
    once = sightings.groupBy("landmark", "view").agg(F.min(point).alias("_p"))
    first = once.groupBy("landmark").agg(F.min(F.struct("view", "_p")).alias("_f"))
    star = once.join(first, "landmark").where("view <> _f.view").select(F.col("_f.view").alias("src"), F.col("view").alias("dst"), F.col("_f._p").alias("a"), F.col("_p").alias("b"))
    spread = [f(f"{side}.{axis}").alias(f"_{n}_{side}_{axis}") for side in "ab" for axis in ("px", "py") for n, f in (("lo", F.min), ("hi", F.max))]
    scatter = [F.covar_samp(f"{side}.{c[0]}", f"{side}.{c[1]}").alias(f"_c_{side}_{c}") for side in "ab" for c in ("xx", "xy", "xz", "yy", "yz", "zz")]
    pairs = star.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_n"), *spread, *scatter).where(F.col("_n") >= least)
    for side in "ab":
        xx, xy, xz, yy, yz, zz = (F.col(f"_c_{side}_{c}") for c in ("xx", "xy", "xz", "yy", "yz", "zz"))
        width, height = (F.col(f"_hi_{side}_{a}") - F.col(f"_lo_{side}_{a}") for a in ("px", "py"))
        pairs = pairs.where((middle_eigenvalue(xx, xy, xz, yy, yz, zz) > bend * F.greatest(xx + yy + zz, F.lit(1e-9))) & (width / size[0] * height / size[1] >= extent))
    return reachable(pairs.select("src", "dst"), sightings.sparkSession.range(root, root + 1))


def component_clouds(components: DataFrame, points: DataFrame, ident: str, pose: str, axes: tuple[str, str, str], size: float) -> DataFrame:
    """Per component the points of its members, moved by their poses, as means of cells of a size: one shuffle, partial sums first."""
    members = components.select(F.col("id").alias(ident), "component")
    moved = points.join(members, ident).select("component", transform(F.col(pose), *(F.col(a) for a in axes)).alias("_q"))
    cells = [cell(F.col("_q")[a], size).alias(f"i_{a}") for a in "xyz"]
    return moved.groupBy("component", *cells).agg(*(F.avg(F.col("_q")[a]).alias(a) for a in "xyz"), F.count(F.lit(1)).alias("n"))


def _between(a: Column, b: Column) -> Column:
    """The pose from a to b; the slice of all of it keeps the optimizer from writing its sums out again at each use."""
    return F.slice(compose(inverse(a), b), 1, 16)


def _disagree(df: DataFrame, name: str, a: str, b: str, distance: float, degrees: float) -> DataFrame:
    """df with name: whether two poses lie further apart than a distance or an angle."""
    between = df.withColumn("_between", _between(F.col(a), F.col(b)))
    return between.withColumn(name, (travel(F.col("_between")) > distance) | (turn_degrees(F.col("_between")) > degrees)).drop("_between")


def boundary_checks(ties: DataFrame, poses: DataFrame, ident: str, old: str, new: str, distance: float = 0.03, degrees: float = 3.0) -> DataFrame:
    """ties (src, dst) with moved, turned and reason: how far new poses change the relative pose that a tie was measured at.

    reason: missing (a pose that is null or not there), not_rigid, too_far, or
    kept. Two equi-joins, merged, as poses take many times the bytes of what
    they are computed from and are never broadcast; repeated ties are judged
    alike.
    """
    own = poses.select(F.col(ident).alias("_id"), F.col(old).alias("_old"), F.col(new).alias("_new"))
    met = ties
    for side in ("src", "dst"):
        met = met.join(own.select(F.col("_id").alias(side), F.col("_old").alias(f"_old_{side}"), F.col("_new").alias(f"_new_{side}")).hint("merge"), side, "left")
    met = met.withColumns({f"_{k}": _between(F.col(f"_{k}_dst"), F.col(f"_{k}_src")) for k in ("old", "new")})
    known = F.forall(F.concat("_old", "_new"), lambda v: v.isNotNull())
    met = met.withColumn("_change", _between(F.col("_old"), F.col("_new")))
    met = met.withColumns({"moved": F.when(known, travel(F.col("_change"))), "turned": F.when(known, turn_degrees(F.col("_change")))})
    broken = [("missing", ~known), ("not_rigid", ~is_rigid(F.col("_new"))), ("too_far", (F.col("moved") > distance) | (F.col("turned") > degrees))]
    return met.withColumn("reason", first_reason(broken, "kept")).select(*ties.columns, "moved", "turned", "reason")


def witnessed_ties(witnesses: DataFrame, held: DataFrame, a: str, b: str, order: list[Column], pose: str, distance: float = 0.03, degrees: float = 3.0) -> DataFrame:
    """(a, b, witnesses, pose, state) for each pair of parts that some witness measured.

    The first witness in order gives the pose. state: ambiguous, where another
    witness or the tie that is held (a, b, pose) disagrees with it; held, where
    that tie agrees; else added. Both steps are aggregations by pair; held has
    one row a pair. Witnesses without a pair or a pose take no part.
    """
    ranked = F.min(F.struct(*(c.alias(f"_{k}") for k, c in enumerate(order)), F.col(pose).alias("_pose")))
    known = witnesses.where(F.col(pose).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull())
    best = known.groupBy(a, b).agg(ranked.alias("_b")).select(a, b, F.col("_b._pose").alias("_best"))
    met = _disagree(known.join(best, [a, b]), "_differs", "_best", pose, distance, degrees).groupBy(a, b).agg(F.count(F.lit(1)).alias("witnesses"), F.first("_best").alias(pose), F.max("_differs").alias("_unlike"))
    met = met.join(held.select(a, b, F.col(pose).alias("_held")), [a, b], "left")
    met = _disagree(met, "_against", pose, "_held", distance, degrees)
    return met.select(a, b, "witnesses", pose, F.when(F.col("_unlike") | F.coalesce("_against", F.lit(False)), "ambiguous").when(F.col("_held").isNotNull(), "held").otherwise("added").alias("state"))


def bridge_visibility(bridges: DataFrame, labels: DataFrame, evidence: DataFrame, least: int = 500, veto: float = 0.4, most: float = 0.12) -> DataFrame:
    """bridges (src, dst) with tested, fraction, conflicts and reason from what all views of both components see of each other.

    labels: (id, component); evidence: src, dst, tested and fraction (of tests
    that meet free space) per ordered pair of views. Evidence is summed by
    pair of components first, so bridges between the same components share it.
    A pair of views with `least` tests and a fraction above veto is a conflict.
    reason: unknown (an end without a component), same_component, conflict
    (one of these, or a fraction above most), or supported.
    """
    sides = lambda df: df.join(labels.select(F.col("id").alias("src"), F.col("component").alias("_a")), "src", "left").join(labels.select(F.col("id").alias("dst"), F.col("component").alias("_b")), "dst", "left")
    pair = {"_low": F.least("_a", "_b"), "_high": F.greatest("_a", "_b")}
    bad = (F.col("tested") >= least) & (F.col("fraction") > veto)
    sums = sides(evidence).where("_a <> _b").withColumns(pair).groupBy("_low", "_high").agg(F.sum("tested").alias("_n"), F.sum(F.col("tested") * F.col("fraction")).alias("_free"), F.count_if(bad).alias("_bad"))
    met = sides(bridges).withColumns(pair).join(sums, ["_low", "_high"], "left")
    met = met.withColumns({"tested": F.coalesce("_n", F.lit(0)), "conflicts": F.coalesce("_bad", F.lit(0))}).withColumn("fraction", F.coalesce("_free", F.lit(0.0)) / F.greatest("tested", F.lit(1)))
    reason = F.when(F.col("_a").isNull() | F.col("_b").isNull(), "unknown").when(F.col("_a") == F.col("_b"), "same_component").when((F.col("conflicts") > 0) | (F.col("fraction") > most), "conflict").otherwise("supported")
    return met.select(*bridges.columns, "tested", "fraction", "conflicts", reason.alias("reason"))
