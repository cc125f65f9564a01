"""Graph operators that work in rounds over tables: contradictions, windings and labels of least energy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialise
from .blocks import Blocks
from .graph import _both_ways, connected_components, spanning_forest


def without_contradictions(edges: DataFrame, positions: DataFrame, axes: tuple[str, ...], limit: float, sweeps: int = 2, rounds: int = 100, ident: str = "edge", own: float = 1.0) -> DataFrame:
    """edges with gone: the round in which a contradictory edge was dropped, null for those that stay.

    An edge (ident, src, dst, weight, one offset an axis) measures src's
    position relative to dst's; positions (id, axes) are where vertices start.
    Each round moves every vertex a few times to the weighted mean of what its
    edges say and its own place (weight own), and measures by how far each edge
    still misses. Of the edges that miss by more than limit, those go that are the
    worst at both of their ends (by the miss to 1e-6, then ident): the worst
    of all always is, and far-apart contradictions go at once. The next round
    goes on from the moved positions, without what went. It ends when no edge
    misses by more than limit. Edges with a null end, offset or weight, or an
    unknown end, take no part (gone 0). Edges stand in files of the shared folder
    (blocks.Blocks), and each round writes what misses and what goes there.
    """
    unusable = edges.where(" or ".join(f"{c} is null" for c in ("src", "dst", "weight", *axes))).select(ident)
    known = edges.where(" and ".join(f"{c} is not null" for c in ("src", "dst", "weight", *axes))).select(ident, "src", "dst", "weight", *axes)
    blocks = Blocks(known, positions, axes, ident, own, edges.count())
    out, gone = materialise(unusable.unionAll(blocks.unknown).distinct(), "unusable"), None
    out = out if out.isEmpty() else materialise(out.join(blocks.idents(), ident, "left_anti"), "unusable")
    steps = [out.withColumn("gone", F.lit(0))]
    for k in range(1, rounds + 1):
        bad = blocks.swept(k, sweeps, gone, limit - 1e-6).withColumn("_m", F.round("_miss", 6)).where(F.col("_m") > limit)
        bad = materialise(bad.select(ident, "src", "dst", "_block", F.struct("_m", ident).alias("_r")), "contradictions")
        worst = bad.select(F.col("src").alias("v"), "_r").unionAll(bad.select("dst", "_r")).groupBy("v").agg(F.max("_r").alias("_r"))
        gone = bad.join(worst.select(F.col("v").alias("src"), "_r"), ["src", "_r"], "left_semi").join(worst.select(F.col("v").alias("dst"), "_r"), ["dst", "_r"], "left_semi")
        gone = materialise(gone.select(ident, "_block", F.lit(k).alias("gone")), "dropped")
        if gone.isEmpty():
            dropped = steps[0]
            for s in steps[1:]:
                dropped = dropped.unionAll(s)
            return edges.join(dropped, ident, "left")
        steps.append(gone.select(ident, "gone"))
    raise RuntimeError(f"contradictions remain after {rounds} rounds")


def shared_sides(faces: DataFrame) -> DataFrame:
    """(src, dst, flip): pairs of faces (face, a, b, c) with a side that no other face has; flip where both run along it the same way."""
    sides = F.array(*(F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"), (F.col(x) < F.col(y)).alias("up")) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))))
    met = faces.select("face", F.explode(sides).alias("s")).groupBy("s.u", "s.v").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("face", "s.up")).alias("l"), F.max(F.struct("face", "s.up")).alias("r"))
    return met.where("n = 2 and l.face <> r.face").select(F.col("l.face").alias("src"), F.col("r.face").alias("dst"), (F.col("l.up") == F.col("r.up")).alias("flip"))


def windings(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(face, component, flipped) and the cut sides (src, dst): which faces to turn round so that neighbours run along shared sides in opposite ways.

    A forest of sides, the least (src, dst) first, decides. Each face stands
    twice in a graph, kept and turned; a side ties like copies, or unlike ones
    where it flips, so the component of a face's two copies tells its turn
    relative to the smallest face. Sides off the forest that disagree are cut;
    where the faces can be turned consistently there are none.
    """
    sides = materialise(shared_sides(faces).groupBy("src", "dst").agg(F.min("flip").alias("flip"), F.max("flip").alias("_other")), "sides")
    forest = spanning_forest(sides.withColumn("_zero", F.lit(0)), "_zero").select("src", "dst")
    flips = F.when(F.col("flip"), 1).otherwise(0)
    tied = forest.join(sides, ["src", "dst"]).select("src", "dst", flips.alias("f")).withColumn("p", F.explode(F.array(F.lit(0), F.lit(1))))
    copies = connected_components(tied.select((F.col("src") * 2 + F.col("p")).alias("src"), (F.col("dst") * 2 + F.col("p").bitwiseXOR(F.col("f"))).alias("dst")))
    # The smaller copy of the smallest face is kept; its component holds each other face's copy that goes with it.
    kept = copies.where("component % 2 = 0").select(F.floor(F.col("id") / 2).alias("face"), F.floor(F.col("component") / 2).alias("component"), (F.col("id") % 2 == 1).alias("flipped"))
    found = faces.select("face").distinct().join(kept, "face", "left").select("face", F.coalesce("component", "face").alias("component"), F.coalesce("flipped", F.lit(False)).alias("flipped"))
    found = materialise(found, "windings")
    met = sides.join(found.select(F.col("face").alias("src"), F.col("flipped").alias("_a")), "src").join(found.select(F.col("face").alias("dst"), F.col("flipped").alias("_b")), "dst")
    against = ((F.col("_a") != F.col("_b")) != F.col("flip")) | (F.col("flip") != F.col("_other"))
    return found, met.where(against).select("src", "dst")


def coloured(vertices: DataFrame, both: DataFrame, rounds: int = 1000) -> DataFrame:
    """(id, colour) with unlike colours along edges (a, b), each given both ways.

    In each round the vertices whose digest is the least among neighbours
    without a colour take the smallest colour that no neighbour has: what one
    by one in the order of digests would give, in about logarithmic rounds. A
    vertex of degree n gets one of the first n + 1 colours. Joins are merged,
    so no side passes through the driver.
    """
    rank = lambda c: F.struct(F.md5(F.col(c).cast("string").cast("binary")), F.col(c))
    left = materialise(vertices.select("id"), "colour-left")
    done = vertices.sparkSession.createDataFrame([], "id long, colour int")
    for _ in range(rounds):
        if left.isEmpty():
            return done
        open_ = both.join(left.select(F.col("id").alias("a")).hint("merge"), "a", "left_semi")
        wait = open_.join(left.select(F.col("id").alias("b")).hint("merge"), "b", "left_semi").groupBy(F.col("a").alias("id")).agg(F.min(rank("b")).alias("_near"))
        turn = left.join(wait.hint("merge"), "id", "left").where(F.col("_near").isNull() | (rank("id") < F.col("_near"))).select("id")
        used = open_.join(done.select(F.col("id").alias("b"), "colour").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.collect_set("colour").alias("_used"))
        taken = F.coalesce("_used", F.array().cast("array<int>"))
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size(taken)), taken))
        step = materialise(turn.join(used.hint("merge"), "id", "left").select("id", free.alias("colour")), "colour-step")
        done = materialise(done.unionAll(step), "coloured")
        left = materialise(left.join(step.hint("merge"), "id", "left_anti"), "colour-left")
    raise RuntimeError(f"vertices without a colour after {rounds} rounds")


def _first(value: Column, view: Column) -> Column:
    """A rank whose least one has the largest value, then the smallest view."""
    return F.struct((-value).alias("v"), view.alias("w"))


def potts_labels(scores: DataFrame, edges: DataFrame, price: float = 0.35, diffusions: int = 5, passes: int = 12) -> tuple[DataFrame, list[float]]:
    """(id, label) and the energy after each pass: a view for each face, good by itself and mostly its neighbours' too.

    scores (id, view, score > 0) over faces, edges (a, b) between them, once
    each. A label costs -ln(score / best score of its face), and each edge with
    unlike labels costs price; faces without scores have no label and no
    edges. Labels start as the best after some rounds of averaging with
    neighbours, view by view. Then the faces of one colour at a time, of which
    no two are neighbours, take the label of least energy where that gains, so
    the energy never rises; a pass without change ends it. A face's sums over
    neighbours are joins by edge, of the edges of that colour only; no face's
    views are gathered. Joins are merged, so no side passes through the driver.
    """
    own = scores.where("id is not null and view is not null and score > 0").groupBy("id", "view").agg(F.max("score").alias("score"))
    best = own.groupBy("id").agg(F.max("score").alias("_best"))
    own = materialise(own.join(best.hint("merge"), "id").select("id", "view", (F.col("score") / F.col("_best")).alias("rel")), "potts-scores")
    seen = materialise(own.select("id").distinct(), "potts-faces")
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(seen.select(F.col("id").alias("a")).hint("merge"), "a", "left_semi").join(seen.select(F.col("id").alias("b")).hint("merge"), "b", "left_semi").select("a", "b")
    both = materialise(_both_ways(pairs, "a", "b"), "potts-edges")
    colours = materialise(coloured(seen, both), "potts-colours")
    kinds = sorted(r[0] for r in colours.select("colour").distinct().collect())  # at most the largest degree and one
    both = materialise(both.join(colours.select(F.col("id").alias("a"), "colour").hint("merge"), "a").select("a", "b", "colour"), "potts-edges")
    degree = both.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    own = own.join(colours.hint("merge"), "id").join(degree.hint("merge"), "id", "left")
    own = materialise(own.select("id", "view", "rel", "colour", F.coalesce("_n", F.lit(0)).alias("_n")), "potts-scores")
    smooth = own.withColumn("s", F.col("rel"))
    for _ in range(diffusions):
        near = both.join(smooth.select(F.col("id").alias("b"), "view", "s").hint("merge"), "b").groupBy(F.col("a").alias("id"), "view").agg(F.sum("s").alias("_s"))
        mean = F.coalesce("_s", F.lit(0.0)) / F.greatest("_n", F.lit(1))
        smooth = materialise(smooth.drop("s").join(near.hint("merge"), ["id", "view"], "left").select("id", "view", "rel", "_n", (0.5 * F.col("rel") + 0.5 * mean).alias("s")), "potts-smooth")
    labels = materialise(smooth.groupBy("id").agg(F.min(_first(F.col("s"), F.col("view"))).alias("_l")).select("id", F.col("_l.w").alias("label")), "potts-labels")
    energies = []
    for _ in range(passes):
        labels = labels.select("id", "label", F.lit(False).alias("changed"))
        for kind in kinds:
            votes = both.where(F.col("colour") == kind).join(labels.select(F.col("id").alias("b"), "label").hint("merge"), "b").groupBy(F.col("a").alias("id"), F.col("label").alias("view")).agg(F.count(F.lit(1)).alias("_same"))
            cost = own.where(F.col("colour") == kind).join(votes.hint("merge"), ["id", "view"], "left")
            cost = cost.join(labels.select("id", "label").hint("merge"), "id").select("id", "view", "label", (-F.ln("rel") + price * (F.col("_n") - F.coalesce("_same", F.lit(0)))).alias("e"))
            least = cost.groupBy("id").agg(F.min(F.struct("e", "view")).alias("_m"), F.min(F.when(F.col("view") == F.col("label"), F.col("e"))).alias("_held"))
            better = least.where(F.col("_m.e") < F.col("_held") - 1e-6).select("id", F.col("_m.view").alias("_new"))
            labels = materialise(labels.join(better.hint("merge"), "id", "left").select("id", F.coalesce("_new", "label").alias("label"), (F.col("_new").isNotNull() | F.col("changed")).alias("changed")), "potts-labels")
        data = own.join(labels.select("id", F.col("label").alias("view")).hint("merge"), ["id", "view"]).agg(F.sum(-F.ln("rel"))).first()[0] or 0.0
        ends = both.where("a < b").join(labels.select(F.col("id").alias("a"), F.col("label").alias("_a")).hint("merge"), "a").join(labels.select(F.col("id").alias("b"), F.col("label").alias("_b")).hint("merge"), "b")
        energies.append(data + price * ends.where("_a <> _b").count())
        if labels.where("changed").isEmpty():
            break
    return labels.select("id", "label"), energies
