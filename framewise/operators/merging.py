"""Decisions that depend on earlier ones, scene by scene: maps merged into the largest, searches that grow from anchors, planes grouped in order."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import compose, inverse
from ..plans.shared import materialise
from .graph import connected_components


def _union(steps: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, steps)


def merge_maps(maps: DataFrame, evidence: DataFrame, least: int = 1, most: float = 0.12, rounds: int = 1000) -> DataFrame:
    """(scene, map, state, world, round): which maps of a scene join its largest one, and their poses in it.

    maps: scene, map, size, accepted (by its own validation). evidence, any
    number of rows a pair: scene, src, dst, tested, free (tests that meet free
    space), conflicts, supports and the measured pose that carries src to dst.
    The largest accepted map (ties: smallest id) is the target; the others
    follow by falling size, one by one. A map joins if the evidence between it
    and all maps that have joined before counts `least` supports, no conflict
    and at most a share `most` of tests in free space. The bridge with the
    least such share gives its pose (ties: smallest map, then smallest pose).

    A map waits only for earlier maps that it has evidence with, so each round
    decides all maps that wait for none: the result is that of one by one, in
    as many rounds as the longest chain of such maps. A round is one join and one
    aggregation of the folded pairs, written to the shared folder. state: target, joined,
    rejected (not accepted, or null), unsupported, conflict. world is null
    unless joined; round is 0 where nothing was waited for. Evidence with a null or
    unknown end, or of a map with itself, takes no part; a pose that is null
    supports nothing. Maps have one row each; rows with a null scene or map are
    left out.
    """
    maps = materialise(maps.where("scene is not null and map is not null").select("scene", "map", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("accepted", F.lit(False)).alias("accepted")), "maps")
    fine = maps.where("accepted").select("scene", "map", F.struct((-F.col("size")).alias("s"), F.col("map").alias("m")).alias("_o"))
    side = lambda c: fine.select("scene", F.col("map").alias(c), F.col("_o").alias(f"_{c}"))
    met = evidence.join(side("src"), ["scene", "src"]).join(side("dst"), ["scene", "dst"]).where("src <> dst")
    later = F.col("_src") > F.col("_dst")
    share = F.coalesce("free", F.lit(0)) / F.greatest("tested", F.lit(1))
    pose = F.when(later, F.col("pose")).otherwise(inverse(F.col("pose")))
    bridge = F.when((F.col("supports") > 0) & F.col("pose").isNotNull(), F.struct(share.alias("share"), F.col("early"), pose.alias("pose")))
    met = met.withColumns({"late": F.when(later, F.col("src")).otherwise(F.col("dst")), "early": F.when(later, F.col("dst")).otherwise(F.col("src"))}).withColumn("_b", bridge)
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("tested", "free", "conflicts")]
    pairs = materialise(met.groupBy("scene", "late", "early").agg(*sums, F.sum(F.when(F.col("_b").isNotNull(), F.col("supports"))).alias("supports"), F.min("_b").alias("_b")), "map-pairs")

    identity = F.array(*(F.lit(float(k % 5 == 0)) for k in range(16)))
    nowhere = F.lit(None).cast("array<double>")
    first = fine.groupBy("scene").agg(F.min("_o").alias("_o")).select("scene", F.col("_o.m").alias("map"), F.lit(True).alias("_first"))
    begun = F.when(~F.col("accepted"), "rejected").when(F.col("_first"), "target")
    known = maps.join(first, ["scene", "map"], "left").withColumn("state", begun)
    known = materialise(known.select("scene", "map", "state", F.when(F.col("_first"), identity).otherwise(nowhere).alias("world"), F.when(F.col("state").isNotNull(), 0).alias("round")), "map-states")
    inside = F.col("_s").isin("target", "joined")
    for k in range(rounds):
        if known.where("state is null").isEmpty():
            return known
        met = pairs.join(known.select("scene", F.col("map").alias("early"), F.col("state").alias("_s"), F.col("world").alias("_w")), ["scene", "early"])
        own = [F.sum(F.when(inside, F.col(c))).alias(f"_{c}") for c in ("tested", "free", "conflicts", "supports")]
        bridge = F.min(F.when(inside & F.col("_b").isNotNull(), F.struct("_b.share", "early", "_b.pose", "_w"))).alias("_best")
        told = met.groupBy("scene", F.col("late").alias("map")).agg(F.max(F.col("_s").isNull()).alias("_waits"), *own, bridge)
        clear = (F.col("_conflicts") == 0) & (F.col("_free") <= most * F.col("_tested"))
        said = F.when(F.coalesce("_supports", F.lit(0)) < least, "unsupported").when(clear, "joined").otherwise("conflict")
        now = known.join(told, ["scene", "map"], "left").withColumn("_said", F.when(F.col("state").isNull() & ~F.coalesce("_waits", F.lit(False)), said))
        world = F.when(F.col("_said") == "joined", compose(F.col("_best._w"), F.col("_best.pose"))).otherwise(F.col("world"))
        turn = F.when(F.col("_said").isNotNull(), k).otherwise(F.col("round"))
        known = materialise(now.select("scene", "map", F.coalesce("state", "_said").alias("state"), world.alias("world"), turn.alias("round")), "map-states")
    raise RuntimeError(f"maps are open after {rounds} rounds")


def frontier_search(candidates: DataFrame, roots: DataFrame, budget: int = 256) -> DataFrame:
    """(scene, src, dst, number, joins): the order in which a search from roots tests pairs, and the tests that reach a new vertex.

    candidates: scene, src, dst, distance and verified (what a test of the
    pair would say), one row a pair; roots: scene, id. A search tests the
    nearest pair (by distance, src, dst) with one end reached; without such a
    pair, the nearest with both ends reached; else it ends. A verified test
    reaches the other end. It also ends after `budget` tests. number counts
    from 1 and is null for pairs that aren't tested.

    Tests that fail change nothing, so a round takes, in all scenes at once,
    the pairs up to the first verified one, and in the end all pairs between
    reached vertices: one round a vertex reached, at most budget. Only a
    scene's first budget tests are ranked in one task. Rows with a null among
    scene, src, dst and distance, and pairs of a vertex with itself, are never
    tested; a null verified fails.
    """
    order = F.struct("distance", "src", "dst")
    real = candidates.where("scene is not null and distance is not null and src <> dst")
    pending = materialise(real.select("scene", "src", "dst", "distance", F.coalesce("verified", F.lit(False)).alias("verified")), "frontier-open")
    reached = materialise(roots.where("scene is not null and id is not null").select("scene", "id").distinct(), "frontier-reached")
    steps: list[DataFrame] = []
    for k in range(budget):
        at = lambda c: reached.select("scene", F.col("id").alias(c), F.lit(True).alias(f"_{c}"))
        seen = pending.join(at("src"), ["scene", "src"], "left").join(at("dst"), ["scene", "dst"], "left").where("_src or _dst").withColumn("_out", F.col("_src").isNull() | F.col("_dst").isNull())
        stop = seen.groupBy("scene").agg(F.min(F.when(F.col("_out") & F.col("verified"), order)).alias("_stop"), F.max("_out").alias("_any"))
        take = seen.join(stop, "scene").where("_out = _any").where(F.col("_stop").isNull() | (order <= F.col("_stop")))
        joins = F.col("_out") & F.col("verified")
        step = materialise(take.select("scene", "src", "dst", "distance", joins.alias("joins"), F.when(joins, F.when(F.col("_src").isNull(), F.col("src")).otherwise(F.col("dst"))).alias("_new"), F.lit(k).alias("_round")), "frontier-step")
        if step.isEmpty():
            break
        steps.append(step)
        reached = materialise(reached.unionByName(step.where("joins").select("scene", F.col("_new").alias("id"))), "frontier-reached")
        spent = _union(steps).groupBy("scene").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= budget)
        pending = materialise(pending.join(step, ["scene", "src", "dst"], "left_anti").join(spent, "scene", "left_anti"), "frontier-open")
    found = candidates.select("scene", "src", "dst")
    if not steps:
        return found.select("scene", "src", "dst", F.lit(None).cast("int").alias("number"), F.lit(False).alias("joins"))
    own = Window.partitionBy("scene").orderBy("_round", "distance", "src", "dst")
    tests = _union(steps).withColumn("number", F.row_number().over(own)).where(F.col("number") <= budget).select("scene", "src", "dst", "number", "joins")
    return found.join(tests, ["scene", "src", "dst"], "left").select("scene", "src", "dst", "number", F.coalesce("joins", F.lit(False)).alias("joins"))


def plane_groups(planes: DataFrame, distance: float = 0.15, degrees: float = 12.0, nearest: float = 0.05) -> DataFrame:
    """(scene, node, plane, nx, ny, nz, d, lead_node, lead_plane): planes seen from several views, grouped one by one.

    planes: scene, node, plane, a unit normal nx, ny, nz and the distance d
    along it, in the scene's coordinates. Normals are turned so that d isn't
    negative; planes nearer than `nearest` to the origin, and rows with nulls, are left out. In the
    order of node and plane, each joins the group whose mean distance is
    nearest (ties: the earlier group) among those all of whose members lie
    within distance and degrees, strictly, or leads a new one.

    Planes that may share a group lie in touching cells of distance and
    normal, so the touching occupied cells (links between cells, not between
    planes) cut a scene into pieces that are grouped apart; the result is the
    same as over the whole scene. Pieces stream through tasks in order, which
    hold the numbers of one piece. A piece is as large as its cells hang together.
    """
    known = planes.select("scene", "node", "plane", *(F.col(c).cast("double").alias(c) for c in ("nx", "ny", "nz", "d"))).dropna()
    sign = F.when(F.col("d") < 0, -1.0).otherwise(1.0)
    known = known.withColumns({c: F.col(c) * sign for c in ("nx", "ny", "nz", "d")}).where(F.col("d") >= nearest)
    chord = 2 * math.sin(math.radians(degrees) / 2)
    steps = [("d", distance), ("nx", chord), ("ny", chord), ("nz", chord)]
    known = materialise(known.withColumns({f"_{c}": F.floor(F.col(c) / width).cast("long") for c, width in steps}), "planes")
    cells = known.select("scene", *(f"_{c}" for c, _ in steps)).distinct()
    name = lambda *c: F.concat_ws(":", F.col("scene").cast("string"), *(x.cast("string") for x in c))
    own = name(*(F.col(f"_{c}") for c, _ in steps))
    moves = [m for m in itertools.product((-1, 0, 1), repeat=4) if m >= (0, 0, 0, 0)]
    to = F.explode(F.array(*(name(*(F.col(f"_{c}") + by for (c, _), by in zip(steps, m, strict=True))) for m in moves)))
    links = cells.select(own.alias("src"), to.alias("dst")).join(cells.select(own.alias("dst")), "dst", "left_semi")
    pieces = connected_components(links)
    cosine = math.cos(math.radians(degrees))

    kinds = {c: t for c, t in known.dtypes if not c.startswith("_")}

    def run(batches):
        piece, k = None, 0
        members, label = np.zeros((16, 4)), np.zeros(16, int)  # normals and distances of the piece so far, and their groups
        for b in batches:
            found = []
            values = np.stack([b.column(c).to_numpy() for c in ("nx", "ny", "nz", "d")], axis=1)
            for here, node, plane, row in zip(b.column("component").to_pylist(), b.column("node").to_pylist(), b.column("plane").to_pylist(), values, strict=True):
                if here != piece:
                    piece, k, sums, sizes, lead = here, 0, [], [], []
                if k == len(label):
                    members, label = np.concatenate([members, np.zeros_like(members)]), np.concatenate([label, np.zeros_like(label)])
                unlike = (np.abs(members[:k, 3] - row[3]) >= distance) | (members[:k, :3] @ row[:3] <= cosine)
                fine = np.ones(len(lead), bool)
                fine[label[:k][unlike]] = False
                near = np.flatnonzero(fine).tolist()
                if near:
                    g = min(near, key=lambda g: abs(row[3] - sums[g] / sizes[g]))  # noqa: B023
                else:
                    g = len(lead)
                    sums.append(0.0), sizes.append(0), lead.append((node, plane))
                members[k], label[k] = row, g
                sums[g] += row[3]
                sizes[g] += 1
                k += 1
                found.append(lead[g])
            leads = [pa.array([f[i] for f in found], b.column(c).type) for i, c in enumerate(("node", "plane"))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kinds), *leads], names=[*kinds, "lead_node", "lead_plane"])

    shape = ", ".join(f"{c} {t}" for c, t in kinds.items()) + f", lead_node {kinds['node']}, lead_plane {kinds['plane']}"
    rows = known.withColumn("_id", own).join(pieces.select(F.col("id").alias("_id"), "component"), "_id").select("component", *kinds)
    return rows.repartition("component").sortWithinPartitions("component", "node", "plane").mapInArrow(run, shape)


def joint_planes(groups: DataFrame, least: int = 3, span: int = 3) -> DataFrame:
    """(scene, lead_node, lead_plane, nodes, nx, ny, nz, d) of groups seen by least views or more that lie over span apart: mean unit normal and mean distance."""
    mean = [F.avg(c).alias(c) for c in ("nx", "ny", "nz", "d")]
    own = groups.groupBy("scene", "lead_node", "lead_plane").agg(F.count_distinct("node").alias("nodes"), (F.max("node") - F.min("node")).alias("_span"), *mean).where((F.col("nodes") >= least) & (F.col("_span") > span))
    length = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + F.col("nz") * F.col("nz"))
    return own.select("scene", "lead_node", "lead_plane", "nodes", *((F.col(c) / length).alias(c) for c in ("nx", "ny", "nz")), "d")
