"""Operators on small hand-valued tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.functions import geometry as g
from framewise.operators import asof, dedup, graph, knn, pairing, robust, sampling, score, select, sequence, stencil, surface, voxel
from framewise.plans.ship import ship
from framewise.sources import io
from framewise.streaming import jobs


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def one(spark, **columns):
    return list(spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first())


def test_wrapping_clock(spark):
    assert one(spark, a=g.wrap_delta(F.lit(5), F.lit(2**32 - 5)), b=g.wrap_delta(F.lit(2**32 - 5), F.lit(5)), c=g.wrap_delta(F.lit(120_000), F.lit(0), 60_000.0)) == [10, -10, 2.0]


def test_poses(spark):
    turn = F.array(*map(F.lit, [0.0, -1.0, 0.0, 1.0, 1.0, 0.0, 0.0, 2.0, 0.0, 0.0, 1.0, 3.0, 0.0, 0.0, 0.0, 1.0]))
    rigid, unit, angle, far, bad = one(spark, a=g.is_rigid(turn), b=g.compose(turn, g.inverse(turn)), c=g.turn_degrees(turn), d=g.travel(turn), e=g.is_rigid(F.array(*map(F.lit, [2.0] * 16))))
    assert rigid and not bad and angle == pytest.approx(90) and far == pytest.approx(math.sqrt(14))
    assert np.allclose(np.array(unit).reshape(4, 4), np.eye(4))


def test_projection_round_trip(spark):
    p = g.back_project(F.lit(100.0), F.lit(50.0), F.lit(2.0), 500, 500, 320, 240)
    q = g.project(p["x"], p["y"], p["z"], 500, 500, 320, 240)
    assert one(spark, x=q["px"], y=q["py"]) == pytest.approx([100.0, 50.0])


def test_weights_and_roundings(spark):
    got = one(spark, a=g.observation_weight(F.lit(1.0), F.lit(1.0), F.lit(False)), b=g.observation_weight(F.lit(1.0), F.lit(0.2), F.lit(False)), c=g.half_away(F.lit(2.5)), d=g.half_even(F.lit(2.5)), e=g.timely(F.lit(None).cast("double")), f=g.timely(F.lit(float("nan"))))
    assert got == [1.0, 0.0, 3.0, 2.0, True, False]


def test_slerp(spark):
    a, b = F.array(*map(F.lit, [1.0, 0.0, 0.0, 0.0])), F.array(*map(F.lit, [0.0, 1.0, 0.0, 0.0]))
    assert one(spark, q=g.slerp(a, b, F.lit(0.5)))[0] == pytest.approx([math.sqrt(0.5), math.sqrt(0.5), 0, 0])


def test_voxels_and_folds(spark):
    rows = spark.createDataFrame([(0.1, 1.0, 0.5), (0.9, 3.0, 0.5), (1.1, 5.0, 1.0), (-0.1, 7.0, 1.0)], "x double, d double, w double")
    got = {r.i_x: (r.n, r.d) for r in voxel.downsample(rows, {"x": 1.0}, ("d",)).collect()}
    assert got == {0: (2, 2.0), 1: (1, 5.0), -1: (1, 7.0)}
    f = voxel.weighted_fold(rows, [g.cell(F.col("x"), 10).alias("k")], F.col("d"), F.col("w"), 4.0)
    got = {r.k: r for r in f.collect()}
    assert got[0].tsdf == pytest.approx((0.5 * 0.25 + 0.5 * 0.75 + 1.0) / 2) and got[0].n == 3
    both = {r.k: r for r in voxel.fold_into(f, f, ["k"]).collect()}
    assert both[0].tsdf == pytest.approx(got[0].tsdf) and both[0].w == pytest.approx(2 * got[0].w)


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_asof_against_brute_force(spark, parts):
    rng = np.random.default_rng(parts)
    p = [(int(k), int(rng.integers(0, 3)), float(t)) for k, t in enumerate(rng.integers(0, 400, 80))]
    r = [(int(k), int(rng.integers(0, 3)), float(t)) for k, t in enumerate(rng.choice(400, 60, replace=False))]
    a = spark.createDataFrame(p, "id long, k long, t double").repartition(parts)
    b = spark.createDataFrame(r, "id long, k long, t double").repartition(parts)
    near = {x.id: x.ref_id for x in asof.asof_nearest(a, b, 9.0, ("k",), how="left").collect()}
    back = {x.id: x.ref_id for x in asof.asof_backward(a, b, ("k",), 50.0, max_age=120.0).collect()}
    count = {x.id: x.n_near for x in asof.count_in_range(a, b, 9.0, ("k",), "id").collect()}
    for i, k, t in p:
        own = [(abs(t - u), u, j) for j, l, u in r if l == k and abs(t - u) <= 9]
        assert near[i] == (min(own)[2] if own else None) and count[i] == len(own)
        before = [(u, j) for j, l, u in r if l == k and u <= t and t - u <= 120]
        assert back[i] == (max(before)[1] if before else None)


def pairs_by_hand(a, b, tolerance, method):
    """Over the whole table of gaps: the least one left, or row by row the least one behind the last."""
    gap = np.abs(np.array([t for t, _ in a])[:, None] - np.array([t for t, _ in b])[None, :])
    out, last = set(), -1
    for i in range(len(a)):
        at = sum(t < a[i][0] for t, _ in b)
        far = np.ones(len(b), bool)
        far[max(at - 1, 0) : at + (method != "greedy") + 1] = False
        gap[i, far | (gap[i] > tolerance)] = np.inf
    if method == "greedy":
        while np.isfinite(gap).any():
            i, j = np.unravel_index(gap.argmin(), gap.shape)
            out.add((a[i][1], b[j][1]))
            gap[i], gap[:, j] = np.inf, np.inf
        return out
    for i in range(len(a)):
        left = np.where(np.arange(len(b)) > last, gap[i], np.inf)
        if np.isfinite(left).any():
            last = int(left.argmin())
            out.add((a[i][1], b[last][1]))
    return out


def test_pairing_scenarios(spark):
    rng = np.random.default_rng(1)
    drawn = [sorted((float(t), k) for k, t in enumerate(rng.uniform(0, 300, 120))) for _ in range(2)]
    dense = [sorted((float(t), k) for k, t in enumerate(rng.integers(0, 60, 90) / 2)) for _ in range(2)]
    widening = [[(k * (k + 1) / 80, k) for k in range(0, 10, 2)], [(k * (k + 1) / 80, k) for k in range(1, 10, 2)]]
    scenes = [([(1.0, 0), (1.01, 1), (2.0, 2)], [(1.009, 0)], 0.02), ([(0.0, 0), (1.0, 1)], [(0.4, 0), (0.6, 1)], 0.5), ([(0.0, 0), (0.1, 1)], [(0.05, 0)], 0.5), (*drawn, 1.0), (*dense, 2.0), (*widening, 9.0)]
    kinds = "key long, id long, t double"
    for method in ("greedy", "nearest_unused"):
        sides = [spark.createDataFrame([(n, 1000 * n + k, t) for n, scene in enumerate(scenes) for t, k in scene[side]], kinds) for side in (0, 1)]
        for tolerance in (0.5, 2.0):
            got = {(r.a_id, r.b_id) for r in pairing.one_to_one(*sides, tolerance, "key", method).collect()}
            want = {(1000 * n + i, 1000 * n + j) for n, (a, b, _) in enumerate(scenes) for i, j in pairs_by_hand(a, b, tolerance, method)}
            assert got == want
        assert pairing.one_to_one(sides[0], sides[1].limit(0), 1.0, "key", method).count() == 0
    assert pairing.in_order([[(0.1, 1.0, 5)], [(0.0, 1.0, 5)], [(0.2, 1.5, 6), (0.2, 2.0, 7)]]) == [(0.1, 1.0, 5), None, (0.2, 1.5, 6)]


def events(spark, rows):
    return spark.createDataFrame([(k, i, float(t), float(v)) for k, i, t, v in rows], "k long, id long, t double, v double")


def test_segments_and_history(spark):
    rows = events(spark, [(1, i, t, 0.0) for i, t in enumerate([0, 1, 2, 3, 4, 20, 21.0])])
    cut = sequence.adaptive_segments(rows, ("k",), floor=2.0).orderBy("t").collect()
    assert [r.segment for r in cut] == [0] * 5 + [1] * 2 and cut[0].limit == 3.0
    split = sequence.split_segments(rows, ("k",), 3, 1).collect()
    assert sorted((r.fragment, r.id, r.owned) for r in split) == [(0, 0, True), (0, 1, True), (0, 2, True), (1, 2, False), (1, 3, True), (1, 4, True), (1, 5, True), (2, 5, False), (2, 6, True)]
    h = sequence.bounded_history(rows, ("k",), "t", 2.0, 2).orderBy("t").collect()
    assert [r.n_recent for r in h] == [1, 2, 2, 2, 2, 1, 2] and h[2].recent_from == 1.0


def test_display_turns(spark):
    angles = {1: [90, 90, 90, 90], 2: [50, 50, 50, 50], 3: [90, 180, 180, 180, 180, 10, 10, 10, 10], 4: [90, 90, 30, 90, 90, 90, 90]}
    rows = events(spark, [(k, 100 * k + i, 0.2 * i, a) for k, own in angles.items() for i, a in enumerate(own)])
    got = {}
    for r in sequence.hysteresis(rows, "k", "v").orderBy("k", "id").collect():
        got.setdefault(r.k, []).append(r.turn)
    assert got == {1: [0, 0, 90, 90], 2: [0, 0, 0, 0], 3: [0, 0, 0, 180, 180, 180, 180, 0, 0], 4: [0, 0, 0, 0, 0, 90, 90]}
    assert sequence.hysteresis(rows.limit(0), "k", "v").count() == 0 and sequence.rate_limit(rows.limit(0), "k", 1.0).count() == 0


def test_smoothing_and_state(spark):
    rows = events(spark, [(1, 0, 0.0, 1.61), (1, 1, 1.0, 2.0), (1, 2, 2.0, 1.0)])
    assert sequence.asymmetric_ema(rows, ("k",), "v", ("t",)).first().smoothed == pytest.approx(1.805 - 0.1 * 0.805)
    found = sequence.rate_limit(events(spark, [(1, i, t / 10, 0.0) for i, t in enumerate(range(5))]), "k", 0.15, fps=10)
    assert [r.taken for r in found.orderBy("id").collect()] == [True, False, True, False, True]
    assert sequence.moved([0, 1, 2, 3], [0, 5, 12, 13], 10, 1) == [True, False, True, False]
    t = np.arange(6) * 0.05
    found = sequence.gravity_rows(t, np.tile([0, -9.80665, 0.0], (6, 1)))
    assert found.valid.iloc[-1] and found.confidence.iloc[-1] == pytest.approx(1.0) and found.up_y.iloc[-1] == pytest.approx(-1)
    assert not sequence.gravity_rows([0.0], np.array([[0, 0, 1.0]])).valid[0]
    down = np.array([[0, -9.8, 0.0]] * 8 + [[0, 9.8, 0.0]] * 12 + [[np.nan, 0, 0], [0, 9.8, 0], [0, 9.8, 0]])
    at = np.append(np.arange(21) * 0.05, [5.0, 5.05])
    turned = sequence.gravity_rows(at, down)
    # The median flips after half of its eight rows; the mean all but vanishes on the way, and starts anew.
    assert (turned.up_y[:8].dropna() < 0).all() and turned.up_y[19] == pytest.approx(1) and not turned.valid[20] and turned.up_y[22] == pytest.approx(1)
    assert turned.up_y[8:20].isna().sum() == 1
    assert len(sequence.gravity_rows([], np.zeros((0, 3)))) == 0


def test_loss_changes_and_trails(spark):
    rows = events(spark, [(1, i, float(i), v) for i, v in enumerate([1, 0, 0, 0, 0, 1, 0])])
    got = sequence.loss_episodes(rows, ("k",), F.col("v") == 0, ("t",), "id").orderBy("t").collect()
    assert [r.episode for r in got] == [0, 1, 1, 1, 1, 1, 2] and [r.consecutive for r in got] == [0, 1, 2, 3, 4, 0, 1]
    assert [r.probe for r in got] == [False, True, True, True, True, False, True] and got[4].last_good == 0
    assert [r.id for r in sequence.changes_only(rows, ("k",), ("v",), ("t",)).orderBy("t").collect()] == [0, 1, 5, 6]
    path = sequence.trails(spark.createDataFrame([(7, 1), (7, 2), (7, 4)], "id long, f long"), "id", "f").orderBy("f").collect()
    assert [(r.linked, r.age) for r in path] == [(False, 0), (True, 1), (False, 0)]
    best = sequence.best_of_recent(events(spark, [(1, 0, 0.0, 5.0), (1, 1, 0.2, 3.0), (1, 2, 0.4, 4.0)]).withColumn("ok", F.lit(True)), ("k",), "v", "ok").orderBy("t").collect()
    assert [r.best_t for r in best] == [0.0, 0.0, 0.4]


def test_motion_between_rows(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 2.0), (1, 2.0, None), (1, 3.0, 8.0)], "k long, t double, v double")
    assert [r.filled for r in sequence.interpolate(rows, ("k",), "v").orderBy("t").collect()] == [0.0, 2.0, 5.0, 8.0]
    ahead = sequence.extrapolate(events(spark, [(1, i, float(i), 2.0 * i) for i in range(3)]), ("k",), "v").orderBy("t").collect()
    assert [r.predicted for r in ahead] == [None, None, 4.0]
    assert sequence.lifetimes(spark.createDataFrame([(1, 1), (1, 3), (2, 2)], "id long, f long"), "id", "f").where("id = 1").first().age == 2


def test_robust_aggregates(spark):
    rows = spark.createDataFrame([(1, 3.0), (1, -40.0), (1, None)], "k long, e double")
    got = rows.groupBy("k").agg(robust.capped_rmse(F.col("e"), 10.0).alias("c"), robust.saturated_loss(F.col("e"), 10.0).alias("s")).first()
    assert got.c == pytest.approx(math.sqrt((9 + 100 + 100) / 3)) and got.s == pytest.approx(54.5)
    same = spark.createDataFrame([(1, 0.2, 1.0), (1, 0.2, 1.0), (1, 0.9, 1.0)], "k long, v double, w double")
    assert robust.irls_consensus(same, ["k"], "v", "w").first().consensus < 0.25
    picked = robust.argmax(spark.createDataFrame([(1, 5, 2.0), (1, 3, 2.0), (1, 1, 1.0)], "k long, view long, w double"), ["k"], "view", "w").first()
    assert picked.view == 3


def test_missing_is_penalised(spark):
    seen = spark.createDataFrame([(i, 0, 1000.0) for i in range(4)], "p long, view long, z double")
    none = score.view_metrics(seen, seen.limit(0), ["p"], "view", "z", 5.0, 100.0).first()
    some = score.view_metrics(seen, seen.where("p < 2"), ["p"], "view", "z", 5.0, 100.0).first()
    assert (none.rmse, none.completeness, none.f_score) == (100.0, 0.0, 0.0) and some.precision == 1.0 and some.rmse > 70


def test_sampling(spark):
    rows = spark.range(1000).withColumn("v", F.pmod(F.col("id") * 7919, F.lit(1000))).repartition(5)
    got = {r.v: r.rn for r in sampling.numbered(rows, ["v"]).collect()}
    assert all(rn == v + 1 for v, rn in got.items())
    assert [r.v for r in sampling.linspace(rows, ["v"], 5).orderBy("v").collect()] == [0, 249, 499, 749, 999]
    cells = spark.createDataFrame([("a", 9), ("a", 8), ("a", 7), ("b", 1)], "c string, s long")
    assert [(r.c, r.s) for r in sampling.stratified_top_k(cells, "c", [F.desc("s")], 3).orderBy("turn", "c").collect()] == [("a", 9), ("b", 1), ("a", 8)]
    area = spark.createDataFrame([(k, float(k)) for k in range(1, 11)], "id long, area double")
    draws = {r.id: r.draws for r in sampling.area_sample(area, "area", "id", 550).collect()}
    assert sum(draws.values()) == 550 and all(abs(draws[k] - 10 * k) <= 1 for k in draws)
    inter = sampling.interleave(spark.createDataFrame([(0, 1, "x"), (0, 2, "y"), (1, 1, "x")], "g long, o long, id string"), "g", ["o"], "id")
    assert {r.id: (r.turn, r.g) for r in inter.collect()} == {"x": (1, 0), "y": (2, 0)}


def test_ingestion(spark):
    up = spark.createDataFrame([(1, 0, "a", 1), (1, 0, "a", 2), (1, 0, "b", 3), (1, 2, "c", 4)], "s long, q long, d string, at long")
    assert [r.status for r in dedup.receipts(up, "s", "q", "d", "at").orderBy("at").collect()] == ["stored", "replayed", "conflict", "stored"]
    assert dedup.accepted_prefix(up.dropDuplicates(["s", "q"]), "s", "q").count() == 1
    tags = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 0)], "tag long, frame long")
    assert [r.tag for r in dedup.quarantine(tags, ["tag"], ["frame"]).collect()] == [2]
    a = spark.createDataFrame([(1, 0.1, "x"), (2, 0.2, "y")], "id long, v double, s string")
    b = spark.createDataFrame([(1, 0.1 + 1e-12, "x"), (2, 0.2, "z")], "id long, v double, s string")
    assert [r.first_difference for r in dedup.tolerant_compare(a, b, "id", ["v", "s"]).orderBy("id").collect()] == [None, "s"]
    f = [dedup.fingerprint(x, [], [F.col("id"), F.col("v")]).first().fingerprint for x in (a, a.repartition(3).orderBy(F.desc("id")), b)]
    assert f[0] == f[1] != f[2]
    assert dedup.disjoint(a.where("id = 1"), a.where("id = 2"), "id")


def test_neighbours_in_space(spark):
    rng = np.random.default_rng(3)
    pts = [(i, *map(float, rng.uniform(0, 5, 3))) for i in range(120)]
    df = spark.createDataFrame(pts, "id long, x double, y double, z double")
    got = {r.a_id: r.b_id for r in knn.radius_nearest(df.where("id < 60"), df.where("id >= 60"), ("x", "y", "z"), 1.0, "id").collect()}
    for i, *p in pts[:60]:
        near = [(math.dist(p, q), j) for j, *q in pts[60:] if math.dist(p, q) < 1]
        assert got.get(i) == (min(near)[1] if near else None)


def test_stencils(spark):
    z = {(x, y): 1000.0 for x in range(4) for y in range(4)} | {(1, 1): 2000.0}
    df = spark.createDataFrame([(0, x, y, v) for (x, y), v in z.items()], "f long, x long, y long, d double")
    got = {(r.x, r.y): (r.support, r.supported) for r in stencil.support_filter(df, ("f",), "x", "y", "d").collect()}
    assert got[1, 1] == (0, False) and got[3, 3] == (2, True) and got[0, 1] == (2, True)
    assert stencil.z_buffer(df, ["f"], "d").count() == 15
    mid = spark.createDataFrame([(1, 0.5, 0.5)], "id long, px double, py double")
    assert stencil.bilinear(mid, df, "id", "px", "py", "d").first().d == pytest.approx(1250)


def test_graphs(spark):
    path = spark.createDataFrame([(i, i + 1, float(i)) for i in range(40)] + [(100, 101, 1.0), (7, 7, 1.0)], "src long, dst long, score double")
    got = {r.id: r.component for r in graph.connected_components(path).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert graph.connected_components(path.limit(0)).count() == 0
    hops = {r.id: r.hops for r in graph.reachable(path.where("src > 35"), spark.createDataFrame([(38,)], "id long")).collect()}
    assert hops == {36: 2, 37: 1, 38: 0, 39: 1, 40: 2}
    square = spark.createDataFrame([(0, 1, 4.0), (1, 2, 3.0), (2, 3, 2.0), (3, 0, 1.0), (0, 2, 3.0)], "src long, dst long, score double")
    assert {(r.src, r.dst) for r in graph.spanning_forest(square, "score").collect()} == {(0, 1), (0, 2), (2, 3)}
    faces = spark.createDataFrame([(0, 1, 2, 3), (1, 2, 3, 4)], "face long, a long, b long, c long")
    assert [(r.u, r.v) for r in graph.face_adjacency(faces).collect()] == [(2, 3)]
    step = [1.0, 0, 0, -1.0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
    tree = spark.createDataFrame([(0, 1, [float(v) for v in step]), (1, 2, [float(v) for v in step])], "src long, dst long, pose array<double>")
    assert {r.id: r.world[3] for r in graph.propagate(tree, 0).collect()} == {0: 0.0, 1: 1.0, 2: 2.0}


def test_redundancy_selection(spark):
    rows = spark.createDataFrame([(g, v, s, 1.0) for g in (0, 1) for v in range(5) for s in range(10)] + [(2, 0, 0, 1.0), (2, 1, 0, 0.5), (2, 2, 0, 0.5), (2, 3, 0, 0.5), (2, 3, 1, 1.0)], "g long, v long, s long, w double")
    kept = {(r.g, r.v): r.kept for r in select.redundant_views(rows, "g", "v", "s", "w").collect()}
    assert [kept[0, v] for v in range(5)] == [False, False, True, True, True]
    assert [kept[2, v] for v in range(4)] == [True, False, True, True]
    kept = {(r.g, r.v): r.kept for r in select.redundant_views(rows, "g", "v", "s", "w", protected=F.col("v") == 0).collect()}
    assert [kept[0, v] for v in range(5)] == [True, False, False, True, True]
    assert select.tolerance_dedup([0, 0.5, 1.2], 1.0) == [True, False, True]


def test_keyframes():
    assert select.keyframes(10, 4) == [0, 3, 6, 9] and select.keyframes(3, 9, ((0, 1),)) == [0, 1, 2]
    found = select.keyframes(100, 9, ((3, 50), (3, 4)))
    assert len(found) == 9 and {0, 33, 66, 99, 3, 50, 4} <= set(found)
    # Four even ones and four of two pairs leave one place: only a pair with one new position fits.
    assert {3, 50, 7, 60, 8} <= set(select.keyframes(100, 9, ((3, 50), (7, 60), (20, 21), (7, 8))))
    assert select.halved_gaps(np.array([0, 10, 16]), 3).tolist() == [0, 2, 5, 10, 13, 16]


def test_global_gains(spark):
    edges = spark.createDataFrame([(0, 1, math.log(1.25)), (1, 2, math.log(0.8 / 0.7)), (8, 9, 5.0), (9, 8, None)], "a long, b long, r double")
    assert {r.view: r.gain for r in select.global_gains(edges, "a", "b", "r").collect()} == pytest.approx({0: 1.0, 1: 1.25, 2: 1 / 0.7, 8: 1.0, 9: 1.5})


def test_pairs_of_tags_and_times(spark):
    rows = spark.createDataFrame([(0, i) for i in range(40)] + [(1, 5), (1, 9)], "k long, i long")
    near = {(r.k, r.i, r.j) for r in sequence.temporal_pairs(rows, ("k",), "i").collect()}
    assert near == {(0, j - d, j) for j in range(40) for d in (1, 2, 3) if j >= d}
    bank = {(r.i, r.j) for r in sequence.bank_pairs(rows.where("k = 0"), "k", "i").collect()}
    for j in range(40):
        want = set(range(min(j, 5))) | set(list(range(0, j, 4))[-27:]) | set(range(max(0, j - 8), j))
        assert {i for i, y in bank if y == j} == want
    edges = sequence.path_edges(rows.withColumn("ok", F.col("i") != 7), ("k",), "i", "ok").where("k = 0").collect()
    assert {(r.from_index, r.to_index) for r in edges} == {(i, i + 1) for i in range(39) if 7 not in (i, i + 1)}


def test_sources(spark, tmp_path):
    (tmp_path / "times.txt").write_text("# head\n1.5 a b\n\n 2.5 c\n")
    assert [(r.t, r.fields) for r in io.timestamp_text(spark, str(tmp_path / "times.txt")).orderBy("t").collect()] == [(1.5, ["a", "b"]), (2.5, ["c"])]
    (tmp_path / "seg").mkdir()
    (tmp_path / "seg" / "rgb.jsonl").write_text('{"sequence": 0, "timestamp_s": 1.0}\n{"sequence": 1, "timestamp_s": 2.0}\nbroken')
    rows = io.journal(spark, str(tmp_path / "seg" / "rgb.jsonl"))
    status = spark.createDataFrame([("seg", 0.0, True, True, 0, 1)], io.STATUS_ROW)
    assert rows.count() == 2 and io.checkpointed(rows, status).count() == 1
    assert io.inventory(rows, status).first().asDict() == {"recording_segment": "seg", "started_at": 0.0, "usable": 1, "complete": True}
    io.export_tables({"a": status}, str(tmp_path / "project"))
    assert io.import_tables(spark, str(tmp_path / "project"))["a"].count() == 1
    lookup = spark.createDataFrame([(0, 400), (1, 401)], "code int, mm int")
    assert [r.mm for r in io.raw_to_mm(spark.createDataFrame([(0,), (2047,)], "code int"), lookup).orderBy("code").collect()] == [400, None]


def test_stream_pairer_steps():
    wait, pending, pairs = jobs.pair_step([], None, [(0.0, 0), (33.0, 1)], [(40.0, 9)], 50.0)
    assert pairs == [] and pending == (40.0, 9)
    wait, pending, pairs = jobs.pair_step(wait, pending, [(66.0, 2)], [], 50.0)
    assert pairs == [(9, 1, 40.0, 33.0)] and wait == [(66.0, 2)] and pending is None
    assert jobs.pair_step([(0.0, 0)], None, [], [(-100.0, 1)], 50.0) == ([(0.0, 0)], None, [])


def test_cascades(spark):
    rules = [("a", F.col("x") > 1), ("b", F.col("x") < 0)]
    rows = spark.createDataFrame([(2,), (-1,), (0,), (None,)], "x int")
    assert sorted(r.r for r in rows.select(score.first_reason(rules).alias("r")).collect()) == ["a", "a", "accepted", "b"]
    bad = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0), (1, 1, 0.5, 0.6, 1.0), (1, 1, 0.7, 0.0, 1.0)], "k long, q long, t double, lo double, hi double")
    assert {r.reason for r in score.validate_stream(bad, ["k"], "q", "t", "lo", "hi").collect()} == {"repeated identity"}


def test_fits(spark):
    from framewise.operators import fit

    rng = np.random.default_rng(8)
    p = rng.uniform(-1, 1, (60, 3)) + [0, 0, 2]
    pose = fit.twist_pose(np.array([0.1, -0.2, 0.05, 0.3, 0.1, -0.2]))
    q = p @ pose[:3, :3].T + pose[:3, 3]
    q[:4] += 0.5  # outliers
    df = spark.createDataFrame([(1, *map(float, a), *map(float, b)) for a, b in zip(p, q, strict=True)], "k long, px double, py double, pz double, qx double, qy double, qz double")
    found = np.array(fit.trimmed_fit(df, ["k"], limit=0.2, rounds=4).first().pose).reshape(4, 4)
    assert np.allclose(found, pose, atol=1e-6)
    flat = np.column_stack([rng.uniform(-1, 1, (80, 2)), np.full(80, 0.5)])
    flat[:5, 2] += 1
    n, d, s = fit.plane(flat)
    assert np.allclose(n, [0, 0, 1], atol=1e-9) and d == pytest.approx(0.5) and s < 1e-9
    line = spark.createDataFrame([(1, float(i), 2.0 * i) for i in range(10)], "k long, x double, y double")
    got = fit.condition(line, ["k"], ["x", "y"]).first()
    assert got.least == pytest.approx(0, abs=1e-9) and got.most > 1
    raw = rng.standard_normal((50, 3))
    a, rmse = fit.affine_calibration(spark.createDataFrame([(*map(float, v), *map(float, (2 * v + 0.1) / 9.80665)) for v in raw], "ax double, ay double, az double, ux double, uy double, uz double"))
    assert np.allclose(a, np.column_stack([2 * np.eye(3), np.full(3, 0.1)])) and rmse < 1e-6
    votes = fit.place_votes(spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "q long, l string"), "q", "l")
    assert {r.l: r.votes for r in votes.collect()} == {"a": 2, "b": 1}
    sup = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (2, 1, 2), (2, 3, 4)], "bridge long, a long, b long")
    assert [r.bridge for r in fit.independent_supports(sup, "bridge", "a", "b").collect()] == [2]


def test_registration(spark):
    from framewise.operators import fit

    rng = np.random.default_rng(2)
    rows = []
    for axis in range(3):  # three faces of a box
        pts = rng.uniform(0, 0.5, (120, 3))
        pts[:, axis] = 0
        rows += [(*v, *np.eye(3)[axis]) for v in pts]
    target = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "id long, x double, y double, z double, nx double, ny double, nz double")
    move = fit.twist_pose(np.array([0.01, -0.02, 0.01, 0.01, -0.005, 0.008]))
    src = np.array([r[:3] for r in rows]) @ move[:3, :3].T + move[:3, 3]
    source = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(src)], "id long, x double, y double, z double")
    found = fit.icp(source, target, radii=(0.12, 0.06), rounds=(3, 3))
    assert np.allclose(found @ move, np.eye(4), atol=2e-3)


def test_percentiles_of_hot_and_odd_keys(spark):
    from framewise.operators import robust

    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 700, 3000)] + [("one", 5.0), ("none", None), (None, 1.0), (None, 2.0)] + [("ties", 7.0)] * 50
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: (r.m, r.p) for r in robust.percentiles(df, ["k"], "v", {"m": 0.5, "p": 0.93}).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        own = [v for n, v in rows if n == k and v is not None]
        want[k] = tuple(float(np.percentile(own, 100 * p)) for p in (0.5, 0.93)) if own else (None, None)
    assert got.keys() == want.keys()
    assert all(got[k] == want[k] or np.allclose(got[k], want[k]) for k in want)
    assert robust.percentiles(df.where("false"), ["k"], "v", {"m": 0.5}).count() == 0
    assert [r.m for r in robust.percentiles(df.where("k = 'ties'"), [], "v", {"m": 0.5}).collect()] == [7.0]


def test_gauge_ties_need_spread(spark):
    rng = np.random.default_rng(5)
    rows = []
    for mark in range(60):
        px, py = rng.uniform(0, 640), rng.uniform(0, 480)
        x, y, z = rng.normal(size=3)
        rows += [(mark, view, px, py, x, y, z) for view in (0, 1)] + [(mark, 1, px, py, x, y, z)]  # a repeated sighting counts once
        rows += [(100 + mark, view, px, py, x, x, x) for view in (1, 2)]  # points on a line tie nothing
        rows += [(200 + mark, view, px, py, x, y, z) for view in (1, 3)]
        rows += [(300 + mark, view, px / 100, py / 100, x, y, z) for view in (3, 4)]  # one corner of the picture ties nothing
    rows += [(400 + mark, view, 30.0 * mark, 25.0 * (mark % 7), *rng.normal(size=3)) for mark in range(19) for view in (3, 5)]  # too few
    df = spark.createDataFrame([(a, b, *map(float, c)) for a, b, *c in rows], "landmark long, view long, px double, py double, x double, y double, z double")
    assert {(r.id, r.hops) for r in graph.gauge_connected(df, 0, (640.0, 480.0)).collect()} == {(0, 0), (1, 1), (3, 2)}
    assert [r.id for r in graph.gauge_connected(df.where("false"), 0, (640.0, 480.0)).collect()] == [0]


def test_mark_gate_and_shared_candidates(spark):
    from framewise.operators import marks

    box = lambda x, y, s: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))]
    turned = lambda c: c[1:] + c[:1]
    rows = [(0, 1, "a", box(0, 0, 30)), (0, 2, "b", turned(box(1, 2, 31))), (0, 3, "c", box(100, 0, 30)), (0, 4, "d", box(200, 0, 10)), (0, 5, "e", box(300, 0, 30)), (0, 6, "e", box(400, 0, 30)), (1, 7, "a", box(0, 0, 30)), (1, 8, "b", None)]
    df = spark.createDataFrame(rows, "frame long, id long, mark string, corners array<struct<x: double, y: double>>")
    got = {r.id: r.state for r in marks.mark_gate(df, "frame", "id", "mark", "corners").collect()}
    assert got == {1: "overlapping", 2: "overlapping", 3: "usable", 4: "small", 5: "repeated", 6: "repeated", 7: "usable", 8: "small"}
    assert marks.mark_gate(df.where("false"), "frame", "id", "mark", "corners").isEmpty()
    assert [(r.j, r.i, r.shared) for r in marks.shared_candidates(df, "frame", "mark").collect()] == [(1, 0, 2)]


def test_smoothing_and_triangles_at_borders(spark):
    values = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 2.0)], "id long, value double")
    edges = spark.createDataFrame([(1, 2, 1.0), (1, 9, 4.0)], "src long, dst long, w double")
    assert {r.id: r.value for r in graph.smooth(values, edges, "w", rounds=1).collect()} == {1: 2.0, 2: 4.0, 3: 2.0}
    grid = spark.createDataFrame([(0, x, y, 1.0 if (x, y) != (2, 0) else 9.0) for x in range(3) for y in range(2)] + [(1, 0, 0, None)], "frame long, x long, y long, z double")
    assert {(r.a, r.b, r.c) for r in stencil.triangles(grid, ("frame",), "x", "y", "z", 3).collect()} == {(0, 3, 1), (1, 3, 4)}


def test_replay_without_samples_or_modes(spark):
    from framewise.plans.replay import replay

    pictures = spark.createDataFrame([("s", 1, 0.0), ("s", 2, 1.0)], "segment string, id long, t double")
    samples = spark.createDataFrame([], "segment string, id long, t double, ax double, ay double, az double")
    modes = spark.createDataFrame([("s", 0.5, "fixed"), ("r", 0.0, "other")], "segment string, t double, mode string")
    got = replay(pictures, pictures.withColumn("t", F.col("t") + 0.01), samples, modes, "segment", 0.02, 0.15, 10.0).collect()
    assert sorted((r.a_id, r.b_id, r.sample, r.valid, r.mode) for r in got) == [(1, 1, None, False, "auto"), (2, 2, None, False, "fixed")]


def test_ties_with_nulls_and_empty_tables(spark):
    turn = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    far = turn[:3] + [0.5] + turn[4:]
    poses = spark.createDataFrame([(1, turn, turn), (2, turn, far), (3, turn, None), (4, turn, turn)], "id long, old array<double>, new array<double>")
    ties = spark.createDataFrame([(1, 4), (1, 4), (1, 2), (1, 3), (1, 9), (None, 1)], "src long, dst long")
    got = [(r.src, r.dst, r.reason) for r in graph.boundary_checks(ties, poses, "id", "old", "new").collect()]
    assert sorted(got, key=str) == sorted([(1, 4, "kept"), (1, 4, "kept"), (1, 2, "too_far"), (1, 3, "missing"), (1, 9, "missing"), (None, 1, "missing")], key=str)
    seen = spark.createDataFrame([(1, 2, 5, turn), (1, 2, 3, turn), (1, 3, 5, turn), (1, 3, 4, far), (2, 3, 1, far), (2, 4, 1, None), (None, 4, 1, turn)], "a long, b long, n int, pose array<double>")
    held = spark.createDataFrame([(2, 3, turn), (1, 2, turn)], "a long, b long, pose array<double>")
    state = {(r.a, r.b): (r.witnesses, r.state) for r in graph.witnessed_ties(seen, held, "a", "b", [-F.col("n")], "pose").collect()}
    assert state == {(1, 2): (2, "held"), (1, 3): (2, "ambiguous"), (2, 3): (1, "ambiguous")}
    assert graph.witnessed_ties(seen.limit(0), held, "a", "b", [-F.col("n")], "pose").isEmpty()


def test_bridges_see_both_sides(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 4)], "id long, component long")
    seen = spark.createDataFrame([(1, 3, 600, 0.5), (2, 3, 100, 0.0), (1, 4, 400, 0.1), (4, 2, 400, 0.1), (1, 2, 900, 0.9), (1, None, 9, 0.1)], "src long, dst long, tested long, fraction double")
    bridges = spark.createDataFrame([(2, 3), (4, 1), (1, 2), (3, 4), (1, 8), (None, 1)], "src long, dst long")
    got = {(r.src, r.dst): (r.tested, r.conflicts, r.reason) for r in graph.bridge_visibility(bridges, labels, seen).collect()}
    assert got == {(2, 3): (700, 1, "conflict"), (4, 1): (800, 0, "supported"), (1, 2): (0, 0, "same_component"), (3, 4): (0, 0, "supported"), (1, 8): (0, 0, "unknown"), (None, 1): (0, 0, "unknown")}
    assert graph.bridge_visibility(bridges, labels, seen.limit(0)).count() == 6


def test_batches_stop_at_barriers(spark):
    rows = spark.createDataFrame([(1, True, "a"), (2, True, "a"), (3, True, "a"), (4, False, "a"), (5, True, "a"), (6, True, "b"), (7, None, "b"), (8, True, None), (9, True, None)], "t int, ok boolean, o string").withColumn("k", F.lit(1))
    assert [r.batch for r in sequence.batches(rows, ("k",), ("t",), F.col("ok"), "o", 2).orderBy("t").collect()] == [0, 0, 1, 2, 3, 4, 5, 6, 6]


def test_planes_and_pages(spark):
    flat = [(k, float(k % 9), float(k * 7 % 11), 2.0) for k in range(60)] + [(100 + k, 5.0, float(k), 10.0 + k * k % 13) for k in range(40)] + [(900, None, 1.0, 2.0)]
    points = spark.createDataFrame(flat, "id long, x double, y double, z double").withColumn("k", F.lit("s"))
    got = surface.segment_planes(points, "k", "id", ("x", "y", "z"), 0.01, least=30, rounds=3).orderBy("round").collect()
    assert [r.n for r in got] == [60, 40] and abs(got[0].nz) == pytest.approx(1) and abs(got[1].nx) == pytest.approx(1)
    assert surface.segment_planes(points.limit(0), "k", "id", ("x", "y", "z"), 0.01).isEmpty()
    faces = spark.createDataFrame([(k, float(k), 0.0, 1) for k in range(8)] + [(8, 100.0, 0.0, 50), (9, 1.0, 0.0, None)], "id long, x double, y double, a int")
    pages = {r.id: r.page for r in surface.face_pages(faces, "id", ("x", "y"), "a", 4).collect()}
    assert pages == {0: 4, 1: 4, 2: 4, 3: 4, 4: 5, 5: 5, 6: 5, 7: 5, 8: 3}
    assert surface.face_pages(faces.limit(0), "id", ("x", "y"), "a", 4).isEmpty()
    rows = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None)], "k string, u double, v double")
    assert {(r.metric, r.n, r["median"]) for r in score.measurement_summary(rows, ["k"], ["u", "v"]).collect()} == {("u", 2, 2.0), ("v", 0, None)}
