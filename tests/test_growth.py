"""Work that must not grow with the square of copies, and joins that must not broadcast what they compute."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import asof, consensus, graph, knn, marks, merging, pairing, rounds, sampling, select, sequence, stencil


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boundary_checks_broadcast_no_poses(spark):
    pose = F.array(*(F.lit(float(k % 5 == 0)) for k in range(16)))
    poses = spark.range(4).select("id", pose.alias("old"), pose.alias("new"))
    got = graph.boundary_checks(spark.range(3).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), poses, "id", "old", "new")
    assert "BroadcastHashJoin" not in plan(got)
    assert {r.reason for r in got.collect()} == {"kept"}


def test_motions_copy_no_corners(spark):
    """Marks are counted without a copy of each corner for each distinct count."""
    seen = {c: F.col("id") * k % 7 + F.lit(1.0) for k, c in enumerate(("px", "py", "pz", "qx", "qy", "qz", "pu", "pv", "qu", "qv"), 1)}
    corners = spark.range(16).select((F.col("id") % 1).alias("pair"), F.floor(F.col("id") / 4).alias("mark"), (F.col("id") % 4).alias("corner"), *(v.alias(c) for c, v in seen.items()))
    assert "Expand" not in plan(consensus.mark_motion(corners, (1.0, 1.0, 1.0, 1.0)))


def test_labels_pass_no_side_through_the_driver(spark, monkeypatch):
    plans, write = [], rounds.materialise
    monkeypatch.setattr(rounds, "materialise", lambda df, name: plans.append(plan(df)) or write(df, name))
    scores = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.9), (2, 1, 1.0)], "id long, view long, score double")
    labels, energies = rounds.potts_labels(scores, spark.createDataFrame([(1, 2)], "a long, b long"), diffusions=1, passes=2)
    assert {(r.id, r.label) for r in labels.collect()} == {(1, 1), (2, 1)} and energies[-1] == pytest.approx(-math.log(0.9))
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)


def test_components_of_a_long_path_in_few_rounds(spark):
    """Edges are read about once for each factor of four in the length."""
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = graph.connected_components(path, rounds=7).groupBy("component").count().collect()
    assert [(r.component, r["count"]) for r in got] == [(0, 301)]


def test_copies_of_places_meet_as_one(spark):
    points = spark.range(160000).select("id", (F.col("id") % 5).cast("double").alias("x"), F.lit(0.0).alias("y"))
    a, b = points.where("id % 2 = 0"), points.where("id % 2 = 1")
    near = knn.radius_nearest(a, b, ("x", "y"), 3.0, "id")
    assert near.groupBy("b_id").count().count() == 5 and near.agg(F.max("distance"), F.count("*")).first()[:] == (0.0, 80000)
    assert knn.cloud_gap(a, b, ("x", "y"), 3.0, "id").first().symmetric == 0.0


def test_dense_places_by_finer_cells(spark):
    rng = random.Random(3)
    make = lambda n, at: [(at + k, rng.choice((rng.random(), 9 * rng.random())), rng.random()) for k in range(n)]
    a, b = make(300, 0), make(400, 1000)
    got = {r.a_id: (r.b_id, r.distance) for r in knn.radius_nearest(*(spark.createDataFrame(x, "id long, x double, y double") for x in (a, b)), ("x", "y"), 1.0, "id").collect()}
    want = {}
    for i, x, y in a:
        d, j = min((((x - p) ** 2 + (y - q) ** 2) ** 0.5, j) for j, p, q in b)
        if d < 1:
            want[i] = (j, round(d, 9))
    assert got == want


def test_searched_side_is_prepared_once(monkeypatch):
    """Steps over one side don't convert the other side anew."""
    made, make = [], knn._searched
    monkeypatch.setattr(knn, "_searched", lambda b, kind: made.append(kind) or make(b, kind))
    monkeypatch.setattr(knn, "PAIRS", 2000)
    v = np.random.default_rng(5).normal(size=(500, 8))
    a, b, d = knn._best(v, np.arange(500), v, np.arange(500), 1, 6, True)
    apart = np.sqrt(((v[:, None] - v) ** 2).sum(axis=2)) + np.where(np.eye(500), 9, 0)
    assert np.array_equal(a, np.arange(500)) and np.array_equal(b, apart.argmin(axis=1)) and made == [np.float32]


def test_nearest_of_ties_and_copies(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.integers(-1, 2, (150, 3)).astype(float), np.repeat(rng.normal(size=(3, 3)), 20, axis=0)])
    for at, kind in ((0.0, np.float64), (1e5, np.float64)):
        ids, rows = rng.permutation(len(v)), v.astype(kind) + at
        for k in (1, 4):
            got = knn._best(rows, ids, rows, ids, k, 6, True)
            want = []
            for t in range(len(rows)):
                d = np.round(np.sqrt(((rows - rows[t]) ** 2).sum(axis=1)), 6)
                want += [(ids[t], ids[j], d[j]) for j in [j for j in np.lexsort((ids, d)) if j != t][:k]]
            assert list(zip(*got, strict=True)) == want


def test_nearest_meets_a_side_with_itself_once(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(2500, 4))
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    twice = rows.select("id", "v")
    key = lambda df: sorted((r.a_id, r.rank, r.b_id, r.distance) for r in df.collect())
    got = key(knn.nearest_k(rows, rows, 3, "id", "v", other=True))
    assert got == key(knn.nearest_k(rows, twice, 3, "id", "v", other=True)) and len(got) == 7500
    there, back = knn._both_ways(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), 1, "id", "v")
    assert key(back) == key(knn.nearest_k(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"), 1, "id", "v")) and there.count() == 1250


def test_forest_by_rounds_and_by_its_last_edges(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60), float(rng.randrange(4))) for _ in range(150)]
    up = list(range(60))
    find = lambda v: v if up[v] == v else find(up[v])
    want = set()
    for a, b, s in sorted(set(edges), key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            up[find(a)] = find(b)
            want.add((a, b, s))
    df = spark.createDataFrame(edges, "src long, dst long, score double")
    for finish in (0, 20, 16384):
        assert {tuple(r) for r in graph.spanning_forest(df, "score", finish=finish).collect()} == want


def test_marks_of_one_shape_meet_as_one(spark):
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    square = F.array(corner(0.0, 0.0), corner(30.0, 0.0), corner(30.0, 30.0), corner(0.0, 30.0))
    rows = spark.range(60000).select(F.lit(0).alias("frame"), "id", F.col("id").alias("mark"), square.alias("corners"))
    alone = spark.range(1).select(F.lit(1).alias("frame"), "id", F.col("id").alias("mark"), square.alias("corners"))
    got = marks.mark_gate(rows.unionByName(alone), "frame", "id", "mark", "corners").groupBy("frame", "state").count().collect()
    assert {tuple(r) for r in got} == {(0, "overlapping", 60000), (1, "usable", 1)}


def test_shared_candidates_shuffle_no_pairs(spark):
    rng = random.Random(6)
    rows = sorted({(rng.randrange(4), rng.randrange(300)) for _ in range(700)})
    df = spark.createDataFrame(rows, "tag long, j long")
    earlier = {}
    for tag in range(4):
        own = [j for t, j in rows if t == tag]
        for n, j in enumerate(own):
            every = [4 * q for q in range(max(0, (n - 1) // 4 - 26), (n - 1) // 4 + 1)] if n else []
            earlier[tag, j] = {own[m] for m in {*range(min(5, n)), *every, *range(max(0, n - 8), n)}}
    lists = sequence.bank_lists(df, "tag", "j").collect()
    assert {(r.tag, r.j): set(r.earlier) for r in lists} == earlier and sum(len(r.earlier) for r in lists) == sum(map(len, earlier.values()))
    want = []
    for j in {j for _, j in rows}:
        n = {}
        for tag in range(4):
            for i in earlier.get((tag, j), ()):
                n[i] = n.get(i, 0) + 1
        want += [(j, i, s, r + 1) for r, (i, s) in enumerate(sorted(n.items(), key=lambda x: (-x[1], -x[0]))[:5])]
    for shift in (0, 2**40):  # lists of steps that fit 32 bits, and of others
        far = df.withColumn("j", F.col("j") * (1 + shift))
        got = marks.shared_candidates(far, "j", "tag")
        assert "Generate" not in plan(got)
        assert sorted((r.j // (1 + shift), r.i // (1 + shift), r.shared, r.rank) for r in got.collect()) == sorted(want)


def test_interleave_ranks_no_group_in_one_task(spark):
    rows = [(k % 50, k, "ab"[k % 3 == 0] if k % 7 else None) for k in range(200)]
    got = sampling.interleave(spark.createDataFrame(rows, "id long, k long, g string"), "g", ["k"], "id")
    assert "Window" not in plan(got) or "partition by [g" not in plan(got).lower() and "windowspecdefinition(g#" not in plan(got)
    n, want = {}, {}
    for i, _, g in sorted(rows, key=lambda r: r[1]):
        n[g] = n.get(g, 0) + 1
        want[i] = min(want.get(i, (10**9, "")), (n[g], g or ""))
    assert {r.id: (r.turn, r.g or "") for r in got.collect()} == want


def test_boxes_meet_planes_as_a_list(spark):
    cols = "id long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double"
    boxes = spark.createDataFrame([(1, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0), (2, 5.0, 6.0, 0.0, 1.0, 0.0, 1.0), (3, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0), (3, 5.0, 6.0, 0.0, 1.0, 0.0, 1.0), (4, *[None] * 6)], cols)
    planes = spark.createDataFrame([(1, -1.0, 0.0, 0.0, 2.0), (1, 1.0, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0, -3.0)], "view long, a double, b double, c double, d double")
    got = stencil.box_in_view(boxes, planes, "id")
    assert "explode" not in plan(got)
    assert {tuple(r) for r in got.collect()} == {(1, 1), (2, 2)}


def test_gravity_streams_and_needs_no_group(spark):
    """keys aren't gathered one by one, and a fold in pieces is the fold at once."""
    rows = spark.range(600).select((F.col("id") % 200).alias("k"), "id", (F.col("id") * 0.0001).alias("t"), F.lit(0.0).alias("ax"), F.lit(9.8).alias("ay"), F.lit(0.1).alias("az"))
    found = sequence.gravity_filter(rows, "k")
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    assert found.where("valid").count() == found.count() == 600
    rng = np.random.default_rng(7)
    t, v = np.cumsum(rng.choice([0.0, 0.01, 0.1, 0.3], 300, p=[0.03, 0.5, 0.44, 0.03])), rng.normal(0, 1, (300, 3))
    v *= 9.8 / np.linalg.norm(v, axis=1, keepdims=True)
    whole, fold = sequence.gravity_rows(t, v), sequence.Gravity()
    step = np.diff(t, prepend=np.nan)
    cut = ~((step > 0) & (step <= 0.25))
    parts = [fold.add(cut[k : k + 7], t[k : k + 7], v[k : k + 7]) for k in range(0, 300, 7)]
    assert np.concatenate([p[0] for p in parts]).tolist() == whole.valid.tolist() and 0 < whole.up_x.isna().sum() < 300
    assert np.allclose(np.concatenate([p[2] for p in parts]), whole[["up_x", "up_y", "up_z"]], equal_nan=True)


def test_nearest_in_time_never_looks_ahead_row_by_row(spark):
    """a frame to the last row is evaluated anew for every row; and of references at one time the first by its columns is taken."""
    made = lambda rows: spark.createDataFrame(rows, "id long, t double")
    found = asof.asof_nearest(made([(1, 5.0), (2, 9.0), (3, 30.0)]), made([(k, 4.0) for k in (9, 7, 8)] + [(k, 10.0) for k in (6, 4, 5)]), 3.0)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert {(r.id, r.ref_id) for r in found.collect()} == {(1, 7), (2, 4)}
    known = spark.createDataFrame([(1, 0.0, 2.0), (1, 1.0, None), (1, 2.0, None), (1, 3.0, 8.0), (1, 4.0, None)], "k long, t double, v double")
    filled = sequence.interpolate(known, ("k",), "v")
    assert "unboundedfollowing" not in filled._jdf.queryExecution().toString().lower()
    assert [r.filled for r in filled.orderBy("t").collect()] == [2.0, 4.0, 6.0, 8.0, 8.0]


def test_left_to_right_streams(spark):
    """a key that no row cuts isn't gathered; choices carry on over batches and start anew for each key."""
    rows = [(key, i, i * 0.5 + key * 0.1) for key in range(2) for i in range(90)]
    make = lambda by: spark.createDataFrame([(k, 1000 * k + i, t + by) for k, i, t in rows], "key int, id long, t double")
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = pairing.one_to_one(make(0.0), make(0.2), 1.0, "key")
        got = {(r.a_id, r.b_id) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert "FlatMapGroups" not in plan(found)
    assert got == {(1000 * k + i, 1000 * k + i) for k, i, _ in rows}


def test_redundant_views_stream(spark):
    """no group is gathered; views that span batches, null samples and groups of one task are kept apart."""
    rng = random.Random(5)
    rows = sorted({(g, v, s if s else None) for g in range(3) for v in range(14) for s in range(9) if rng.random() < 0.7}, key=str)
    rows = [(*r, rng.choice((1.0, 0.95, 0.5))) for r in rows]
    want = {}
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        best = {s: max(r[3] for r in own if r[2] == s) for s in {r[2] for r in own}}
        spare = {s: [sum(r[2] == s for r in own) - min(3, sum(r[2] == s for r in own)), sum(r[2] == s and r[3] >= 0.9 * best[s] for r in own) - 1] for s in best}
        for v in sorted({r[1] for r in own}, key=lambda v: (sum(r[1] == v for r in own), v)):
            mine = [(spare[r[2]], r[3] >= 0.9 * best[r[2]]) for r in own if r[1] == v]
            goes = all(a[0] > 0 and (not good or a[1] > 0) for a, good in mine)
            for a, good in mine if goes else ():
                a[0], a[1] = a[0] - 1, a[1] - good
            want[g, v] = not goes
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = select.redundant_views(spark.createDataFrame(rows, "g long, v long, s long, w double").coalesce(1), "g", "v", "s", "w")
        assert {(r.g, r.v): r.kept for r in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert "FlatMapGroups" not in plan(found) and set(want.values()) == {True, False}


def test_pieces_of_planes_stream(spark):
    """pieces aren't gathered one by one; a piece goes on over batches."""
    rows = [(scene, node, 0, 0.0, 0.0, 1.0, 1.0 + scene % 2 + 0.12 * (node % 3)) for scene in range(40) for node in range(9)]
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = merging.plane_groups(spark.createDataFrame(rows, "scene long, node long, plane long, nx double, ny double, nz double, d double"))
        got = {(r.scene, r.node): r.lead_node for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    assert "FlatMapGroups" not in plan(found)
    assert got == {(scene, node): 2 if node % 3 == 2 else 0 for scene in range(40) for node in range(9)}
