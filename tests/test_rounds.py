"""Local planes, contradictions, windings and labels against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.operators import blocks, rounds, stencil

CAMERA = (30.0, 31.0, 9.5, 7.5)


def scene(seed=1, w=20, h=16):
    """A tilted plane in inverse depth with a jump, noise and holes."""
    rng = np.random.default_rng(seed)
    y, x = np.indices((h, w))
    z = 1 / (0.6 + 0.004 * x + 0.006 * y) + rng.normal(0, 0.002, (h, w))
    z[:, 14:] += 0.3
    z[rng.random((h, w)) < 0.01] = 0
    return z


def table(spark, z, kind="frame long, x int, y int, z double"):
    return spark.createDataFrame([(3, int(x), int(y), float(z[y, x])) for y in range(z.shape[0]) for x in range(z.shape[1])], kind)


def test_local_planes(spark):
    z = scene()
    h, w = z.shape
    near = lambda y, x, r: [(j, i) for j in range(y - r, y + r + 1) for i in range(x - r, x + r + 1)]
    inside = lambda j, i: 0 <= j < h and 0 <= i < w
    sides = lambda y, x: [(j, i) for j, i in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if inside(j, i)]
    edge = lambda y, x: any(z[p] > 0 and abs(z[p] - z[y, x]) > max(0.02, 0.02 * z[y, x]) for p in sides(y, x))
    got = {(r.x, r.y): r for r in stencil.depth_weights(table(spark, z), ("frame",), "x", "y", "z", CAMERA).collect()}
    assert len(got) == z.size
    fitted = 0
    for (x, y), r in got.items():
        assert r.edge == edge(y, x)
        cosine = None
        for s in (7, 3):
            cells = near(y, x, s // 2)
            if cosine is None and all(inside(*c) and z[c] > 0 and not edge(*c) for c in cells):
                plane = np.linalg.lstsq(np.array([[i - x, j - y, 1] for j, i in cells]), np.array([1 / z[c] for c in cells]), rcond=None)[0]
                rx, ry = (x - CAMERA[2]) / CAMERA[0], (y - CAMERA[3]) / CAMERA[1]
                a, b = plane[0] * CAMERA[0], plane[1] * CAMERA[1]
                normal = np.array([a, b, plane[2] - a * rx - b * ry])
                ray = np.array([rx, ry, 1])
                cosine = min(max(normal @ ray / np.linalg.norm(normal) / np.linalg.norm(ray), 0), 1)
        fitted += cosine is not None
        assert r.fitted == (cosine is not None) and r.cosine == pytest.approx(0.5 if cosine is None else cosine, abs=1e-9)
        assert (r.weight == 0) == (z[y, x] <= 0 or r.edge or (r.fitted and r.cosine < 0.25))
    assert 20 < fitted < z.size
    smooth = {(r.x, r.y): r.smooth for r in stencil.smooth_depth(table(spark, z), ("frame",), "x", "y", "z").collect()}
    moved = 0
    for (x, y), v in smooth.items():
        jump = lambda y, x: any(z[p] > 0 and z[y, x] > 0 and abs(z[p] - z[y, x]) > max(0.03, 0.02 * min(z[p], z[y, x])) for p in sides(y, x))
        want = z[y, x]
        for s in (9, 5, 3):
            cells = near(y, x, s // 2)
            if all(inside(*c) and z[c] > 0 and not jump(*c) for c in cells):
                mid = len(cells) / sum(1 / z[c] for c in cells)
                if abs(mid - z[y, x]) <= max(0.01, 0.01 * z[y, x]):
                    want, moved = mid, moved + 1
                    break
        assert v == pytest.approx(want, abs=1e-9)
    assert moved > 20
    assert stencil.depth_weights(table(spark, z).limit(0), ("frame",), "x", "y", "z", CAMERA).count() == 0


def test_contradictions_go_worst_first(spark):
    rng = random.Random(3)
    true = {k: (rng.uniform(0, 9), rng.uniform(0, 9)) for k in range(25)}
    rows = []
    for e in range(140):
        a, b = rng.sample(range(25), 2)
        off = 3.0 if e % 13 == 0 else 0.0
        rows.append((e, a, b, 1.0, true[a][0] - true[b][0] + rng.uniform(-0.02, 0.02) + off, true[a][1] - true[b][1] + rng.uniform(-0.02, 0.02)))
    rows += [(900, 1, None, 1.0, 0.0, 0.0), (901, 1, 77, 1.0, 0.0, 0.0), (902, 1, 2, None, 0.0, 0.0)]
    edges = spark.createDataFrame(rows, "edge long, src long, dst long, weight double, x double, y double")
    at = spark.createDataFrame([(k, *p) for k, p in true.items()], "id long, x double, y double")
    got = {r.edge: r.gone for r in rounds.without_contradictions(edges, at, ("x", "y"), 0.8).collect()}
    assert {e for e, g in got.items() if g == 0} == {900, 901, 902} and len(got) == len(rows)
    assert {e for e, g in got.items() if g} == {e for e in range(140) if e % 13 == 0} and max(g for g in got.values() if g) > 1
    # By hand, one vertex and one edge after the other.
    place, live, gone = dict(true), rows[:140], {}
    for k in range(1, 50):
        for _ in range(2):
            said = {v: [] for v in place}
            for _, a, b, w, x, y in live:
                said[a].append((w, place[b][0] + x, place[b][1] + y))
                said[b].append((w, place[a][0] - x, place[a][1] - y))
            place = {v: tuple((place[v][c] + sum(s[0] * s[c + 1] for s in said[v])) / (1 + sum(s[0] for s in said[v])) for c in (0, 1)) for v in place}
        miss = {r[0]: round(math.hypot(place[r[1]][0] - place[r[2]][0] - r[4], place[r[1]][1] - place[r[2]][1] - r[5]), 6) for r in live}
        bad = [r for r in live if miss[r[0]] > 0.8]
        worst = {v: max((miss[r[0]], r[0]) for r in bad if v in r[1:3]) for r in bad for v in r[1:3]}
        out = {r[0] for r in bad if worst[r[1]][1] == worst[r[2]][1] == r[0]}
        if not out:
            break
        gone |= dict.fromkeys(out, k)
        live = [r for r in live if r[0] not in out]
    assert {e: g for e, g in got.items() if g} == gone


def test_contradictions_over_blocks(spark, monkeypatch):
    """Blocks of a few edges, names as vertices, and idents that stand in several blocks or more than once."""
    monkeypatch.setattr(blocks, "MOST", 25)
    rng = random.Random(8)
    true = {f"v{k}": (rng.uniform(0, 9), rng.uniform(0, 9)) for k in range(30)}
    rows = []
    for e in range(160):
        a, b = rng.sample(sorted(true), 2)
        off = 2.0 + e / 100 if e % 11 == 0 else 0.0
        rows.append((e, a, b, rng.uniform(1, 2), true[a][0] - true[b][0] + rng.uniform(-0.02, 0.02) + off, true[a][1] - true[b][1]))
    rows += [(e, a, b, 0.5, true[a][0] - true[b][0], true[a][1] - true[b][1]) for e, a, b in ((11, "v1", "v2"), (33, "v29", "v0"), (33, "v3", "v28"), (150, "v7", "v8"))]
    unusable = [(900, "v1", None, 1.0, 0.0, 0.0), (900, "v1", None, 1.0, 0.0, 0.0), (901, "v1", "none", 1.0, 0.0, 0.0), (902, "none", "none", 1.0, 0.0, 0.0), (4, "v1", "none", 1.0, 0.0, 0.0)]
    edges = spark.createDataFrame(rows + unusable, "edge long, src string, dst string, weight double, x double, y double")
    at = spark.createDataFrame([(k, *p) for k, p in true.items()], "id string, x double, y double")
    for sweeps in (0, 3):
        found = rounds.without_contradictions(edges, at, ("x", "y"), 0.8, sweeps=sweeps, own=0.5).collect()
        assert sorted(r.edge for r in found) == sorted(r[0] for r in rows + unusable)
        got = {r.edge: r.gone for r in found}
        assert [got[e] for e in (900, 901, 902)] == [0, 0, 0] and got[4] is None
        place, live, gone = dict(true), list(rows), {}
        for k in range(1, 100):
            for _ in range(sweeps):
                said = {v: [] for v in place}
                for _, a, b, w, x, y in live:
                    said[a].append((w, place[b][0] + x, place[b][1] + y))
                    said[b].append((w, place[a][0] - x, place[a][1] - y))
                place = {v: tuple((0.5 * place[v][c] + sum(s[0] * s[c + 1] for s in said[v])) / (0.5 + sum(s[0] for s in said[v])) for c in (0, 1)) for v in place}
            miss = [(round(math.hypot(place[r[1]][0] - place[r[2]][0] - r[4], place[r[1]][1] - place[r[2]][1] - r[5]), 6), r[0]) for r in live]
            bad = [(m, r) for m, r in zip(miss, live, strict=True) if m[0] > 0.8]
            worst = {v: max(m for m, r in bad if v in r[1:3]) for _, q in bad for v in q[1:3]}
            out = {r[0] for m, r in bad if worst[r[1]] == worst[r[2]] == m}
            if not out:
                break
            gone |= dict.fromkeys(out, k)
            live = [r for r in live if r[0] not in out]
        assert {e: g for e, g in got.items() if g} == gone and len(gone) > 9


def test_contradictions_shuffle_no_edges(spark, monkeypatch):
    """A round joins no edges with places: its sweeps run over files of blocks, and only messages are dealt."""
    plans, write = [], rounds.materialise
    monkeypatch.setattr(rounds, "materialise", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    edges = spark.range(40).select(F.col("id").alias("edge"), (F.col("id") % 5).alias("src"), (F.col("id") % 8 + 5).alias("dst"), F.lit(1.0).alias("weight"), F.when(F.col("id") == 7, 9.0).otherwise(0.0).alias("x"))
    got = rounds.without_contradictions(edges, spark.range(13).select("id", F.lit(0.0).alias("x")), ("x",), 2.0).where("gone is not null").collect()
    assert [tuple(r) for r in got if r.gone] and {r.edge for r in got} == {7}
    swept = [p for name, p in plans if name == "contradictions"]
    assert swept and not any("Join" in p or "FileScan" in p for p in swept[:1])
    assert not any(name in ("positions", "edges") for name, _ in plans)


def test_windings(spark):
    solid = [(0, 0, 1, 2), (1, 0, 1, 3), (2, 1, 2, 3), (3, 0, 3, 2)]  # a tetrahedron with some faces turned round
    band = [(10 + i, 100 + i, 100 + (i + 1) % 7, 100 + (i + 2) % 7) for i in range(7)]  # a one-sided band of seven
    alone = [(30, 500, 501, 502)]
    faces = spark.createDataFrame(solid + band + alone, "face long, a long, b long, c long")
    found, cuts = rounds.windings(faces)
    turned = {r.face: r.flipped for r in found.collect()}
    cut = {(r.src, r.dst) for r in cuts.collect()}
    assert set(turned) == {f[0] for f in solid + band + alone} and not turned[0] and not turned[30]
    sides = {}
    for f, a, b, c in solid + band:
        for u, v in ((a, b), (b, c), (c, a)):
            u, v = (v, u) if turned[f] else (u, v)
            sides.setdefault(frozenset((u, v)), []).append((f, (u, v)))
    against = {tuple(sorted(f for f, _ in s)) for s in sides.values() if len(s) == 2 and s[0][1] == s[1][1]}
    assert against == cut and not any(a < 10 for a, _ in cut)
    assert rounds.windings(faces.where("face < 4"))[1].count() == 0


def test_labels_of_least_energy(spark):
    rng = random.Random(6)
    views, faces = range(3), range(9)
    scores = {(f, v): round(rng.uniform(0.1, 1), 3) for f, v in itertools.product(faces, views) if rng.random() < 0.85 and f != 4}
    edges = [(0, 1), (1, 2), (3, 4), (4, 5), (6, 7), (7, 8), (0, 3), (3, 6), (1, 5), (2, 8), (5, 2)]
    s = spark.createDataFrame([(f, v, x) for (f, v), x in scores.items()] + [(1, None, 1.0), (2, 0, -1.0)], "id long, view long, score double")
    e = spark.createDataFrame(edges + [(1, 0), (5, 5)], "a long, b long")
    labels, energies = rounds.potts_labels(s, e)
    got = {r.id: r.label for r in labels.collect()}
    seen = sorted({f for f, _ in scores})
    assert set(got) == set(seen)
    best = {f: max(x for (g, _), x in scores.items() if g == f) for f in seen}
    joined = [(a, b) for a, b in edges if a in best and b in best]
    energy = lambda of: sum(-math.log(scores[f, of[f]] / best[f]) for f in seen) + 0.35 * sum(of[a] != of[b] for a, b in joined)
    assert all(a >= b - 1e-9 for a, b in itertools.pairwise(energies)) and energies[-1] == pytest.approx(energy(got))
    for f in seen:  # no single face gains by another label
        assert all(energy({**got, f: v}) >= energy(got) - 1e-6 for v in views if (f, v) in scores)
    least = min(energy(dict(zip(seen, c, strict=True))) for c in itertools.product(views, repeat=len(seen)) if all((f, v) in scores for f, v in zip(seen, c, strict=True)))
    assert energies[-1] <= least + 0.7
    vertices = spark.createDataFrame([(k,) for k in faces], "id long")
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a long, b long")
    colour = {r.id: r.colour for r in rounds.coloured(vertices, both).collect()}
    assert all(colour[a] != colour[b] for a, b in edges) and set(colour) == set(faces) and max(colour.values()) <= 3
