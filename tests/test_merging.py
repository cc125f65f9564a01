"""Merged maps, frontier searches and motions by consensus against plain Python, one by one."""

import random

import numpy as np
import pytest

from framewise.operators import consensus, merging


def turn(a, at):
    m = np.eye(4)
    m[:2, :2] = [[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]
    m[:3, 3] = at
    return m


def test_maps_join_the_largest(spark):
    rng = random.Random(3)
    maps = [(s, m, rng.choice([5, 9, 9, 20]), rng.random() < 0.85) for s in range(4) for m in range(9)]
    ev = []
    for s in range(4):
        for _ in range(40):
            a, b = rng.sample(range(9), 2)
            ev.append((s, a, b, rng.choice([50, 100]), rng.randint(0, 14), int(rng.random() < 0.05), rng.choice([0, 1, 2]), turn(rng.random(), [rng.random(), 1, 2]).ravel().tolist() if rng.random() < 0.9 else None))
    odd = [(0, 1, None, 10, 0, 0, 1, None), (0, 1, 77, 10, 0, 0, 1, None), (0, 2, 2, 10, 9, 1, 1, None), (None, 1, 2, 10, 9, 1, 1, None)]
    kinds = "scene long, src long, dst long, tested long, free long, conflicts long, supports long, pose array<double>"
    got = {(r.scene, r.map): r for r in merging.merge_maps(spark.createDataFrame([*maps, (0, None, 5, True), (9, 1, None, None)], "scene long, map long, size long, accepted boolean"), spark.createDataFrame(ev + odd, kinds)).collect()}
    states = set()
    for s in range(4):
        order = sorted((-n, m) for sc, m, n, ok in maps if sc == s and ok)
        joined = {}
        for k, (_, m) in enumerate(order):
            if k == 0:
                joined[m], want = np.eye(4), "target"
            else:
                own = [e for e in ev if e[0] == s and {e[1], e[2]} & {m} and ({e[1], e[2]} - {m}) <= set(joined)]
                bridges = [e for e in own if e[6] > 0 and e[7]]
                n, free = sum(e[3] for e in own), sum(e[4] for e in own)
                want = "unsupported" if not bridges else "joined" if free <= 0.12 * n and not any(e[5] for e in own) else "conflict"
                if want == "joined":
                    at = lambda e: np.array(e[7]).reshape(4, 4) if e[1] == m else np.linalg.inv(np.array(e[7]).reshape(4, 4))  # noqa: B023, E731
                    _, other, e = min((e[4] / e[3], e[2] if e[1] == m else e[1], e) for e in bridges)
                    rest = [at(x) for x in bridges if (x[4] / x[3], x[2] if x[1] == m else x[1]) == (e[4] / e[3], other)]
                    joined[m] = joined[other] @ min(rest, key=lambda p: p.ravel().tolist())
            r = got[s, m]
            assert r.state == want
            assert (r.world is None) == (m not in joined) and (m not in joined or np.allclose(np.array(r.world).reshape(4, 4), joined[m]))
            states.add(want)
    assert states == {"target", "joined", "unsupported", "conflict"} and got[9, 1].state == "rejected" and len(got) == 37
    assert merging.merge_maps(spark.createDataFrame([], "scene long, map long, size long, accepted boolean"), spark.createDataFrame(ev, kinds)).count() == 0


@pytest.mark.parametrize("budget", [7, 256])
def test_frontier_search(spark, budget):
    rng = random.Random(budget)
    rows = {(s, *sorted(rng.sample(range(8), 2))): (rng.randint(0, 9) / 2, rng.random() < 0.4) for s in range(5) for _ in range(22)}
    table = spark.createDataFrame([(*k, *v) for k, v in rows.items()] + [(0, 1, 1, 0.0, True), (None, 1, 2, 0.0, True), (0, 20, 21, None, True), (7, 1, 2, 0.5, True)], "scene long, src long, dst long, distance double, verified boolean")
    roots = spark.createDataFrame([(s, 0) for s in range(5)] + [(0, 3), (0, None)], "scene long, id long")
    got = {(r.scene, r.src, r.dst): (r.number, r.joins) for r in merging.frontier_search(table, roots, budget).collect()}
    assert len(got) == len(rows) + 4
    for s in range(5):
        known, todo, n = {0, 3} if s == 0 else {0}, sorted((v[0], k[1], k[2], v[1]) for k, v in rows.items() if k[0] == s), 0
        while todo and n < budget:
            pick = next((c for c in todo if (c[1] in known) != (c[2] in known)), None) or next((c for c in todo if c[1] in known and c[2] in known), None)
            if pick is None:
                break
            n += 1
            joins = pick[3] and not {pick[1], pick[2]} <= known
            assert got.pop((s, pick[1], pick[2])) == (n, joins)
            known |= {pick[1], pick[2]} if joins else set()
            todo.remove(pick)
    assert set(got.values()) == {(None, False)}
    assert merging.frontier_search(table.limit(0), roots).count() == 0


def test_planes_grouped_in_order(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(160):
        n = np.array([[0, 0, 1], [0, 1, 0], [0.6, 0.8, 0]][k % 3]) + rng.normal(0, 0.07, 3)
        n /= np.linalg.norm(n)
        d, flip = rng.choice([0.02, 0.4, 0.6, 1.5]) + rng.normal(0, 0.04), rng.choice([-1.0, 1.0])
        rows.append((int(rng.integers(2)), k // 4, k % 4, *(flip * n).tolist(), float(flip * d)))
    odd = [(0, None, 1, 0.0, 0.0, 1.0, 1.0), (0, 3, 9, None, 0.0, 1.0, 1.0)]
    table = spark.createDataFrame(rows + odd, "scene long, node long, plane long, nx double, ny double, nz double, d double")
    found = merging.plane_groups(table)
    got = {(r.scene, r.node, r.plane): (r.lead_node, r.lead_plane) for r in found.collect()}
    cosine, kept = np.cos(np.radians(12)), {}
    for s in range(2):
        groups = []
        for _, node, plane, *v in sorted(r for r in rows if r[0] == s):
            n, d = np.array(v[:3]) * (-1 if v[3] < 0 else 1), abs(v[3])
            if d < 0.05:
                continue
            fine = [g for g in groups if all(abs(d - e) < 0.15 and n @ m > cosine for _, m, e in g[1])]
            g = min(fine, key=lambda g: abs(d - np.mean([e for *_, e in g[1]])), default=None)  # noqa: B023
            if g is None:
                groups.append(g := ((node, plane), []))
            g[1].append((node, n, d))
            assert got.pop((s, node, plane)) == g[0]
        for lead, own in groups:
            nodes = {x for x, *_ in own}
            if len(nodes) >= 3 and max(nodes) - min(nodes) > 3:
                kept[s, *lead] = (len(nodes), np.mean([e for *_, e in own]))
        assert 5 < len(groups) < 60
    assert not got
    joint = {(r.scene, r.lead_node, r.lead_plane): (r.nodes, r.d) for r in merging.joint_planes(found).collect()}
    assert joint.keys() == kept.keys() and all(joint[k] == pytest.approx(kept[k]) for k in kept)
    assert merging.plane_groups(table.limit(0)).count() == 0


def test_motions_by_consensus(spark):
    rng = np.random.default_rng(4)
    f, c = 500.0, 320.0
    rows, truth = [], {}
    square = np.array([[-1, -1, 0], [1, -1, 0], [1, 1, 0], [-1, 1, 0]]) * 0.04
    see = lambda p: (f * p[0] / p[2] + c, f * p[1] / p[2] + c)
    for pair, moving in enumerate((0, 2, 5, 8)):  # of ten marks
        truth[pair] = turn(0.1 + 0.02 * pair, [0.1, -0.05, 0.02 * pair])
        for mark in range(10):
            at = np.array([rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5), rng.uniform(1, 2)])
            shift = rng.uniform(0.1, 0.3, 3) if mark < moving else 0
            for k, p in enumerate(at + square + rng.normal(0, 2e-4, (4, 3))):
                q = truth[pair][:3, :3] @ p + truth[pair][:3, 3] + shift
                rows.append((pair, mark, k, *map(float, (*p, *q, *see(p), *see(q)))))
    rows += [(9, 1, k, *map(float, (k, 0, 1, k, 0, 1, k, 0, k, 0))) for k in range(4)]  # along a line
    rows += [(0, 50, 0, *([0.0] * 10)), (0, 51, 0, None, *([0.0] * 9))]  # no whole marks
    table = spark.createDataFrame(rows, "pair long, mark long, corner int, px double, py double, pz double, qx double, qy double, qz double, pu double, pv double, qu double, qv double")
    got = {r.pair: r for r in consensus.mark_motion(table, (f, f, c, c)).collect()}
    assert set(got) == {0, 1}  # half and four fifths of moving marks leave no consensus
    for pair, r in got.items():
        assert (r.matched, r.inliers) == (10, 10 - (0, 2)[pair]) and r.pixels < 1
        assert np.allclose(np.array(r.pose).reshape(4, 4), truth[pair], atol=0.01)
    assert consensus.mark_motion(table.limit(0), (f, f, c, c)).count() == 0
