"""Winnowing, spelling variants and centroid clusters against plain Python and SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from framewise.llm import clusters, common, decontamination, spelling


def duck(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df)
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    return [dict(zip(names, row, strict=True)) for row in r.fetchall()]


def low(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def hit_words(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    found = defaultdict(set)
    for ident, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            found[tuple(w[i : i + n])].add(ident)
    out = []
    for ident, text in docs:
        w, hit, seen = words(text), set(), set()
        for n in {len(k) for k in found}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in found:
                    hit.update(range(i, i + n))
                    seen |= found[tuple(w[i : i + n])]
        names = ",".join(sorted(str(x) for x in seen if x is not None))
        out.append((ident, len(w), len(hit), len(seen - {None}), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def passages():
    rng = random.Random(5)
    vocabulary = ["a", "b", "Ç", "straße", "X9", "λόγος", "the", "of"] + [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([1, 2, 5, 9, 10, 12, 25, 60])]
    items += [(100, items[6][1] + " tail"), (100, items[6][1]), (101, None), (102, " .,;"), (None, text(15)), (103, "ha " * 30), (104, items[7][1].upper().replace("Λ", "λ"))]
    docs = [(k, " - ".join([text(rng.randint(0, 12)), items[k % len(items)][1] or "", text(rng.randint(0, 12))])) for k in range(60)]
    docs += [(60, None), (61, ""), (62, "!?"), (63, "ha " * 500), (64, text(5_000) + " " + items[7][1]), (None, items[7][1]), (None, items[7][1]), (7, docs[7][1]), (65, " ".join((items[6][1] or "").split()[3:14]))]
    return docs, items


@pytest.mark.parametrize("limit", [None, 0])
def test_windows_against_all_positions(spark, monkeypatch, limit):
    if limit is not None:  # no side is broadcast, and hot keys are dealt into parts
        for module in (common, decontamination):
            monkeypatch.setattr(module, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(common, "HOT", 5)
    docs, items = passages()
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, win long")
    got = decontamination.decontaminate(d, b)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=repr) == hit_words(docs, items)
    if limit is None:
        assert sorted(rows, key=repr) == sorted((tuple(r[c] for c in got.columns) for r in duck(decontamination.SQL, documents=d.toPandas().astype({"doc_id": "Int64"}), benchmark=b.toPandas().astype({"item_id": "Int64"}))), key=repr)


def test_windows_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, None), (2, "..")], "item_id long, text string")
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in decontamination.decontaminate(docs, items).collect()] == [(1, 3, 0, 0, none, False)]
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.decontaminate(docs.limit(0), some).count() == 0
    assert [r.n_hit for r in decontamination.decontaminate(docs, some).collect()] == [3]


def test_windows_of_another_length(spark):
    docs, items = passages()
    items = [i for i in items if not i[1] or len(i[1].split()) > 9]
    d, b = spark.createDataFrame(docs[:30], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for window in (1, 13):
        assert sorted((tuple(r) for r in decontamination.decontaminate(d, b, window).collect()), key=repr) == hit_words(docs[:30], items, window)


def near_by_hand(docs):
    n = Counter()
    for ident, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if ident is None else ident}:{w}".encode())
            w = w if h % 31 else w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 7
    n = {w: c for w, c in n.items() if c >= 2}
    cuts = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    one = lambda a, b: a in cuts(b) or b in cuts(a) or len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1
    form, near = {}, {}
    for w in n:
        others = [v for v in n if one(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        near[w], form[w] = len(others), best if best and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out)


def spelled():
    rng = random.Random(8)
    heads = ["information", "straßenbahn", "aaaaaaaa", "abababab", "thantionsh", "Élysées", "encyclopaedia", "x" * 200, "short"]
    docs = []
    for k in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(heads[:-2] if rng.random() < 0.9 else heads)
            if rng.random() < 0.3:
                i, kind = rng.randrange(len(w)), rng.random()
                w = w[:i] + ("" if kind < 0.4 else rng.choice("abéx")) + w[i + (kind < 0.7) :]
            words.append(w)
        docs.append((k, rng.choice([" ", "\n", "-"]).join(words)))
    docs += [(None, "information " * 40), (500, None), (501, ""), (3, docs[3][1]), (502, "abababab abababab ababababa ababababa babababa babababa")]
    # A chain of forms: each ten times as frequent as the one before.
    docs += [(600 + k, w) for w, n in (("chainabcde", 2), ("chainabcdf", 20), ("chainabcef", 200), ("chainabcxf", 2000)) for k in range(n)]
    return docs


@pytest.mark.parametrize("cell", [4096, 1])
def test_spelling_against_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL", cell)
    docs = spelled() if cell > 1 else [(k, t and t.replace("x" * 99, "x")) for k, t in spelled()[:70]]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n int")
    got = spelling.spelling_variants(df)
    rows = sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = near_by_hand(docs)
    assert rows == want
    if cell > 1:
        assert any(r[2] != (r[1] or r[0]) for r in rows)
        assert rows == sorted(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in duck(spelling.SQL, documents=df.toPandas().astype({"doc_id": "Int64"})))


def test_spelling_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert spelling.spelling_variants(docs).count() == 0
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_three_rarest_bigrams_always_meet():
    rng = random.Random(2)
    for _ in range(4000):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(7, 12)))
        i, kind = rng.randrange(len(w)), rng.random()
        v = w[:i] + ("" if kind < 0.4 else rng.choice("abcd")) + w[i + (kind < 0.7) :]
        if v == w or len(v) < 7:
            continue
        grams = sorted({a + b for a in "abcd" for b in "abcd"}, key=lambda g: hashlib.md5(g.encode()).digest())
        keys = spelling._cells({g: k for k, g in enumerate(grams)})
        a, b = {k[:2] for k in keys(w, 1)}, {k[:2] for k in keys(v, 1)}
        other = {spelling.SAME: spelling.SAME, spelling.SHORT: spelling.LONG, spelling.LONG: spelling.SHORT}
        assert any((c, other[s]) in b for c, s in a)


def lloyd(rows, k=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mid = [v for _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((dist(v, c), j) for j, c in enumerate(mid))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for j in range(len(mid)):
            own = [v for (_, v), o in zip(kept, of, strict=True) if o == j]
            if own:
                mid[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [(i, *reversed(near(v))) for i, v in kept]
    per = Counter()
    for _, c, d in last:
        per[c] += d
    return sorted(((i, c, d, per[c], sum(per.values()), hashlib.sha256(",".join(map(str, mid[c])).encode()).hexdigest()) for i, c, d in last), key=repr)


def test_yinyang_against_all_distances(spark):
    rng = np.random.default_rng(4)
    spots = rng.normal(0, 1, (9, 64))
    vectors = [(spots[k % 9] + rng.normal(0, 0.3, 64)).tolist() for k in range(700)]
    vectors += [[0.0] * 64] * 40 + [[(k % 2) / 64] * 64 for k in range(40)] + [[1.0] * 63, [1.0] * 65, None, [], [math.nan] + [0.0] * 63, [math.inf] + [0.0] * 63, [None] + [0.0] * 63]
    rows = [(k, v) for k, v in enumerate(vectors)] + [(5, vectors[5]), (None, vectors[6]), (3, vectors[9])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    got = clusters.yinyang(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == lloyd(rows)


def test_yinyang_filters_skip_and_agree():
    rng = np.random.default_rng(7)
    spots = rng.integers(-3000, 3000, (16, 64))
    v = (spots[rng.integers(0, 16, 5000)] + rng.integers(-200, 200, (5000, 64))).astype(np.int64)
    before = spots + rng.integers(-30, 30, spots.shape)
    group = clusters.grouped(before, 4)
    state = clusters.Assigner(before, group).first(v)
    scanned = []
    for _ in range(3):
        after = np.stack([v[state[0] == k].sum(0) // max(1, (state[0] == k).sum()) for k in range(16)])
        work = clusters.Assigner(after, group, before)
        real, clusters.squared = clusters.squared, lambda a, b, f=clusters.squared: scanned.append(len(a)) or f(a, b)
        try:
            state = work.again(v, *state)
        finally:
            clusters.squared = real
        assert (state[0] == real(v, after).argmin(1)).all()
        before = after
    assert sum(scanned) < 1000


def test_yinyang_edges(spark):
    none = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id long, embedding array<float>")
    assert clusters.yinyang(none).count() == 0 and clusters.yinyang(none.limit(0)).count() == 0
    far = [(1, [1e30] + [0.0] * 63), (2, [0.5] * 64), (3, [300000.0] * 64)]
    got = {r.vec_id: r for r in clusters.yinyang(spark.createDataFrame(far, "vec_id long, embedding array<float>")).collect()}
    assert got[1].cluster is None and got[1].inertia == 0 and {got[2].cluster, got[3].cluster} == {0, 1}
    alone = spark.createDataFrame([(None, [0.5] * 64)], "vec_id long, embedding array<float>")
    assert [r.cluster for r in clusters.yinyang(alone).collect()] == [None]
