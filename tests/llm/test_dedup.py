import hashlib
import random

import pytest

from framewise.llm import near_dedup
from framewise.llm.exact_dedup import DigestIndex, digests, exact_dedup
from framewise.llm.line_dedup import line_dedup

DOCS = "doc_id long, text string, source string, digest int, keep_id int, n_lines int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup_against_brute_force(spark):
    texts = ["Ab c", "aB C", None, "", "É", "é", "x" * 50_000, "X" * 50_000, "Ab c"]
    rows = [(k, t, None, 1, 2, 3) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in exact_dedup(spark.createDataFrame(rows, DOCS), DigestIndex(spark, buckets=4)).collect()}
    for k, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if lower(u) == lower(t)]
        assert (got[k].keep_id, got[k].group_size, got[k].kept) == (max(same), len(same), k == max(same))
        assert got[k].text_sha256 == hashlib.sha256(lower(t).encode()).hexdigest()


def test_index_persists_and_appends(spark):
    index = DigestIndex(spark, buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "A"), (4, "c"), (5, None), (None, "N")], "doc_id long, text string")
    assert index.ingest(digests(first)).count() == 3
    assert sorted(r.keep_id for r in index.ingest(digests(second)).collect()) == [4, 5]
    index = DigestIndex(spark, index.base, index.path)  # opened again
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(second.limit(2), index).collect()}
    assert index.buckets == 4 and got == {(3, 3, 3, True), (4, 4, 2, True)}
    before = sorted(map(str, index.entries().collect()))
    index.compact(buckets=3)
    assert sorted(map(str, index.entries().collect())) == before and spark.table(index.name).count() == len(before) == 5
    assert index.ingest(digests(first)).count() == 0


def test_index_in_a_later_session(spark):
    rows = spark.createDataFrame([(k, f"text {k % 37}") for k in range(90)], "doc_id long, text string")
    more = spark.createDataFrame([(k, f"text {k % 45}") for k in range(100, 160)], "doc_id long, text string")
    index = DigestIndex(spark, buckets=16)
    assert index.ingest(digests(rows)).count() == 37
    for step in range(3):
        spark.sql(f"DROP TABLE {index.name}")  # the files stay, the catalogue forgets them
        index = DigestIndex(spark, path=index.path)
        assert index.buckets == (16 if step < 2 else 5)
        before = sorted(map(str, index.entries().collect()))
        assert index.ingest(digests(rows)).count() == (37 if step == 0 else 0)
        assert sorted(map(str, index.entries().collect())) == before
        fresh = index.ingest(digests(more), "later").count()
        assert fresh == (8 if step < 2 else 0)
        after = {r.keep_id: r.group_size for r in index.entries().collect()}
        assert len(after) == 45 and sum(after.values()) == 150 and max(after) == 159
        if step == 0:
            again = spark.table(index.name).where("batch = 'later'").limit(3)  # rows that a failed attempt left behind
            index._append(again)
            assert {r.keep_id: r.group_size for r in index.entries().collect()} == after
            index.ingest(digests(rows).union(digests(more)).limit(0))
        if step == 1:
            index.compact(buckets=5)
            assert {r.keep_id: r.group_size for r in index.entries().collect()} == after
    with pytest.raises(ValueError):
        DigestIndex(spark, path=index.path, buckets=4)


def test_batches_give_what_one_gives(spark, monkeypatch):
    from framewise.llm import common, exact_dedup as module
    from framewise.plans import shared

    rows = [(k, "abcDEF"[: k % 7]) for k in range(60)] + [(7, "x"), (7, "x"), (7, "y"), (None, "x"), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(str, exact_dedup(docs, DigestIndex(spark)).collect()))
    assert sorted(map(str, exact_dedup(docs, DigestIndex(spark), batches=3).collect())) == want
    monkeypatch.setattr(common, "HOT", 4)
    monkeypatch.setattr(module, "BUCKET_ROWS", 2)
    for m in (common, shared):
        monkeypatch.setattr(m, "BROADCAST_BYTES", -1)
    assert sorted(map(str, exact_dedup(docs, DigestIndex(spark), batches=2).collect())) == want


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup(spark.createDataFrame([], DOCS), DigestIndex(spark, buckets=2)).count() == 0


def sets(text):
    own = lower(text).split() if text else []
    if not own:
        return set()
    return {tuple(own)} if len(own) < 5 else {tuple(own[i : i + 5]) for i in range(len(own) - 4)}


def brute(texts, percent):
    s = [sets(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return s, label


def test_near_groups_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [None, "", "one two", "One  two", "   "]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 300))]
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 60))):
                own[rng.randrange(len(own))] = word()
            texts.append(" ".join(own))
    chain = [word() for _ in range(200)]
    for k in range(8):  # a chain: neighbours are near, ends are not
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    texts += [texts[-1].upper()] * 30
    rows = [(k, t, "s", 0, 0, 0) for k, t in enumerate(texts)]
    for percent in (80, 85):
        got = {r.doc_id: r for r in near_dedup.near_groups(spark.createDataFrame(rows, DOCS).repartition(3), percent).collect()}
        s, label = brute(texts, percent)
        assert [got[k].n_shingles for k in range(len(texts))] == [len(x) for x in s]
        assert [got[k].component_id for k in range(len(texts))] == label
        assert all(got[k].kept == (label[k] == k) for k in range(len(texts)))


def test_candidates_of_blocks(spark, monkeypatch):
    """Buckets with several components are compared whole, in blocks and tiles, each pair once over all bands."""
    monkeypatch.setattr(near_dedup, "BLOCK", 10)
    monkeypatch.setattr(near_dedup, "TILE", 4)
    other = [9] * (near_dedup.BANDS - 2)
    rows = [(7, 44, i, i % 2, [1, 2, 3, 4], [5, 7, *other]) for i in range(40)] + [(7, 44, 100 + i, 5, [-1, -2, -3, -4], [6, 7, *other]) for i in range(3)]
    rows += [(7, 44, 200, 8, [1, 2, 3, 4], [6, 7, *other])]
    rest = spark.createDataFrame(rows, "key long, n long, node long, component long, planes array<long>, bands array<int>")
    got = near_dedup.tile_members(rest, 0.9).collect()
    # The first forty share the band before, so only 200 is new to them here.
    assert {r.node for r in got} == {*range(40), 200} and {r.component for r in got if r.node == 200} == {8}
    assert max(sum(r.tile == t and (r.x, r.y) == c for r in got) for t in range(30) for c in {(r.x, r.y) for r in got}) <= 8


def test_links_between_sets_are_exact(monkeypatch):
    import numpy as np

    monkeypatch.setattr(near_dedup, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(30)]
    group = np.arange(30) % 9
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if group[i] != group[j] and 100 * len(set(sets[i]) & set(sets[j])) >= 40 * len(set(sets[i]) | set(sets[j]))}
    found = near_dedup.links_between(sets, group, 40)
    assert set(found) <= want

    def parts(links):
        root = {k: k for k in range(9)}
        for i, j in links:
            p, q = root[group[i]], root[group[j]]
            root = {k: min(p, q) if r in (p, q) else r for k, r in root.items()}
        return root

    assert want and parts(found) == parts(want) and len(found) <= 8
    assert near_dedup.links_between([], np.zeros(0), 80) == []


def test_hot_buckets_are_dealt_into_parts(spark, monkeypatch):
    """The merge joins that large tables take give the same groups as broadcasts."""
    from framewise.llm import common
    from framewise.plans import shared

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(5):
        base = [word() for _ in range(120)]
        for _ in range(9):
            own = list(base)
            own[rng.randrange(120)] = word()
            texts += [" ".join(own)] * rng.randint(1, 4)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(common, "HOT", 3)
    monkeypatch.setattr(near_dedup, "GROUP", 2)
    for module in (common, shared):
        monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(docs, 85).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, 85)[1]


def test_near_groups_of_repeated_ids_and_long_texts(spark):
    long = " ".join(f"w{k}" for k in range(40_000))
    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, one), (1, two), (2, one), (3, two), (4, long), (5, long + " tail"), (6, None), (2, one)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]
    assert {r.n_shingles for r in got if r.doc_id in (4, 5)} == {39_996, 39_997}


def test_large_group_without_a_common_hub(spark, monkeypatch):
    """Near copies of one text that isn't itself there: links are found although the smallest id isn't near to all."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(260)]
    texts = []
    for _ in range(70):
        own = list(base)
        for _ in range(rng.randint(1, 7)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    got = {r.doc_id: r.component_id for r in near_dedup.near_groups(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"), 85).collect()}
    assert [got[k] for k in range(70)] == brute(texts, 85)[1]


def test_near_groups_of_nothing(spark):
    assert near_dedup.near_groups(spark.createDataFrame([], DOCS)).count() == 0
    assert near_dedup.near_groups(spark.createDataFrame([(None, "a b c d e f", "s", 0, 0, 0)], DOCS)).collect()[0].component_id is None


def test_line_dedup(spark):
    rows = [(k, f"own {k}\n shared \n\nfew" if k < 4 else f"own {k}\nshared", f"s{k}", 0, 0, 9) for k in range(12)]
    rows += [(90, None, "s1", 0, 0, 9), (91, "", None, 0, 0, 9), (92, "shared", None, 0, 0, 9), (92, "shared", None, 0, 0, 9)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[0].text == "own 0\n\nfew" and (got[0].n_lines, got[0].n_removed) == (4, 1)
    assert got[11].text == "own 11" and got[90].text is None and got[91].text == "" and got[92].text == ""
    assert (got[90].n_lines, got[91].n_lines) == (0, 1)
    none = line_dedup(spark.createDataFrame(rows, DOCS), min_sites=13)
    assert {r.n_removed for r in none.collect()} == {0}
    assert line_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_line_dedup_of_hot_and_long_texts(spark, monkeypatch):
    """Merge joins, with a text of many rows in parts, give what broadcasts give."""
    from framewise.llm import common
    from framewise.plans import shared

    long = "\n".join(["shared"] + [f"line {k}" for k in range(20_000)])
    rows = [(k, "shared\nmine", f"s{k}") for k in range(12)] + [(50 + k, "shared\nhot", "s1") for k in range(40)] + [(99, long, "s2"), (None, "shared", "s3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, line_dedup(docs).collect()))
    monkeypatch.setattr(common, "HOT", 5)
    for module in (common, shared):
        monkeypatch.setattr(module, "BROADCAST_BYTES", -1)
    got = line_dedup(docs)
    assert sorted(map(str, got.collect())) == want
    assert {r.text for r in got.where("doc_id >= 50 and doc_id < 90").collect()} == {"hot"}
    assert got.where("doc_id = 99").first().n_lines == 20_001 and got.where("doc_id = 99").first().n_removed == 1


def test_line_ends_do_not_count(spark):
    from framewise.llm.line_dedup import SQL, line_dedup

    ends = ["", "\r", "\t", " \r", "\t \r"]
    rows = [(k, f"own {k}\n{' ' * (k % 2)}The footer{ends[k % 5]}\n\r", f"site {k}") for k in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup(docs).collect()}
    assert got == {k: f"own {k}\n\r" for k in range(16)}
    import duckdb

    documents = docs.toPandas()  # noqa: F841
    assert {r[0]: r[3] for r in duckdb.sql(SQL).fetchall()} == got
