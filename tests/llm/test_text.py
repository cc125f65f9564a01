import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from framewise.llm import language_model, packing, secrets, url_filter
from framewise.llm.elias_fano import Levels, Monotone, pack


def duck(sql, **tables):
    c = duckdb.connect()
    for name, df in tables.items():
        c.register(name, df)
    r = c.execute(sql)
    names = [x[0] for x in r.description]
    return [dict(zip(names, row, strict=True)) for row in r.fetchall()]


def test_secrets_against_regular_expressions(spark):
    rng = random.Random(3)
    parts = ["password=abcdef12", "secret:token:abcdefgh", "API_KEY = 'Zz/+9.=-'", "AKIA" + "A1" * 8, "AKIA" + "B2" * 9, "0f" * 12, "0f" * 11, "token=abc", "Passwd: \"longenough\"", "é", "😀", "https://s3.example.com/x", "aB3" * 13 + "Q", "word", "\n", "x" * 300]
    texts = [None, "", "😀 password=abcdef12"] + [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(60)] + ["word " * 40_000 + "password=abcdef12", "http://a.bc/d token=abcdef AKIA" * 3000]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in secrets.secret_scan(df).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, t in enumerate(texts):
        t = t or ""
        base = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        names = ("assign", "access", "hex")
        said = ",".join(f"{names[b]}:{a}:{c}" for a, b, c in sorted(base))
        import hashlib

        assert got[k].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(got[k].spans.split(","))
    want = {r["doc_id"]: r for r in duck(secrets.SQL, documents=df.toPandas())}
    assert all(got[k].asDict() == want[k] for k in got)
    assert any(r.n_linked for r in got.values())
    assert secrets.secret_scan(df.limit(0)).count() == 0


def test_weak_parts_alone_are_not_reported(spark):
    weak, access, end = "aB3" * 13 + "Q", "AKIA" + "A1" * 8, "https://s3.example.com"
    rows = [(0, weak), (1, f"{access} {weak}"), (2, access + " " * 400 + weak), (3, f"{access} {end}"), (4, f"{access} {end} {weak}")]
    got = {r.doc_id: r.n_linked for r in secrets.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 2}


def test_parts_across_the_edges_of_an_interval(spark):
    weak, access = "aB3" * 13 + "Q", "AKIA" + "A1" * 8
    rows = []
    for at in (960, 1000, 1199):
        for size in (30, 239, 240, 241, 700):
            url = "https://" + "x" * (size - 8)
            for end in (at - 242, at - 241, at - 240, at - 239, at - 200):
                if end >= size:
                    rows.append(" " * (end - size) + url + " " * (at - end) + access + " " + weak)
            for start in (at + 20 + 239, at + 20 + 240, at + 20 + 241):
                rows.append(" " * at + access + " " + weak + " " * (start - at - 61) + url)
        for end in (at - 242, at - 240, at - 239, at - 230, at - 205):
            rows.append(" " * (end - 40) + weak + " " * (at - end) + access + " https://s3.example.com")
            rows.append(" " * (end - 40) + "token=" + "z" * 34 + " " * (at - end) + access + " https://s3.example.com")
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.asDict() for r in secrets.secret_scan(df).collect()}
    assert got == {r["doc_id"]: r for r in duck(secrets.SQL, documents=df.toPandas())}
    assert {r["n_linked"] for r in got.values()} == {0, 1, 2}


def test_url_verdicts_follow_the_list_of_the_day(spark):
    entries = [("bad.org", "block", "2024-01-10"), ("bad.org", "remove", "2024-02-20"), ("ok.bad.org", "allow", "2024-01-15"), ("x.com/a", "block", "2023-01-01"), ("x.com", "allow", "2023-01-01"), (None, "block", "2024-01-01")]
    e = spark.createDataFrame(entries, "pattern string, action string, listed_on string").selectExpr("pattern", "action", "cast(listed_on as date) as listed_on")
    cases = [
        ("http://bad.org/", "2024-01-09", "none"), ("http://www.BAD.org:80/p", "2024-01-10", "block"), ("https://ok.bad.org", "2024-01-12", "block"), ("https://ok.bad.org", "2024-01-15", "allow"),
        ("http://bad.org/", "2024-02-19", "block"), ("http://bad.org/", "2024-02-20", "none"), ("http://x.com/a/b?c", "2024-05-01", "block"), ("http://x.com/ab", "2024-05-01", "allow"), (None, "2024-01-10", "none"), ("junk", "2024-01-10", "none"), ("http://bad.org/", None, "none"),
    ]
    c = spark.createDataFrame([(k, u, d, "old") for k, (u, d, _) in enumerate(cases)], "page_id long, url string, d string, verdict string").selectExpr("page_id", "url", "cast(d as date) as fetched_on", "verdict")
    got = {r.page_id: r.verdict for r in url_filter.url_verdicts(c, e).collect()}
    assert got == {k: v for k, (_, _, v) in enumerate(cases)}
    assert {r.verdict for r in url_filter.url_verdicts(c, e.limit(0)).collect()} == {"none"}
    assert url_filter.url_verdicts(c.limit(0), e).count() == 0


def test_deep_entries_of_a_list_decide(spark):
    e = spark.createDataFrame([("h.org/a", "allow"), ("h.org/a/b/c", "block"), ("h.org/a/b/c/d/e.html", "allow")], "pattern string, action string").selectExpr("*", "date'2024-01-01' as listed_on")
    want = {"http://h.org/a/b": "allow", "http://h.org/a/b/c": "block", "http://h.org/a/b/c/d?x": "block", "http://h.org/a/b/c/d/e.html": "allow", "http://h.org/a/b/cc": "allow", "http://h.org/": "none"}
    c = spark.createDataFrame([(u,) for u in want], "url string").selectExpr("*", "date'2024-05-01' as fetched_on")
    assert {r.url: r.verdict for r in url_filter.url_verdicts(c, e).collect()} == want


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_files()[0])
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = ["", " ", "a", "Hello world", "a  b", " a b ", "x\n y", "don't we'll\n\n\tend ", "日本語 テスト ａ", "😀 😀", "über façade  naïve", "!!! $$$%%% ###", "1234567 89", "tail\n", "a b", "Ⅷ ² x²", "word " * 3000, "é" * 4000, "<|endoftext|> x", "a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|>", "日本<|endoftext|> <|endoftext|>é  ", "<|endoftext| x |>"]


def test_encoder_equals_the_library(plain):
    encode = packing.Encoder(*packing.vocabulary_files())
    rng = random.Random(1)
    mixed = ["".join(rng.choice("ab é,.!?'\n\t 12 ") for _ in range(200)) for _ in range(60)]
    for t in TEXTS + mixed:
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == plain(t), t[:40]


def test_packing_round_trip(spark, plain):
    rows = [(k, t, 5) for k, t in enumerate([*TEXTS, None, "a", "b c " * 40])]
    got = packing.best_fit_packing(spark.createDataFrame(rows, "doc_id long, text string, piece int"), packing.vocabulary_files(), 256).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for k, t, _ in rows:
        ids = np.array([*plain(t or ""), 0], "<u4")
        own = sorted(by_doc[k], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == 1 or all(r.length == 256 for r in own[1:])
        for r in own:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(by_seq) <= -(-total // 256) + 4
    assert packing.best_fit_packing(spark.createDataFrame([], "doc_id long, text string"), packing.vocabulary_files()).count() == 0


def test_words_of_many_texts_are_encoded_at_once(monkeypatch):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_files()[0])
    encode = packing.Encoder(*packing.vocabulary_files())
    rng = random.Random(8)
    parts = ["word", "don't", "x1", "Żółć", "日本", "a\nb", "", "\t", "end\n", "12345", "..!?", "\u00a0", "<|endoftext|>"]
    texts = [None, "", " ", "  ", "a ", " a"] + [" ".join(rng.choices(parts, [9, 5, 5, 5, 1, 1, 1, 1, 1, 5, 5, 1, 1], k=rng.randint(1, 9))) for _ in range(300)]
    own = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([x if x is None else x.encode() for x in texts], pa.binary())], ["id", "text"])
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert all([np.frombuffer(ids, "<u4").tolist() for part in packing._slices(own, size) for ids in encode.many(part.column(1))] == want for size in (50, 1 << 20))
    asked = []
    monkeypatch.setattr(encode, "whole", lambda text: asked.append(text) or b"")
    list(encode.many(pa.array([f"first new{k} words{k}".encode() for k in range(50)], pa.binary())))
    assert asked == ["first"] * 50  # no call a word


def test_packing_is_near_the_least_number_of_bins():
    """On small inputs against the least number of bins, by trying all ways."""
    rng = np.random.default_rng(8)

    def least(sizes, capacity):
        best = len(sizes)

        def put(k, free):
            nonlocal best
            if len(free) >= best:
                return
            if k == len(sizes):
                best = len(free)
                return
            for f in sorted({f for f in free if f >= sizes[k]}):
                put(k + 1, [*free[: free.index(f)], f - sizes[k], *free[free.index(f) + 1 :]])
            put(k + 1, [*free, capacity - sizes[k]])

        put(0, [])
        return best

    gap = []
    for _ in range(60):
        sizes = np.sort(rng.integers(15, 70, 9))[::-1].copy()
        where, _ = packing.pack(sizes, 100)
        gap.append(int(where.max()) + 1 - least(sizes.tolist(), 100))
    assert min(gap) >= 0 and max(gap) <= 1 and np.mean(gap) < 0.1


def test_packing_quality_and_local_search():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 2048, 4000)
    where, offset = packing.pack(sizes, 2048)
    fill = np.bincount(where, sizes)
    assert fill.max() <= 2048 and len(fill) <= 1.02 * sizes.sum() / 2048 + 1
    bins = [[0], [1], [2], [3]]
    own = np.array([6, 5, 5, 4])
    assert len(packing.local_search(bins, own, 10)) == 2
    assert packing._exchange([0], [1], np.array([7, 5]), 5) == ((0,), (1,))


def test_local_search_ends_where_no_pair_of_bins_gains():
    from itertools import combinations

    rng = np.random.default_rng(5)
    for sizes, capacity in ((rng.integers(400, 1400, 1200), 2048), (rng.integers(1, 60, 400), 100), (np.full(300, 3), 1000)):
        loose = [list(map(int, x)) for x in np.array_split(np.arange(len(sizes)), 100)] if capacity == 1000 else packing.best_fit(sizes, capacity)
        bins = packing.local_search(loose, sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        fill = [int(sizes[b].sum()) for b in bins]
        assert max(fill) <= capacity
        sums = [[{int(sizes[list(c)].sum()) for c in combinations(b, n)} for n in (1, 2)] for b in bins]
        for g, t in ((g, t) for g in range(len(bins)) for t in range(len(bins)) if g != t and fill[g] <= fill[t] < capacity):
            (a, aa), (b, bb) = sums[g], sums[t]
            gains = {x - y for x in a for y in {0} | b | bb} | {x - y for x in aa for y in b}
            assert not any(0 < x <= capacity - fill[t] for x in gains)
    assert len(bins) == 1


def test_exchange_looks_at_all_pieces_of_a_bin():
    sizes = np.array([9] * 70 + [5] + [2] * 70 + [3])
    assert packing._exchange(list(range(71)), list(range(71, 142)), sizes, 2) == ((70,), (141,))


def test_monotone_sequences():
    rng = np.random.default_rng(0)
    for values in (np.zeros(0, np.uint64), np.array([0], np.uint64), np.sort(rng.integers(0, 2**64 - 1, 500, np.uint64)), np.repeat(np.arange(5, dtype=np.uint64), 7), np.cumsum(rng.integers(0, 9, 3000)).astype(np.uint64)):
        level = Levels.from_bytes(pack(s=Monotone.build(values), a=np.arange(3)))
        assert level.s.get(np.arange(len(values))).tolist() == values.tolist()
        x = np.concatenate([values, values + np.uint64(1), np.array([0, 2**63], np.uint64)])
        at, equal = level.s.successor(x)
        assert at.tolist() == np.searchsorted(values, x).tolist()
        assert equal.tolist() == [v in set(values.tolist()) for v in x.tolist()]


def brute_model(train, text):
    from collections import Counter

    seq = lambda t: [*lower(t).split(), None]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    one, two = Counter(), Counter()
    above = Counter()
    for t in train:
        s = seq(t)
        one.update(s)
        for a, b in zip(["<b>", *s[:-1]], s, strict=True):
            two[a, b] += 1
            above[a] += 1
    n, v = sum(one.values()), len(one)
    s = seq(text)
    k = language_model.KAPPA
    base = sum(np.log10((one[w] + 1) / (n + v + 1)) for w in s)
    full = sum(np.log10((two[a, b] + k * (one[b] + 1) / (n + v + 1)) / (above[a] + k)) for a, b in zip(["<b>", *s[:-1]], s, strict=True))
    return len(s), sum(one[w] > 0 for w in s), n, base, full


def test_language_model_against_counts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "The", "of", "cat", "sat", "über", "x1"]) for _ in range(rng.randint(0, 40))) for _ in range(80)] + [None, "", "unseen words only", "hot hot " * 3000]
    rows = [(k, t, k % 5 == 2, 1) for k, t in enumerate(texts)]
    got = {r.doc_id: r for r in language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, score int").repartition(3)).collect()}
    train = [t for _, t, h, _ in rows if not h]
    assert len(got) == len(rows)
    for k, t, h, _ in rows[:20] + rows[-4:]:
        n, known, total, base, full = brute_model(train, t)
        assert (got[k].n_tokens, got[k].n_known, got[k].train_tokens, got[k].held_out) == (n, known, total, h)
        assert got[k].base_score == pytest.approx(base, rel=1e-9)
        assert got[k].score == pytest.approx(full, rel=0.02, abs=0.02)
    assert language_model.score_documents(spark.createDataFrame([], "doc_id long, text string, held_out boolean")).count() == 0


def test_language_model_scores_do_not_depend_on_partitions(spark, monkeypatch):
    """Nor on which pairs are hot: none, or all that any partition holds."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "of", "cat", "sat", f"x{k % 30}"]) for _ in range(30)) for k in range(120)] + ["hot pair " * 400, "never seen there"]
    docs = spark.createDataFrame([(k, t, k % 7 == 2) for k, t in enumerate(texts)], "doc_id long, text string, held_out boolean")
    scores = []
    for parts, share in ((1, 5e-4), (7, 5e-4), (3, 1.0)):
        monkeypatch.setattr(language_model, "HOT_SHARE", share)
        scores.append({r.doc_id: r.score for r in language_model.score_documents(docs.repartition(parts)).collect()})
    for k in range(len(texts)):
        assert scores[0][k] == pytest.approx(scores[1][k], rel=1e-9) and scores[0][k] == pytest.approx(scores[2][k], rel=1e-9)


def test_list_entries_in_any_form(spark):
    forms = ["Evil.com", "www.evil.com", "http://evil.com/", "evil.com/", "https://user@EVIL.com:8080", " evil.com "]
    urls = ["http://www.evil.com/a/b?q", "https://sub.evil.com", "http://good.com/Bad/page", "http://good.com/other", None]
    captures = spark.createDataFrame([(u, "2024-03-01") for u in urls], "url string, day string").selectExpr("url", "cast(day as date) as fetched_on")
    for form in forms:
        rows = [(form, "block", "2024-01-01"), ("http://www.good.com/Bad/", "block", "2024-01-01"), ("", "block", "2024-01-01"), (None, "block", "2024-01-01")]
        entries = spark.createDataFrame(rows, "pattern string, action string, day string").selectExpr("pattern", "action", "cast(day as date) as listed_on")
        got = {r.url: (r.verdict, r.matched) for r in url_filter.url_verdicts(captures, entries).collect()}
        assert got == {urls[0]: ("block", "evil.com"), urls[1]: ("block", "evil.com"), urls[2]: ("block", "good.com/Bad"), urls[3]: ("none", None), None: ("none", None)}
