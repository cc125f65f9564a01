import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewise.llm import ann, mixing, quality
from framewise.llm.common import held_out

SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.query(spark, SF).join(labels, "doc_id").where("held_out").select("score", "quality", "predicted").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.85 and (good >= 0.7).mean() > 0.9
    assert docs.count() == 1000


def test_quality_edges(spark):
    rows = [(k, "Fine words here and there." if k % 2 else "BAD!! BAD!! WORDS!!", "s", 1.5) for k in range(40)] + [(90, None, "s", 0.0), (91, "", "s", 0.0), (92, "word " * 50_000, "s", 0.0), (1, "Fine words here and there.", "s", 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (3, None), (5, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, labels).collect()}
    assert got[1] > 0.9 and got[2] < 0.1 and 0 <= got[92] <= 1 and got[90] == got[91] == pytest.approx(0.5, abs=0.02)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_quality_against_brute_force(spark):
    """Every score of a small table from its texts and labels, with a full decomposition and all cosines."""
    rng = random.Random(2)
    good, bad = ["Reason", "follows", "evidence,", "slowly.", "and", "then", "rivers"], ["WIN!!", "FREE", "$$$", "click", "click", "now!!", "4u"]
    texts = {k: " ".join(rng.choice(good if rng.random() < 0.3 + 0.4 * (k % 2) else bad) for _ in range(rng.randint(3, 60))) for k in range(90)}
    texts[88] = texts[5]
    labels = {k: k % 2 for k in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in quality.quality_scores(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    cache = quality.features._Words()
    raw = np.stack([quality.features.counts(texts[k].encode(), cache)[0] for k in range(90)])
    x = quality.features.weighted(raw, quality.features.idf((raw > 0).sum(axis=0), 90)).astype(float)
    axes = np.linalg.svd(x[:60], full_matrices=False)[2][: quality.DIMENSIONS].T
    v = x @ axes
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    for k in range(90):
        c = v[:60] @ v[k]
        near = sorted(range(60), key=lambda j: (-round(c[j], 6), j))[: quality.NEIGHBOURS]
        w = np.exp(quality.SHARPNESS * c[near])
        assert got[k] == pytest.approx((w * [labels[j] for j in near]).sum() / w.sum(), abs=0.02)
    assert got[88] == got[5]


def test_equally_near_neighbours_vote_by_id():
    raw = np.zeros((60, quality.features.SIZE), np.float32)
    raw[:, 3] = 1
    m = quality.Model(np.ones(quality.features.SIZE, np.float32), np.eye(quality.features.SIZE)[:, :8], np.zeros(0), (np.arange(60) < 20).astype(float), np.ones(60), 0.5)
    m.vectors = m.latent(raw)
    assert m.score(raw[:3]).tolist() == [20 / quality.NEIGHBOURS] * 3 == m.score(raw[:1]).tolist() * 3


def test_held_out_rule(spark):
    import zlib

    got = {r.id: r.h for r in spark.range(40).select("id", held_out("id", 7).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(40)}


def nearest_to_one(p, tokens, want, most=np.inf, rounds=40_000):
    """Rates nearest to 1 that meet the targets, by alternating projections on the targets' plane and on the bounds."""
    a = (p * tokens[:, None]).T
    back = p @ np.linalg.pinv(a @ p)
    r, bent = np.ones(len(p)), np.zeros(len(p))
    for _ in range(rounds):
        r = r + back @ (want - a @ r)
        inside = np.clip(r + bent, 0, most)
        r, bent = inside, r + bent - inside
    return r


def test_rates_against_brute_force(spark):
    rng = np.random.default_rng(3)
    p, tokens = rng.dirichlet([2, 0.6, 0.5, 0.4], 40), rng.integers(10, 500, 40)
    rows = spark.createDataFrame([(x.tolist(), int(t)) for x, t in zip(p, tokens, strict=True)], "posterior array<double>, tokens long")
    fit = mixing.fit_rates(rows, targets=(0.8, 0.08, 0.07, 0.05))
    assert not fit.missed() and (fit.rates(p) == 0).any()
    assert np.allclose(fit.rates(p), nearest_to_one(p, tokens.astype(float), fit.asked), atol=2e-3)
    share = (p * tokens[:, None]).sum(axis=0) / tokens.sum()
    bounded = mixing.fit_rates(rows, targets=tuple(share * [1.0, 0.97, 1.02, 1.0]), growth=1.0, most=1.03)
    assert not bounded.missed() and bounded.rates(p).max() <= 1.03
    assert np.allclose(bounded.rates(p), nearest_to_one(p, tokens.astype(float), bounded.asked, 1.03), atol=2e-3)


def test_rates_where_domains_are_all_but_empty(spark):
    """After a quality stage hardly anything of two domains is left; within bounds documents stay all the same."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet([50, 3, 0.01, 0.001], 500)
    rows = spark.createDataFrame([(x.tolist(), 100) for x in p], "posterior array<double>, tokens long")
    with pytest.warns(mixing.TargetsMissed, match="domain 2: .* lowered"):
        fit = mixing.fit_rates(rows, lift=2.0, most=4.0)
    r = fit.rates(p)
    assert (r <= 4).all() and fit.have[0] > 0.95 * fit.want[0] and (r > 0.5).mean() > 0.9
    assert 2 in fit.missed() and fit.want[2] < fit.asked[2]


@pytest.mark.parametrize("shares", [[0.05, 0.02, 0.90, 0.03], [0.05, 0.90, 0.02, 0.03], [0.05, 0.02, 0.03, 0.90]])
def test_rates_meet_each_target_where_one_domain_holds_most(spark, shares):
    rng = np.random.default_rng(6)
    p, tokens = rng.dirichlet(np.array(shares) / 5, 3000), rng.integers(10, 500, 3000)
    rows = spark.createDataFrame([(x.tolist(), int(t)) for x, t in zip(p, tokens, strict=True)], "posterior array<double>, tokens long")
    fit = mixing.fit_rates(rows)
    assert np.allclose((fit.rates(p) * tokens) @ p, fit.have)
    assert (np.abs(fit.have - fit.asked) <= mixing.CLOSE * fit.asked).all() and not fit.missed()


def test_targets_out_of_reach_are_reported(spark):
    rows = spark.createDataFrame([([0.25] * 4, 10)] * 50, "posterior array<double>, tokens long")
    with pytest.warns(mixing.TargetsMissed, match="domain 0: .* asked"):
        fit = mixing.fit_rates(rows)
    assert np.allclose(fit.have, fit.have[0]) and fit.missed()
    only = spark.createDataFrame([([1.0, 0.0, 0.0, 0.0], 10)] * 50, "posterior array<double>, tokens long")
    with pytest.warns(mixing.TargetsMissed, match="domain 3: 0 tokens, asked"):
        fit = mixing.fit_rates(only)
    assert fit.have[0] == pytest.approx(550, rel=1e-3)


def test_mix(spark):
    got = mixing.query(spark, SF).toPandas()
    assert len(got) == 1000 and (got.rate >= 0).all()
    share = (got.rate * got.tokens * got.p_quality1_toxic0).sum() / (got.rate * got.tokens).sum()
    assert share == pytest.approx(0.90, abs=0.01)
    assert ((got.copies >= np.floor(got.rate)) & (got.copies <= np.ceil(got.rate))).all()
    clean = got[got.p_quality1_toxic0 > 0.98]
    assert (clean.copies >= 1).mean() > 0.99


def test_mix_edges(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "some words", 7), (3, "some words", 7)], "doc_id long, text string, rate int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mixing.mix(docs, none)[0].collect()
    assert len(rows) == 4 and len({r.copies for r in rows if r.doc_id == 3}) == 1
    assert mixing.mix(docs.limit(0), none)[0].count() == 0
    long = spark.createDataFrame([(1, "word " * 100_000), (None, "few words")], "doc_id long, text string")
    assert {r.tokens for r in mixing.mix(long, spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"))[0].collect()} == {100_000, 2}


def test_forest_recall_and_scores(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((3000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:400] = v[100]
    rows = [(i, x.tolist(), 0.5) for i, x in enumerate(v)] + [(5000, None, 0.0), (5020, [0.0] * 64, 0.0), (5040, [float("nan")] * 64, 0.0), (5060, [None] * 64, 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = ann.nearest(df, df.where("vec_id % 20 = 0")).toPandas()
    assert len(got) == 150 * 20 and not got.vec_id.isin([5000, 5020, 5040, 5060]).any()
    d = v.astype(np.float64)
    hits = 0
    for q, own in got.groupby("query_id"):
        s = d @ d[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(len(s)), -s))[:20]
        hits += len(set(best) & set(own.vec_id))
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and own.score.is_monotonic_decreasing
        assert np.allclose(own.score, s[own.vec_id], atol=1e-12)
        if 100 <= q < 400:
            assert own.vec_id.tolist() == [i for i in range(100, 400) if i != q][:20]
    assert hits / len(got) >= 0.9
    few = df.where("vec_id in (0, 1, 2)")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 2
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_forest_on_the_embeddings(spark):
    """Recall on the whole table against brute force, every hash bit in use, and repeated ids."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got, v = ann.query(spark, SF).toPandas(), rows.toPandas().set_index("vec_id").embedding
    x = np.stack(v.to_numpy()).astype(np.float64)
    hits = 0
    for q, own in got.groupby("query_id"):
        s = x @ x[v.index.get_loc(q)]
        s[v.index.get_loc(q)] = -np.inf
        hits += len(set(v.index[np.lexsort((v.index, -s))[:20]]) & set(own.vec_id))
    assert len(got) == 25 * 20 and hits / len(got) >= 0.95
    twice = rows.where("vec_id < 3").unionAll(rows.where("vec_id = 0")).unionAll(rows.where("vec_id = 1").selectExpr("0L", "embedding", "label"))
    found = ann.nearest(twice, twice.where("vec_id = 0")).toPandas()
    assert sorted(found.vec_id) == [1, 1, 2, 2] and sorted(found["rank"]) == [1, 1, 2, 2]


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("n", [5, 15, 21, 30, 60, 100, 200])
def test_small_forests_against_brute_force(n, spread):
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v *= rng.lognormal(0, spread, (n, 1)).astype(np.float32)
    ids = np.arange(n)
    q, i, _ = ann.Shard(ids, v).search(v, ids, 20)
    s = v.astype(np.float64) @ v.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    for k in ids:
        assert i[q == k].tolist() == np.argsort(-s[k], kind="stable")[: min(20, n - 1)].tolist()


@pytest.mark.parametrize("spread", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("n", [2_000, 10_000])
def test_recall_at_unequal_lengths(n, spread):
    rng = np.random.default_rng(n)
    v = rng.standard_normal((n, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v *= rng.lognormal(0, spread, (n, 1)).astype(np.float32)
    asked = np.arange(0, n, 50)
    q, i, score = ann.Shard(np.arange(n), v).search(v[asked], asked, 20)
    s = v[asked].astype(np.float64) @ v.astype(np.float64).T
    s[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-s, axis=1, kind="stable")[:, :20]
    hits = sum(len(set(best[k]) & set(i[q == k])) for k in range(len(asked)))
    assert hits >= 0.9 * best.size and np.array_equal(score, np.sort(score.reshape(-1, 20))[:, ::-1].ravel())


def test_pipeline_runs_over_its_stages(spark):
    import corpus_pipeline

    from framewise.plans.shared import materialise

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, SF), "t")
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.where("piece = 0").count() == sizes[4]
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    random.seed(0)


def test_pipeline_stages_hold_small_batches(spark, monkeypatch):
    """A task's batch of whole texts is bounded in bytes: it stands beside the executor's heap."""
    import corpus_pipeline
    import pyarrow as pa

    size = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    monkeypatch.setattr(corpus_pipeline, "best_fit_packing", lambda docs, _: docs.select("text").mapInArrow(size, "n long"))
    docs = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), 2000).alias("text"))
    found = corpus_pipeline.packing(spark, docs, SF).agg(F.sum("n"), F.max("n")).first()
    assert found[0] > 30_000_000 and found[1] < 6_000_000
