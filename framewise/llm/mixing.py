"""Mixing sources to target weights by soft domain membership."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features
from .common import materialise

#: Domains of the labelled table, as (quality, toxic), and the shares of tokens wanted.
DOMAINS = ((1, 0), (1, 1), (0, 0), (0, 1))
TARGETS = (0.90, 0.05, 0.04, 0.01)
#: The first domain's expected tokens after mixing over those before; at 1 or more its pure documents stay.
GROWTH = 1.1
#: Labelled rows of each domain that the classifier is fitted on, at most, and its steps and ridge.
SAMPLE, STEPS, RIDGE = 1024, 200, 1e-4
#: Newton steps at most (a miss is reported), the error relative to its own target at which each target is met, and how softly targets hold (for those out of reach).
ROUNDS, CLOSE, SOFT = 500, 1e-4, 1e-8
BLOCK = 256


class TargetsMissed(UserWarning):
    """Targets that no rates meet within the bounds."""


@dataclass
class Fit:
    """Rates as 1 + posterior @ dual, cut to 0 to most; the domains' expected tokens, those asked for, and those aimed at."""

    dual: np.ndarray
    most: float
    have: np.ndarray
    asked: np.ndarray
    want: np.ndarray

    def rates(self, p: np.ndarray) -> np.ndarray:
        return np.clip(1.0 + p @ self.dual, 0.0, self.most)

    def missed(self) -> list[int]:
        return [k for k in range(len(self.have)) if abs(self.have[k] - self.asked[k]) > CLOSE * max(self.asked[k], 1e-9 * self.have.sum())]


@dataclass
class Classifier:
    """Softmax regression on text features; a few MB at most."""

    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, raw: np.ndarray) -> np.ndarray:
        z = features.weighted(raw, self.idf) @ self.weights + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def fit_classifier(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text_col: str = "text") -> Classifier:
    """Fits on up to sample labelled documents of each domain, by the smallest hashes of their ids. Features are weighted alike, so no pass over all texts is needed.

    Rows are weighted to the domains' shares among all labelled rows. A domain
    without labels gets a posterior near 0. Ids under several labels are left out.
    """
    idf = np.ones(features.SIZE, np.float32)
    own = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"), F.max("quality").alias("_q"), F.max("toxic").alias("_t"))
    own = own.where("quality = _q and toxic = _t")
    sizes = {(r.quality, r.toxic): r["count"] for r in own.groupBy("quality", "toxic").count().collect()}
    picked = None
    for k, (q, t) in enumerate(DOMAINS):
        part = own.where((F.col("quality") == q) & (F.col("toxic") == t)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", F.lit(k).alias("domain"))
        picked = part if picked is None else picked.unionAll(part)
    rows, raw = features.sample_features(docs, picked, text_col)
    n = len(DOMAINS)
    y = np.array([r[1] for r in rows], np.int64)
    total = sum(sizes.get(d, 0) for d in DOMAINS) or 1
    prior = np.array([max(sizes.get(d, 0) / total, 1e-6) for d in DOMAINS])
    x, hot = features.weighted(raw, idf), np.eye(n)[y] if len(rows) else np.zeros((0, n))
    each = prior[y] / np.maximum(np.bincount(y, minlength=n), 1)[y] if len(rows) else np.zeros(0)
    weights, bias = np.zeros((features.SIZE, n), np.float32), np.log(prior)
    # Accelerated gradient descent; a row's length is at most 1, which bounds the curvature.
    speed_w, speed_b = np.zeros_like(weights), np.zeros(n)
    for _ in range(STEPS if len(rows) else 0):
        z = x @ (weights + 0.9 * speed_w) + bias + 0.9 * speed_b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - hot) * each[:, None]
        speed_w = (0.9 * speed_w - 8.0 * (x.T @ g.astype(np.float32) + RIDGE * weights)).astype(np.float32)
        speed_b = 0.9 * speed_b - 0.5 * g.sum(axis=0)
        weights, bias = weights + speed_w, bias + speed_b
    return Classifier(idf, weights, bias)


def memberships(docs: DataFrame, classifier: Classifier, text_col: str = "text") -> DataFrame:
    """docs with posterior (one number per domain) and tokens (words of the text) added."""
    model = docs.sparkSession.sparkContext.broadcast(classifier)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, m = features._Words(), model.value
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                b = batch.slice(first, BLOCK)
                raw, n = np.zeros((b.num_rows, features.SIZE), np.float32), []
                for i, text in enumerate(b.column(at).cast(pa.binary())):
                    raw[i], count = features.counts(text.as_py(), cache)
                    n.append(count)
                p = m.posteriors(raw)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(p), pa.list_(pa.float64())), pa.array(n, pa.int64())], [*b.schema.names, "posterior", "tokens"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*kinds, "posterior array<double>", "tokens long"]))


def fit_rates(rows: DataFrame, targets: tuple[float, ...] = TARGETS, growth: float = GROWTH, lift: float | None = None, most: float | None = None, rounds: int = ROUNDS) -> Fit:
    """Rates of 0 or more whose expected domain tokens are the targets.

    rows: materialised (posterior, tokens). Of all rates that meet the targets
    those nearest to 1 (least squares, by tokens) are 1 + posterior @ duals, cut
    at 0, with one dual for each domain. Newton steps with a line search find
    the duals, until each target is met within CLOSE of itself. A document's
    rate follows from its posterior and the duals, so a round is one
    aggregation (of the slopes at all tried lengths of a step) and nothing per
    document is kept or collected.

    lift (off by default) lowers a target above that many times what a domain
    has, and most (off by default) bounds a rate, so that a domain that is
    hardly there doesn't repeat its few documents without end. Where no rates
    meet all targets, the steps end at the least squares of the errors relative
    to the targets' sizes. Lowered and missed targets are in the result, and a
    warning names them.
    """
    n, top = len(targets), np.inf if most is None else float(most)

    def sums(duals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of duals the expected domain tokens, and their derivatives by the duals."""
        c = len(duals)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have, slopes = np.zeros((c, n)), np.zeros((c, n * n))
            for b in batches:
                p = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                w = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
                r = 1.0 + p @ duals.T
                have += (w * np.clip(r, 0.0, top)).T @ p
                slopes += (w * ((r > 0) & (r < top))).T @ (p[:, :, None] * p[:, None, :]).reshape(-1, n * n)
            total = np.concatenate([have.ravel(), slopes.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["k", "v"])

        found = np.zeros(c * (n + n * n))
        for k, v in rows.select("posterior", "tokens").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v")).collect():
            found[k] = v
        return found[: c * n].reshape(c, n), found[c * n :].reshape(c, n, n)

    dual, done = np.zeros(n), 0
    (have,), (slope,) = sums(dual[None])
    share = np.array(targets) / sum(targets)
    asked = share * growth * have[0] / share[0]
    want = asked if lift is None else np.minimum(asked, np.append(np.inf, lift * have[1:]))
    size = np.maximum(want, max(1e-9 * have.sum(), 1e-9))
    lengths = 3.0 ** -np.arange(18)
    while done < rounds and (np.abs(have - want) > CLOSE * size).any():
        left = want - have - SOFT * size * dual
        if (np.abs(left) <= 0.01 * CLOSE * size).all():
            break  # the least squares: the targets are out of reach
        step = np.linalg.solve(slope / np.sqrt(np.outer(size, size)) + SOFT * np.eye(n), left / np.sqrt(size)) / np.sqrt(size)
        tried = dual + lengths[:, None] * step
        haves, slopes = sums(tried)
        # The rise along the step falls with its length: the longest step that doesn't go beyond the best one.
        rise = (want - haves - SOFT * size * tried) @ step
        fine = np.flatnonzero(rise >= -1e-6 * (left @ step))
        k = fine[0] if len(fine) else len(lengths) - 1
        dual, have, slope, done = tried[k], haves[k], slopes[k], done + 1
    fit = Fit(dual, top, have, asked, want)
    if fit.missed():
        said = "; ".join(f"domain {k}: {have[k]:.6g} tokens, asked {asked[k]:.6g}" + (f", lowered to {want[k]:.6g}" if want[k] < asked[k] else "") for k in fit.missed())
        warnings.warn(f"mixing after {done} rounds, targets not met: {said}", TargetsMissed, stacklevel=2)
    return fit


def mix(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, growth: float = GROWTH, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, lift: float | None = None, most: float | None = None) -> tuple[DataFrame, Fit]:
    """docs with posterior, tokens, rate and copies added (without the text if keep_text is false), and the fit with each domain's residual.

    The texts are read once: documents with their posteriors are written to
    the shared folder, and the fit and the result read that table.

    rate is the fitted number of times that a document occurs; copies is a
    whole number near it, drawn by a hash of the id and the text, whose mean
    is the rate. lift and most as in fit_rates. Null and empty texts have no
    tokens and the posterior of an empty text; very long texts count whole;
    targets that no rates meet are reported by a warning; without labels the
    posteriors are equal to the priors; equal rows get equal copies; an empty
    table gives no rows; columns of these names are replaced.
    """
    base = docs.drop("posterior", "tokens", "rate", "copies", "_chance")
    classifier = fit_classifier(base.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), labels, sample)
    chance = F.pmod(F.xxhash64(F.lit("mix"), id_col, text_col), F.lit(1 << 30)) / float(1 << 30)
    member = memberships(base, classifier, text_col).withColumn("_chance", chance)
    known = materialise(member if keep_text else member.drop(text_col), "memberships")
    fit = fit_rates(known.select("posterior", "tokens"), targets, growth, lift, most)

    def rates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = b.column(b.schema.names.index("posterior")).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fit.rates(p))], [*b.schema.names, "rate"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.schema.fields)
    return known.mapInArrow(rates, f"{kinds}, rate double").withColumn("copies", F.floor(F.col("rate") + F.col("_chance")).cast("int")).drop("_chance"), fit


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    mixed, _ = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep_text=False)
    return mixed.select("doc_id", *(F.col("posterior")[k].alias(f"p_quality{q}_toxic{t}") for k, (q, t) in enumerate(DOMAINS)), "tokens", "rate", "copies")
