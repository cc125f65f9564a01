"""Quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features
from .common import held_out

#: Labelled rows of each class that the model is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 2048
#: Dimensions of the latent space, neighbours that vote, and how sharply similarity weighs.
DIMENSIONS, NEIGHBOURS, SHARPNESS = 64, 25, 12.0
#: Documents whose cosines are computed at once, and decimals of vectors and cosines.
BLOCK, PLACES = 256, 9


@dataclass
class Model:
    """A few MB at most: idf, the latent axes, the labelled vectors, their labels, their weights and the prior."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    prior: float

    def latent(self, raw: np.ndarray) -> np.ndarray:
        """Unit vectors, rounded so that a document's doesn't depend on the others of its block."""
        v = features.weighted(raw, self.idf).astype(np.float64) @ self.axes
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.round(v / np.where(norm > 0, norm, 1), PLACES)

    def score(self, raw: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors by exact cosine, for a block of documents; of equally near ones the smaller ids vote."""
        out = np.full(len(raw), self.prior)
        some = raw.any(axis=1)
        if not len(self.labels) or not some.any():
            return out
        cosine = np.round(self.latent(raw[some]) @ self.vectors.T, PLACES)
        k = min(NEIGHBOURS, cosine.shape[1])
        last = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
        nearer, tied = cosine > last, cosine == last
        near = nearer | tied & (np.cumsum(tied, axis=1) <= k - nearer.sum(axis=1, keepdims=True))
        at = np.nonzero(near)[1].reshape(-1, k)
        close = np.take_along_axis(cosine, at, axis=1)
        vote = np.exp(SHARPNESS * (close - close.max(axis=1, keepdims=True))) * self.weights[at]
        out[some] = np.round((vote * self.labels[at]).sum(axis=1) / vote.sum(axis=1), PLACES)
        return np.clip(out, 0.0, 1.0)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, sample: int) -> DataFrame:
    """Up to sample labelled rows of each class (0 and 1), by the smallest hashes of their ids, with the class's size.

    Ids under several labels are left out, as are null ones. Ranks are taken
    with a limit for each class, not in one window.
    """
    own = labels.groupBy("doc_id").agg(F.min(label_col).alias("label"), F.max(label_col).alias("other"), F.count(label_col).alias("n"))
    own = own.where("label = other and n > 0 and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    sides = []
    for k in (0, 1):
        side = own.where(F.col("label") == k)
        total = side.count()
        sides.append(side.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("total", F.lit(total)))
    return sides[0].unionByName(sides[1])


def latent_axes(x: np.ndarray, dimensions: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of x, by subspace iteration from a seeded start."""
    y = np.random.default_rng(3).standard_normal((x.shape[1], min(dimensions + 16, *x.shape)), np.float32)
    for _ in range(rounds):
        y, _ = np.linalg.qr(x.T @ (x @ y))
    _, _, turn = np.linalg.svd(x @ y, full_matrices=False)
    return np.ascontiguousarray((y @ turn.T)[:, :dimensions], np.float64)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, text_col: str = "text") -> Model:
    """Fits on up to sample labelled documents of each class, in the order of their ids; idf counts all of docs.

    Each neighbour's vote is weighted by the share of its class among all
    labelled rows over its share in the sample, so that the bound doesn't
    shift the votes.
    """
    idf = features.idf(*features.document_frequencies(docs, text_col))
    rows, raw = features.sample_features(docs, labelled_sample(docs, labels, label_col, sample), text_col)
    keep = raw.any(axis=1)
    rows, raw = [r for r, k in zip(rows, keep, strict=True) if k], raw[keep]
    label = np.array([r[1] for r in rows], np.float64)
    total = np.array([r[2] for r in rows], np.float64)
    if not len(rows):
        return Model(idf, np.zeros((features.SIZE, 1)), np.zeros((0, 1)), label, label, 0.5)
    x = features.weighted(raw, idf)
    axes = latent_axes(x, DIMENSIONS)
    sizes = {k: float(np.sum(label == k)) for k in set(label.tolist())}
    weights = np.array([t / sizes[k] for k, t in zip(label.tolist(), total, strict=True)])
    totals = {k: t for k, t in zip(label.tolist(), total, strict=True)}
    model = Model(idf, axes, np.zeros(0), label, weights / weights.max(), totals.get(1.0, 0.0) / sum(totals.values()))
    model.vectors = model.latent(raw)
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = SAMPLE, text_col: str = "text") -> DataFrame:
    """docs with the column score (0 to 1, higher: label 1 likelier) added.

    The model (at most 2 * sample vectors) is broadcast; each task holds a
    block of documents. Null and empty texts get the prior, the share of label
    1; without usable labels every score is 0.5; repeated rows score alike; an
    empty table gives no rows; a column named score is replaced. Only the text
    is an input of a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label_col, sample, text_col))
    base = docs.drop("score")
    at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, m = features._Words(), model.value
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                b = batch.slice(first, BLOCK)
                raw = np.zeros((b.num_rows, features.SIZE), np.float32)
                for i, text in enumerate(b.column(at).cast(pa.binary())):
                    raw[i] = features.counts(text.as_py(), cache)[0]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(m.score(raw))], [*b.schema.names, "score"])

    schema = base.schema
    return base.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + ["score double"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out("doc_id", 4))
    scored = quality_scores(docs, labels)
    return scored.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
