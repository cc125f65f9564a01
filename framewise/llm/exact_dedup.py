"""Exact dedup against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, join_by_count, materialise, shared_dir

#: Digests of a bucket of the index, at most about.
BUCKET_ROWS = 4_000_000


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = [hashlib.sha256((t or b"").translate(LOWER)).digest() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary())], ["doc_id", "digest"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the SHA-256 of each whole text after lower-casing A-Z only; null counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(_digest_batches, "doc_id long, digest binary")


class DigestIndex:
    """A persistent table (digest, keep_id, group_size, batch), bucketed and sorted by digest.

    ``ingest`` groups a batch by digest, finds by a sort-merge anti-join with
    the index the digests that are new, and appends them; of digests that the
    index holds already it appends the batch's largest id and number of rows.
    ``entries`` adds these up, bucket by bucket without a shuffle, so that
    keep_id and group_size are those of all batches. ``compact`` rewrites the
    table with one row a digest, sorted, in as many buckets as its size asks
    for. Joins and appends read and write the index by its buckets, so that
    only the new rows are shuffled.

    What the index is stands beside its rows: ``path/_spec`` holds a row a
    generation with its folder and number of buckets, and ``path/_merged`` the
    batches that compaction has merged. An index opened by its path, in this
    session or a later one without the catalogue's entry, is registered as it
    was written; another number of buckets than asked for is an error. A batch
    has a name (by default its content's combined hashes), which its rows
    carry: a batch that is ingested again, after it or only a part of it was
    appended, adds nothing that is there already. A new generation counts once
    its row in ``_spec`` is written, so a compaction that fails leaves the old one.
    Batches are ingested one at a time.

    The first batch sets the number of buckets (at most about BUCKET_ROWS
    digests each) where none is given. Repeated rows count in group_size; the
    largest doc_id is kept. A null doc_id is kept only when all ids of its
    group are null (then keep_id is null). An empty batch appends nothing.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets, self.generation = spark, buckets, 0
        self.base = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = (path or f"{shared_dir(spark)}/{self.base}").rstrip("/")
        spec = self._side("_spec")
        if spec is not None:
            last = spec.orderBy(F.desc("generation")).first()
            if buckets not in (None, last.buckets):
                raise ValueError(f"the index at {self.path} has {last.buckets} buckets, not {buckets}")
            self.buckets, self.generation = last.buckets, last.generation
            self._register()

    @property
    def name(self) -> str:
        """The table of the generation that holds."""
        return f"{self.base}_{self.generation}"

    @property
    def folder(self) -> str:
        return f"{self.path}/rows-{self.generation}"

    def _side(self, part: str) -> DataFrame | None:
        """A table beside the rows, if it has been written."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return self.spark.read.parquet(f"{self.path}/{part}/*") if files.exists(hadoop) else None

    def _note(self, part: str, rows: DataFrame) -> None:
        """Adds rows to a table beside the index, in a folder of their own."""
        rows.write.parquet(f"{self.path}/{part}/{self.generation}")

    def _register(self) -> None:
        """The catalogue's entry for the files of the generation; one for other files or buckets is an error."""
        if self.spark.catalog.tableExists(self.name):
            held = {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE EXTENDED {self.name}").collect()}
            if int(held["Num Buckets"]) != self.buckets or not held["Location"].rstrip("/").endswith(self.folder.partition(":")[2].lstrip("/") or self.folder.lstrip("/")):
                raise ValueError(f"table {self.name} is not the index at {self.path}")
            return
        self.spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, group_size BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")

    def _start(self, rows: int, buckets: int | None) -> None:
        self.buckets = buckets or max(8, -(-rows // BUCKET_ROWS))
        self._register()

    def _commit(self) -> None:
        self._note("_spec", self.spark.range(1).select(F.lit(self.generation).alias("generation"), F.lit(self.buckets).alias("buckets")))

    def _append(self, rows: DataFrame) -> None:
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        rows.select("digest", "keep_id", "group_size", "batch").repartition(self.buckets, bucket).sortWithinPartitions(bucket, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

    def entries(self) -> DataFrame:
        """One row per digest: digest, keep_id, group_size over all batches; a row that a batch appended twice counts once."""
        once = self.spark.table(self.name).groupBy("digest", "batch").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"))
        return once.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def ingest(self, digested: DataFrame, batch: str | None = None) -> DataFrame:
        """Appends a batch (doc_id, digest), and returns the digests that no other batch holds, with their keep_id and group_size.

        A batch that compaction has merged is not taken again; nothing of it counts as new.
        """
        groups = materialise(digested.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
        if batch is None:
            sums = groups.agg(F.bit_xor(F.xxhash64("digest", "keep_id", "group_size")).alias("a"), F.bit_xor(F.xxhash64("group_size", "keep_id", "digest")).alias("b"), F.count(F.lit(1)).alias("n")).first()
            batch = f"{sums.n}:{sums.a}:{sums.b}"
        merged = self._side("_merged")
        if merged is not None and not merged.where(F.col("batch") == batch).isEmpty():
            return groups.limit(0)
        if self._side("_spec") is None:
            self._start(groups.count(), self.buckets)
            self._commit()
        known = self.spark.table(self.name)
        others = known.where(F.col("batch") != batch).select("digest").hint("merge")
        fresh = materialise(groups.join(others, "digest", "left_anti"), "digest-batch")
        again = materialise(groups.join(others, "digest", "left_semi"), "digest-again")
        own = known.where(F.col("batch") == batch).select("digest").hint("merge")
        self._append(fresh.unionAll(again).withColumn("batch", F.lit(batch)).join(own, "digest", "left_anti"))
        return fresh

    def compact(self, buckets: int | None = None) -> None:
        """Rewrites the index with one row a digest as the next generation; the files of the one before stay until the caller removes them."""
        table, old, rows = self.spark.table(self.name), self.entries(), self.entries().count()
        batches = materialise(table.select("batch").distinct(), "digest-batches")
        self.generation += 1
        self._start(rows, buckets)
        self._append(old.withColumn("batch", F.lit("")))
        self._note("_merged", batches)
        self._commit()


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batches: int = 1) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, against all that the index holds.

    The documents go into the index in batches, by a hash of their ids.
    Extra columns of docs are not read, so their names can't clash. Empty
    tables give an empty result.
    """
    own = materialise(digests(docs, id_col, text_col), "digests")
    for k in range(batches):
        index.ingest(own.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k) if batches > 1 else own)
    known = index.entries().join(own.select("digest").distinct(), "digest", "left_semi").withColumnRenamed("group_size", "_n")
    found = join_by_count(own, materialise(known, "digest-entries"), "digest", "_n", "doc_id")
    return found.select("doc_id", "keep_id", F.col("_n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents in two batches, so that the second meets the index of the first."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), DigestIndex(spark), batches=2)


SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h)
"""
