"""A corpus pipeline: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewise.llm.common import broadcast_if_small, held_out, materialise
from framewise.llm.line_dedup import line_dedup
from framewise.llm.mixing import mix
from framewise.llm.near_dedup import near_groups
from framewise.llm.packing import best_fit_packing, vocabulary_files
from framewise.llm.quality import quality_scores

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.5
#: Most that the mixing raises a domain's tokens, and a document's rate: the quality stage leaves hardly a document of two domains, and these aren't to pile up.
LIFT, MOST = 2.0, 4.0
#: Bytes of an Arrow batch, at most about: the engine and a worker each hold a task's batch, beside the heap (Spark's default is 64 MB, and 10,000 rows).
BATCH = 4 << 20


def _small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH; stages are run by whoever reads them, so this stays set. Results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text has it now."""
    return df.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out("doc_id", 4))
    return quality_scores(docs, labels).where(F.col("score") >= LEAST_QUALITY).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on many sites."""
    return _documents(line_dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id (a null one last).

    Rows are told apart by numbers of their own, so repeated and null ids
    neither save nor drop other rows.
    """
    _small_batches(spark)
    rows = materialise(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    groups = materialise(near_groups(rows, 80, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id", "kept"), "near-groups")
    several = materialise(groups.where("not kept").select("component_id").distinct(), "near-several")
    members = groups.join(broadcast_if_small(several), "component_id", "left_semi").join(rows.select("_row", "doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    members = materialise(members.select("component_id", "_row", order.alias("order")), "near-members")
    stays = members.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first._row").alias("_row"))
    dropped = materialise(members.select("_row").join(stays, "_row", "left_anti"), "near-dropped")
    return rows.join(broadcast_if_small(dropped), "_row", "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its rate says."""
    _small_batches(spark)
    mixed, _ = mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), lift=LIFT, most=MOST)
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 2048 tokens."""
    _small_batches(spark)
    return best_fit_packing(docs, vocabulary_files())


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("mixing to target weights", mixing), ("best-fit packing", packing)]

#: SQL can't express the classifier, the mixing and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
