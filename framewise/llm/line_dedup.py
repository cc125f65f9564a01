"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, join_by_count, materialise

#: Sites that a line must stand on to be boilerplate.
MIN_SITES = 10
#: log2 of the registers of a sketch, and the relative error of its estimate at three standard deviations.
LG_K = 12
ERROR = 3 * 1.04 / 2 ** (LG_K / 2)
#: Sketches of one line are built in as many parts, so that a hot line isn't one task's.
PARTS = 16


def _key():
    """A line's hash (64 bits stand for the line); spaces, tabs and carriage returns at its ends don't count, and blank lines have none."""
    line = F.trim("line", F.lit(" \t\r"))
    return F.when(line != "", F.xxhash64(line))


def site_spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """The hashes of lines on at least min_sites distinct sites. lines: materialised (key, site).

    Lines on one site only drop out by a min and max, which combine before the
    shuffle. Of the others, sketches by line and part merge into an estimate;
    estimates within the error of the threshold are replaced by exact distinct
    counts. A null site is no site.
    """
    lines = lines.where("key is not null and site is not null")
    several = materialise(lines.groupBy("key").agg(F.min("site").alias("a"), F.max("site").alias("b")).where("a <> b").select("key"), "lines-several")
    spread = lines.join(broadcast_if_small(several), "key", "left_semi")
    parts = spread.groupBy("key", F.pmod(F.xxhash64("site"), F.lit(PARTS)).alias("part")).agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    estimates = materialise(parts.groupBy("key").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch", False)).alias("sites")), "lines-spread")
    near = F.abs(F.col("sites") - min_sites) <= F.ceil(F.lit(min_sites * ERROR)) + 1
    close = broadcast_if_small(materialise(estimates.where(near).select("key"), "lines-near"))
    exact = lines.join(close, "key", "left_semi").groupBy("key").agg(F.count_distinct("site").alias("sites"))
    return estimates.where(~near).unionByName(exact).where(F.col("sites") >= min_sites).select("key")


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with boilerplate lines taken out of text, and the columns n_lines and n_removed added.

    A line that stands on min_sites distinct sites or more is taken out
    everywhere. Blank lines stay. A null text stays null with no lines; a text
    whose lines all go becomes empty; very long texts are split whole; repeated
    rows are each cleaned; a null site adds no spread; an empty table gives an empty result. Columns of docs
    named n_lines or n_removed are replaced.
    """
    split = F.split(F.col(text_col), "\n", -1)
    lines = materialise(docs.select(F.explode(split).alias("line"), F.col(site_col).alias("site")).select(_key().alias("key"), "site"), "lines")
    found = materialise(site_spread(lines, min_sites), "boilerplate")
    # What goes depends on the text alone, so the positions are found once a text; a text of very many rows is dealt into parts.
    ident = F.struct(F.xxhash64(text_col).alias("h"), F.crc32(F.col(text_col).cast("binary")).alias("c"), F.length(text_col).alias("n"))
    at = docs.select(ident.alias("_ident"), F.posexplode(split).alias("pos", "line")).select("_ident", "pos", _key().alias("key"))
    drops = at.join(broadcast_if_small(found), "key", "left_semi").groupBy("_ident").agg(F.collect_set("pos").alias("_drops"), F.count(F.lit(1)).alias("n"))
    drops = materialise(drops.withColumn("_rows", F.ceil(F.col("n") / F.size("_drops"))).drop("n"), "line-drops")
    joined = join_by_count(docs.withColumns({"_ident": ident, "_spread": F.monotonically_increasing_id()}), drops, "_ident", "_rows", "_spread", "left")
    gone = F.coalesce(F.size("_drops"), F.lit(0))
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col("_drops"), i)), "\n")
    keep = [F.col(c) if c != text_col else F.when(F.col("_drops").isNull(), F.col(c)).otherwise(left).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*keep, F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), gone.cast("long").alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_lines", "n_removed", "text")


_TRIM = "trim(line, ' ' || chr(9) || chr(13))"
SQL = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
b AS (SELECT {_TRIM} AS k FROM l WHERE {_TRIM} <> '' GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}),
g AS (SELECT doc_id, count(*) AS n, count(b.k) AS gone, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (b.k IS NULL), '') AS t FROM l LEFT JOIN b ON {_TRIM} = b.k GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_lines, coalesce(gone, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE t END AS text FROM documents d LEFT JOIN g USING (doc_id)
"""
