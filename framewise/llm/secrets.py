"""Secret scans with multipart credential linking, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

#: Fixed patterns: base spans.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Fixed patterns: weak parts, reported only beside complementary ones.
WEAK_SECRET = r"[A-Za-z0-9+/=]{40,}"
ENDPOINT = r"https?://[A-Za-z0-9._:/-]+"
#: Characters between two parts of one credential, at most.
SCOPE = 240
KINDS = ("assign", "access", "hex", "weak_secret", "endpoint")


def _matches(text: Column, pattern: str, group: int | None = None, literal: str | None = None) -> Column:
    """Spans (start, end, value) of a pattern's leftmost non-overlapping matches, in code points, end exclusive.

    The text between matches gives the starts: one split and one extraction,
    both linear in the text. value is the match or its group. Matches are
    walked in runs of about the square root of their number, so that no array
    grows match by match over a whole text. Texts without literal are passed
    over.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = found if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(
        F.transform(F.split(text, pattern), lambda x: F.length(x)).alias("gap"),
        F.transform(found, lambda x: F.length(x)).alias("size"),
        values.alias("value"),
    )
    steps = F.filter(steps, lambda x: x["size"].isNotNull())
    spans = "array<struct<start:int,end:int,value:string>>"

    def starts(runs: Column) -> Column:
        """Where each run begins."""
        sizes = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda s, x: s + x["gap"] + x["size"]))
        return F.aggregate(sizes, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))

    def walk(run: Column, begin: Column) -> Column:
        return F.aggregate(
            run,
            F.struct(begin.alias("at"), F.array().cast(spans).alias("out")),
            lambda s, x: F.struct(
                (s["at"] + x["gap"] + x["size"]).alias("at"),
                F.concat(s["out"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("end"), x["value"].alias("value")))).alias("out"),
            ),
            lambda s: s["out"],
        )

    def cut(steps: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(steps))).cast("int")
        return F.transform(F.sequence(F.lit(0), ((F.size(steps) - 1) / width).cast("int")), lambda k: F.slice(steps, k * width + 1, width))

    # Arrays of one bind what is used twice, so that it is worked out once.
    walked = F.transform(F.array(steps), lambda st: F.transform(F.array(cut(st)), lambda runs: F.flatten(F.zip_with(runs, F.slice(starts(runs), 1, F.size(runs)), walk)))[0])[0]
    some = text.rlike(pattern) if literal is None else F.contains(text, F.lit(literal)) & text.rlike(pattern)
    return F.when(some, walked).otherwise(F.array().cast(spans))


def _spans(spans: Column, kind: int) -> Column:
    """(start, kind, end) structs, which sort by start, then kind as listed."""
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its spans of each kind, as arrays of (start, kind, end); no text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    assign = F.filter(_matches(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= 6)
    weak = F.filter(
        _matches(text, WEAK_SECRET),
        lambda x: (F.length(x["value"]) == 40) & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]") & x["value"].rlike("[0-9]") & ~F.contains(x["value"], F.lit("=")),
    )
    found = [assign, _matches(text, ACCESS, literal="AKIA"), _matches(text, HEX), weak, _matches(text, ENDPOINT, literal="://")]
    return docs.select(F.col(id_col).alias("doc_id"), *(_spans(x, k).alias(KINDS[k]) for k, x in enumerate(found)))


def linked_weak(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Interval join of weak parts with their complements: row, weak spans that are reported.

    Parts of one credential lie within scope characters of its access
    identifier. A weak secret needs an access identifier; an endpoint needs an
    access identifier and a secret (an assignment or a weak secret) beside it.
    Every access identifier opens the interval [start - scope, end + scope];
    intervals and parts meet by (row, bin of scope characters) in every bin
    that both touch, so each bin's rows are bounded by the characters in it,
    and only documents with an access identifier and a weak part take part.
    """
    some = found.where((F.size("access") > 0) & (F.size("weak_secret") + F.size("endpoint") > 0))
    bins = lambda lo, hi: F.sequence(F.floor(F.greatest(lo, F.lit(0)) / scope).cast("long"), F.floor(hi / scope).cast("long"))
    ids = some.select("row", F.explode("access").alias("a")).select("row", F.explode(bins(F.col("a.start") - scope, F.col("a.end") + scope)).alias("bin"), "a")
    # Of one bin the outermost intervals decide for every part in it: those that reach farthest either way.
    ids = ids.groupBy("row", "bin").agg(F.min("a.start").alias("first"), F.max("a.end").alias("last"), F.collect_set(F.struct("a.start", "a.end")).alias("all"))
    other = some.select("row", F.explode(F.concat("assign", "weak_secret", "endpoint")).alias("p")).withColumn("bin", F.explode(bins(F.col("p.start"), F.col("p.end"))))
    near = (F.col("p.end") >= F.col("first") - scope) & (F.col("p.start") <= F.col("last") + scope)
    met = other.join(ids, ["row", "bin"]).where(near).where(F.exists("all", lambda a: (F.col("p.start") <= a["end"] + scope) & (F.col("p.end") >= a["start"] - scope)))
    met = met.select("row", "p", F.explode(F.filter("all", lambda a: (F.col("p.start") <= a["end"] + scope) & (F.col("p.end") >= a["start"] - scope))).alias("a"))
    # A secret beside the same identifier completes an endpoint.
    secret = F.max(F.col("p.kind").isin(0, 3)).alias("secret")
    complete = met.groupBy("row", "a").agg(secret).where("secret").select("row", "a", F.lit(True).alias("complete"))
    kept = met.where(F.col("p.kind").isin(3, 4)).join(complete, ["row", "a"], "left").where((F.col("p.kind") == 3) | F.col("complete"))
    return kept.groupBy("row").agg(F.collect_set("p").alias("weak"))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Secrets of every whole text, one row per document.

    Null and empty texts have no spans and the digest of an empty string.
    Repeated rows are scanned each by itself; a null id stays null; an empty
    table gives no rows; extra columns are not read. Returns doc_id,
    n_assign, n_access, n_hex, base_sha256, n_linked and spans.
    """
    found = materialise(parts(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "secret-parts")  # the row numbers hold from here on
    base = F.concat("assign", "access", "hex")
    weak = F.coalesce("weak", F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    return found.join(linked_weak(found, scope), "row", "left").select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        F.size(weak).cast("long").alias("n_linked"),
        _joined(F.concat(base, weak)).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_spans(kind: int, pattern: str, keep: str, group: int = 0) -> str:
    """DuckDB SQL for one kind's spans: (doc_id, kind, s, e)."""
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, s, s + len(m) AS e FROM (
  SELECT doc_id, unnest(ms) AS m, unnest(vs) AS v,
         unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(gaps[1:i], lambda x: len(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: len(x))), 0)))::BIGINT AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, string_split_regex(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}'))
) WHERE {keep}"""


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (
{_sql_spans(0, ASSIGN, "len(v) >= 6", 2)}
UNION ALL {_sql_spans(1, ACCESS, "true")}
UNION ALL {_sql_spans(2, HEX, "true")}
UNION ALL {_sql_spans(3, WEAK_SECRET, "len(v) = 40 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') AND NOT contains(v, '=')")}
UNION ALL {_sql_spans(4, ENDPOINT, "true")}),
met AS (SELECT p.*, a.s AS a_s, a.e AS a_e FROM p JOIN p a ON a.doc_id = p.doc_id AND a.kind = 1 AND p.kind IN (0, 3, 4) AND p.s <= a.e + {SCOPE} AND p.e >= a.s - {SCOPE}),
complete AS (SELECT DISTINCT doc_id, a_s, a_e FROM met WHERE kind IN (0, 3)),
weak AS (SELECT DISTINCT m.doc_id, m.kind, m.s, m.e FROM met m LEFT JOIN complete c USING (doc_id, a_s, a_e) WHERE m.kind = 3 OR m.kind = 4 AND c.doc_id IS NOT NULL),
spans AS (SELECT * FROM p WHERE kind < 3 UNION ALL SELECT * FROM weak),
said AS (SELECT *, (['assign', 'access', 'hex', 'weak_secret', 'endpoint'])[kind + 1] || ':' || s || ':' || e AS x FROM spans),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  coalesce(string_agg(x, ',' ORDER BY s, kind, e) FILTER (kind < 3), '') AS base, count(*) FILTER (kind > 2) AS n_linked, string_agg(x, ',' ORDER BY s, kind, e) AS spans FROM said GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(n_linked, 0) AS n_linked, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""
