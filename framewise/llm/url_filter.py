"""URL filters by a temporal list join, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise

#: Days of a bucket of time, by which intervals and captures meet.
BUCKET = 30
#: Segments of a path up to which patterns() makes prefixes, if not told otherwise.
DEPTH = 2


def host(url):
    """A URL's host in lower case, without user, port and a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")


def patterns(url, depth: int = DEPTH):
    """What a list may name: the host and its parent domains of two labels or more, and the host with path prefixes of up to depth segments. Most specific last."""
    h = host(url)
    labels = F.split(h, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, -1 - i, i + 1), "."))
    parents = F.when(F.size(labels) > 1, parents).otherwise(F.array(h))
    path = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), "/"), lambda x: x != "")
    steps = F.transform(F.sequence(F.lit(1), F.lit(depth)), lambda i: F.when(F.size(path) >= i, F.concat(h, F.lit("/"), F.array_join(F.slice(path, 1, i), "/"))))
    return F.when(h != "", F.array_distinct(F.concat(parents, F.filter(steps, lambda x: x.isNotNull())))).otherwise(F.array().cast("array<string>"))


def named(entry):
    """What a list entry names, in the form of patterns(): its host as host() has it, and its path's segments. Null without a host."""
    url = F.when(F.trim(entry).rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.trim(entry)).otherwise(F.concat(F.lit("http://"), F.trim(entry)))
    path = F.filter(F.split(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), "/"), lambda x: x != "")
    return F.when(host(url) != "", F.array_join(F.concat(F.array(host(url)), path), "/"))


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (pattern, action, listed_on) to validity intervals (pattern, action, since, until).

    Entries may be written as hosts or URLs, with or without a scheme, user,
    port, leading www or closing slash; see named(). An entry holds until the pattern's next entry; the action remove ends an
    interval and opens none. Of several entries of a pattern on one day the
    last by name counts. until is null where the last entry is still active.
    """
    days = entries.withColumn("pattern", named(F.col("pattern"))).where("pattern is not null and action is not null and listed_on is not null").groupBy("pattern", "listed_on").agg(F.max("action").alias("action"))
    own = Window.partitionBy("pattern").orderBy("listed_on")
    return days.withColumn("until", F.lead("listed_on").over(own)).where("action <> 'remove'").select("pattern", "action", F.col("listed_on").alias("since"), "until")


def url_verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (url, fetched_on and any columns) with verdict and matched.

    Every capture is judged by the list entries active on the day of its
    fetch: the most specific pattern decides (a longer path, then a longer
    host). Without a match, or with a null url or day, verdict is 'none' and
    matched is null. Intervals and captures meet by (pattern, bucket of days),
    so each capture meets at most the few intervals of its bucket; distinct
    (url, day) pairs are judged once. Repeated captures are judged alike;
    empty tables give 'none' or no rows; columns named verdict or matched are
    replaced.
    """
    base = captures.drop("verdict", "matched")
    depth = max(1, entries.agg(F.max(F.size(F.split(named(F.col("pattern")), "/")) - 1)).first()[0] or 0)  # segments of the list's deepest entry
    asked = base.select("url", F.col("fetched_on").alias("day")).where("url is not null and day is not null").distinct()
    day = lambda c: F.datediff(c, F.lit("1970-01-01"))
    keys = asked.select("url", "day", F.floor(day(F.col("day")) / BUCKET).alias("bucket"), F.posexplode(patterns(F.col("url"), depth)).alias("place", "pattern"))
    span = asked.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if span is None or span.lo is None:
        return base.withColumns({"verdict": F.lit("none"), "matched": F.lit(None).cast("string")})
    valid = intervals(entries).where((F.col("since") <= F.lit(span.hi)) & (F.col("until").isNull() | (F.col("until") > F.lit(span.lo))))
    ends = F.coalesce(F.date_sub("until", 1), F.lit(span.hi))
    buckets = F.sequence(F.floor(day(F.greatest("since", F.lit(span.lo))) / BUCKET), F.floor(day(F.least(ends, F.lit(span.hi))) / BUCKET))
    valid = materialise(valid.withColumn("bucket", F.explode(buckets)), "list-intervals")
    met = keys.join(broadcast_if_small(valid), ["pattern", "bucket"]).where("day >= since and (until is null or day < until)")
    found = materialise(met.groupBy("url", "day").agg(F.max(F.struct("place", "action", "pattern")).alias("best")).select(F.col("url").alias("_url"), F.col("day").alias("_day"), F.col("best.action").alias("_verdict"), F.col("best.pattern").alias("_matched")), "url-verdicts")
    joined = base.join(broadcast_if_small(found), (F.col("url") == F.col("_url")) & (F.col("fetched_on") == F.col("_day")), "left")
    return joined.select(*base.columns, F.coalesce("_verdict", F.lit("none")).alias("verdict"), F.col("_matched").alias("matched"))


def _number(c, mod: int):
    """A number from a string that SQL engines agree on."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 7), 16, 10).cast("int") % mod


def dated_list(pages: DataFrame) -> DataFrame:
    """The query's list, as none is among the tables: entries for hosts, parent domains and path prefixes of pages, dated by their names' digests.

    One pattern in four is blocked at first, every other of those is removed
    40 to 139 days later, and one in nine of all is allowed.
    """
    names = pages.select(F.explode(patterns(F.col("url"))).alias("pattern")).distinct()
    n, start = _number(F.col("pattern"), 3600), F.lit("2024-01-01").cast("date")
    first = F.date_add(start, n % 200)
    block = names.where(n % 4 == 0).select("pattern", F.lit("block").alias("action"), first.alias("listed_on"))
    gone = names.where(n % 8 == 0).select("pattern", F.lit("remove").alias("action"), F.date_add(first, 40 + n % 100).alias("listed_on"))
    allow = names.where(n % 9 == 1).select("pattern", F.lit("allow").alias("action"), F.date_add(first, 15).alias("listed_on"))
    return block.unionAll(gone).unionAll(allow)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched_on", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int")))
    return url_verdicts(captures, dated_list(pages)).select("page_id", "url", F.col("fetched_on").cast("string").alias("fetched_on"), "verdict", "matched")


SQL = r"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS day,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '') AS h,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '') AS path FROM pages),
k AS (SELECT *, string_split(h, '.') AS ls FROM c WHERE h <> ''),
pat AS (
  SELECT page_id, url, day, i AS place, array_to_string(ls[len(ls) - i:], '.') AS pattern FROM k, LATERAL (SELECT unnest(range(1, greatest(len(ls), 2))) AS i) WHERE len(ls) > 1
  UNION ALL SELECT page_id, url, day, 1, h FROM k WHERE len(ls) = 1
  UNION ALL SELECT page_id, url, day, 1000 + i, h || '/' || array_to_string(path[1:i], '/') FROM k, LATERAL (SELECT unnest([1, 2]) AS i) WHERE len(path) >= i),
names AS (SELECT DISTINCT pattern, ('0x' || substr(md5(pattern), 1, 7))::BIGINT % 3600 AS n FROM pat),
e AS (SELECT pattern, 'block' AS action, DATE '2024-01-01' + CAST(n % 200 AS INTEGER) AS on_ FROM names WHERE n % 4 = 0
  UNION ALL SELECT pattern, 'remove', DATE '2024-01-01' + CAST(n % 200 + 40 + n % 100 AS INTEGER) FROM names WHERE n % 8 = 0
  UNION ALL SELECT pattern, 'allow', DATE '2024-01-01' + CAST(n % 200 + 15 AS INTEGER) FROM names WHERE n % 9 = 1),
days AS (SELECT pattern, on_, max(action) AS action FROM e GROUP BY ALL),
v AS (SELECT pattern, action, on_ AS since, lead(on_) OVER (PARTITION BY pattern ORDER BY on_) AS until FROM days),
met AS (SELECT page_id, arg_max(action, place) AS verdict, arg_max(p.pattern, place) AS matched FROM pat p JOIN v ON p.pattern = v.pattern AND action <> 'remove' AND day >= since AND (until IS NULL OR day < until) GROUP BY 1)
SELECT c.page_id, c.url, strftime(day, '%Y-%m-%d') AS fetched_on, coalesce(verdict, 'none') AS verdict, matched FROM c LEFT JOIN met USING (page_id)
"""
