"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, broadcast_if_small, join_by_count, materialise, table_bytes

#: Words of a window; an item of fewer words is one window.
WINDOW = 10
#: What parts words, before and after A-Z are lowered.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase), GAP), "")


def _gram(length: int) -> int:
    """Words of a gram, so that two grams cover a window of that length."""
    return length // 2 + 1


def _mask(length: int) -> int:
    """Low bits of a minimum, which tell the places apart that two neighbouring windows can take it from."""
    return (1 << (length - _gram(length) + 1).bit_length()) - 1


def _parts(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


def _with_minima(df: DataFrame, length: int) -> DataFrame:
    """Adds the hashes of all grams (_v) and the least of each window of that length (_m); their low bits hold places. df: _h, hashes of words."""
    k, mask = _gram(length), _mask(length)
    grams = F.transform("_h", lambda x, i: F.xxhash64(F.lit(length), x, *(F.get("_h", i + j) for j in range(1, k))).bitwiseAND(F.lit(~mask)).bitwiseOR(i.bitwiseAND(F.lit(mask)).cast("long")))
    least = F.transform("_v", lambda x, i: _parts([x, *(F.get("_v", i + j) for j in range(1, length - k + 1))]))
    whole = lambda c, words: F.slice(c, 1, F.greatest(F.size("_h") - (words - 1), F.lit(0)))
    return df.withColumn("_v", whole(grams, k)).withColumn("_m", whole(least, length))


def _print(m: Column, length: int) -> Column:
    """The fingerprint of a window: its least gram's hash without the place."""
    return m.bitwiseAND(F.lit(~_mask(length)))


def _window(i: Column, length: int) -> Column:
    """The hash of the window at i, by the two grams that cover it."""
    far = F.get("_v", i + (length - _gram(length)))
    return F.when(far.isNotNull(), F.xxhash64(_print(F.get("_v", i), length), _print(far, length)))


def _hashed(df: DataFrame, text: str) -> DataFrame:
    """df with _h, the hashes of the words, in place of texts."""
    return df.withColumn("_w", _words(text)).withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w))).drop("_w", text)


def fingerprints(df: DataFrame, lengths: list[int], text: str) -> DataFrame:
    """df's other columns with x, a row for each distinct winnowed fingerprint of windows of each length; texts drop out."""
    own, df, out = [c for c in df.columns if c != text], _hashed(df, text), None
    for n in lengths:
        each = _with_minima(df, n).select(*own, F.explode(F.array_distinct("_m")).alias("m")).select(*own, _print(F.col("m"), n).alias("x"))
        out = each if out is None else out.unionAll(each)
    return out


def _run(length: int):
    """The run of windows that starts at a place."""

    def at(i: Column) -> Column:
        wins = F.array(*(_window(i + j, length) for j in range(length - _gram(length) + 1)))
        return F.struct(_print(F.get("_m", i), length).alias("x"), i.alias("place"), F.lit(length).alias("length"), wins.alias("wins"))

    return at


def runs(df: DataFrame, lengths: list[int], text: str) -> DataFrame:
    """df's other columns with (x, place, length, wins), a row for each run of windows that take their fingerprint x from one gram: where it starts, and its windows' hashes; texts drop out."""
    own, df, out = [c for c in df.columns if c != text], _hashed(df, text), None
    for n in lengths:
        starts = F.filter(F.sequence(F.lit(0), F.size("_m") - 1), lambda i: (i == 0) | (F.get("_m", i) != F.get("_m", i - 1)))
        each = _with_minima(df, n).withColumn("_s", F.when(F.size("_m") > 0, starts).otherwise(F.array().cast("array<int>")))
        each = each.select(*own, F.inline(F.transform("_s", _run(n))))
        out = each if out is None else out.unionAll(each)
    return out


def benchmark_windows(benchmark: DataFrame, window: int, item: str, text: str) -> DataFrame:
    """The distinct (item, win, x, length) of a benchmark: windows of that many words, or all words of a shorter item."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")
    sized = materialise(items.withColumn("n", F.least(F.size(_words("text")), F.lit(window))).where("n > 0"), "benchmark-items")
    out = None
    for (n,) in sorted(sized.select("n").distinct().collect()):  # window numbers at most
        own = runs(sized.where(F.col("n") == n).select("item", "text"), [n], "text")
        own = own.select("item", "length", "x", F.explode("wins").alias("win")).where("win is not null")
        out = own if out is None else out.unionAll(own)
    return out.groupBy("item", "win", "length").agg(F.collect_set("x").alias("x")) if out is not None else None


def _xor(c: str) -> list[Column]:
    """A set's identity: two combined hashes of its distinct members and their number."""
    return [F.bit_xor(F.xxhash64(c)).alias("a"), F.bit_xor(F.xxhash64(c, F.lit(1))).alias("b"), F.count(c).alias("c")]


def _met(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """left joined with right, one row a key: broadcast if it is small, else with left's frequent keys dealt into parts."""
    if table_bytes(right) <= BROADCAST_BYTES:
        return left.join(F.broadcast(right), key)
    counted = left.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return join_by_count(left, materialise(right.join(counted, key), "benchmark-counted"), key, "_rows", spread).drop("_rows")


def _covered(spans: Column) -> Column:
    """Words in the union of the spans (start, length)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        F.array_sort(spans),
        zero,
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["length"]).alias("end"), (a["n"] + F.greatest(s["start"] + s["length"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"],
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Every window of ``window`` words holds several grams of window // 2 + 1
    words; the least hash of them stands for the window, and neighbouring
    windows mostly share it, so about one word in three leaves a fingerprint.
    A window that a text and an item share has the same least hash in both, so
    none is lost. Distinct fingerprints of documents meet the benchmark's;
    only texts with one that is met are read again, and their fingerprints
    extend to the windows that they stand for, which meet the distinct windows
    by the hashes of two grams that cover them. Items of fewer words are
    windows of their own length, found alike.

    Windows with the same items form one class, known by combined hashes, and
    documents with the same classes are worked out once, so no pair of window
    and item is made for each document. Documents meet their result by a digest
    of the text, so copies are one. Hashes have 64 bits; a false window needs
    two of them to agree by chance.

    Null and empty texts have no words; a null item id marks words but isn't
    listed; repeated item ids count once, repeated documents are each
    returned; a text without a window, an empty benchmark and an empty table
    give no hits. Very long texts are read whole. Extra columns aren't read.
    """
    spans = benchmark_windows(benchmark, window, item_col, item_text)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.substring(F.sha2(F.col(text_col).cast("string").cast("binary"), 256), 1, 40)).alias("key"), F.col(text_col).cast("string").alias("text"))
    own = texts.select("doc_id", "key", F.coalesce(F.size(F.array_remove(F.split("text", GAP), "")), F.lit(0)).cast("long").alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    if spans is None:
        return own.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), none.alias("items_sha256"), F.lit(False).alias("contaminated"))
    spans = materialise(spans, "benchmark-windows")
    windows = materialise(spans.groupBy("win").agg(*_xor("item")).select("win", F.struct("a", "b", "c").alias("class")), "benchmark-classes")
    prints = materialise(spans.select(F.explode("x").alias("x")).distinct(), "benchmark-prints")
    lengths = sorted(r[0] for r in spans.select("length").distinct().collect())

    texts = texts.where("text is not null")
    prints_met = _met(fingerprints(texts.select("key", "text"), lengths, "text"), prints, "x", "key")
    some = materialise(prints_met.groupBy("key").agg(F.count(F.lit(1)).alias("_n")), "texts-met")
    near = join_by_count(texts.select("key", "text", F.xxhash64("doc_id").alias("_spread")), some, "key", "_n", "_spread", "left_semi").select("key", "text")
    near = runs(near, lengths, "text").select("key", "place", "length", F.posexplode("wins").alias("j", "win")).where("win is not null")
    hits = _met(near, windows, "win", "key").groupBy("key", (F.col("place") + F.col("j")).alias("start"), "length", "class").agg(F.count(F.lit(1)).alias("copies"))
    hits = materialise(hits, "window-hits")

    per_text = hits.groupBy("key").agg(_covered(F.collect_set(F.struct("start", "length"))).alias("n_hit"), F.max("copies").alias("_rows"))
    listed = materialise(hits.where("class.c > 0").select("key", "class").distinct(), "text-classes")
    sets = listed.groupBy("key").agg(*_xor("class")).select("key", F.struct("a", "b", "c").alias("set"))
    sets = materialise(sets, "text-sets")
    first = sets.groupBy("set").agg(F.min("key").alias("key"))
    shown = windows.groupBy("class").agg(F.min("win").alias("win"))
    members = spans.where("item is not null").join(shown, "win").select("class", "item")
    lists = listed.join(first, "key").select("set", "class").join(members, "class").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lists = materialise(lists.select("set", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "item-lists")
    found = per_text.join(sets.join(broadcast_if_small(lists), "set"), "key", "left").select("key", "n_hit", "n_items", "items_sha256", "_rows")
    joined = join_by_count(own, materialise(found, "text-hits"), "key", "_rows", "doc_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", none).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = rf"regexp_extract_all({_LOW}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"
SQL = rf"""
WITH b AS (SELECT item_id, {_SPLIT} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i) WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
p AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM bw), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
m AS (SELECT r, i, p.n, item_id FROM p JOIN bw ON p.g = bw.g AND p.n = bw.n),
h AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT r, i, n FROM m), LATERAL (SELECT unnest(range(i, i + n)) AS place) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
