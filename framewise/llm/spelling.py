"""Spelling variants: words one edit away from a far more frequent word, by a rare-first q-gram prefix filter."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, join_by_count, materialise

#: Code points and occurrences that a word has at least; how many times as frequent its form is.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One run in so many loses a code point.
TYPO = 31
#: Rarest bigrams of a word that are joined: one edit changes at most two.
PREFIX = 3
#: Words of a cell that one task compares at once; larger cells are cut finer.
CELL = 4096
#: Bytes of the words that a task counts before it hands them on, at most about; rows of a batch.
HELD, ROWS = 24 << 20, 32_768
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode()) - (1 << 63)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of the words of each text, summed up within a task as far as HELD goes."""
    held, total = 0, Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    for b in batches:
        for ident, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if ident is None else ident}:".encode())
            for w, n in Counter(_RUN.findall((text or b"").translate(LOWER).decode("utf-8", "replace"))).items():
                if len(w) >= LEAST_LENGTH:
                    h = zlib.crc32(w.encode(), start)
                    if h % TYPO == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < LEAST_LENGTH:
                            continue
                    if w not in total:
                        held += 2 * len(w) + 130
                    total[w] += n
            if held > HELD:
                yield out()
                held, total = 0, Counter()
    if total:
        yield out()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n, over all documents: runs of letters, of which one in TYPO loses a code point by the hash of id and run."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _bigram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = Counter()
    for b in batches:
        for w in b.column(0).to_pylist():
            total.update(map(str.__add__, w, w[1:]))
    yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["gram", "n"])


def rarest(word: str, rank: dict[str, int]) -> list[tuple[str, int]]:
    """The (bigram, place) of the PREFIX rarest bigrams of a word; of equal ones those that stand first."""
    return [(g, p) for _, p, g in nsmallest(PREFIX, ((rank[g], p, g) for p, g in enumerate(map(str.__add__, word, word[1:]))))]


#: Sides of a cell: words of one length among themselves, a shorter word, a word longer by one.
SAME, SHORT, LONG = 0, 1, 2


def _cells(rank: dict[str, int]):
    """Puts a word into the cells of its rarest bigrams, places and lengths: a cell's shorter words meet those longer by one at the same place or the next."""

    def keys(word: str, n: int) -> Iterator[tuple]:
        for g, p in rarest(word, rank):
            yield _hash("=", g, p, len(word)), SAME, word, n
            yield _hash("<", g, p, len(word)), SHORT, word, n
            yield _hash("<", g, p, len(word) - 1), LONG, word, n
            yield _hash("<", g, p - 1, len(word) - 1), LONG, word, n

    return keys


def _halves(cell: int, side: int, word: str, n: int) -> Iterator[tuple]:
    """One edit leaves the first or the second half as it is."""
    at = (len(word) - (side == LONG)) // 2
    yield _hash(cell, 1, word[:at]), side, word, n
    yield _hash(cell, 2, word[at + (side == LONG) :]), side, word, n


def _deletions(cell: int, side: int, word: str, n: int) -> Iterator[tuple]:
    """What is left of a word without one code point, by place; a shorter word is what is left of a longer one. No more words share it than there are letters and places."""
    if side == SHORT:
        yield _hash(cell, word), side, word, n
        return
    for i in range(len(word)):
        yield _hash(cell, word[:i] + word[i + 1 :], *(() if side == LONG else (i,))), side, word, n


def _mapped(df: DataFrame, keys) -> DataFrame:
    """Rows (cell, side, word, n) that keys makes of each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for k in keys(*row):
                    held.append(k)
                    size += len(k[2]) + 64
                    if size >= HELD // 4 or len(held) >= ROWS:
                        yield out(held)
                        held, size = [], 0
        if held:
            yield out(held)

    def out(held: list[tuple]) -> pa.RecordBatch:
        cell, side, word, n = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(side, pa.int32()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["cell", "side", "word", "n"])

    return df.mapInArrow(run, "cell long, side int, word string, n long")


def _split(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None]:
    """rows whose cell holds up to CELL words, and the others, if there are any."""
    full = materialise(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CELL), f"{name}-full")
    if full.isEmpty():
        return rows, None
    marked = join_by_count(rows, full, "cell", "size", "word", "left")
    return marked.where("size is null").drop("size"), marked.where("size is not null").drop("size")


def one_edit(a: str, b: str) -> bool:
    """Whether two words, the first not longer, differ by exactly one replaced or inserted code point."""
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and a[i + (len(a) == len(b)) :] == b[i + 1 :]


def _near(same: list[str], short: list[str], long: list[str]) -> Iterator[tuple[str, str]]:
    """The near pairs of a cell, in time linear in its words: these are looked up by what is left of them without one code point. Few or very long words are compared one by one."""
    if len(same) <= len(same[0] if same else ""):
        yield from ((a, b) for k, a in enumerate(same) for b in same[:k] if one_edit(a, b))
    else:
        left: dict[int, list[str]] = {}
        for w in same:
            for i in range(len(w)):
                others = left.setdefault(hash((i, w[:i], w[i + 1 :])), [])
                yield from ((w, v) for v in others if one_edit(w, v))
                others.append(w)
    if short and len(short) <= len(short[0]):
        yield from ((a, b) for b in long for a in short if one_edit(a, b))
    elif short:
        known = set(short)
        for w in long:
            yield from ((v, w) for v in {w[:i] + w[i + 1 :] for i in range(len(w))} if v in known)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The near pairs of each cell, of rows that are sorted by it; only one cell is held."""
    found: list[tuple] = []

    def flush(held: dict[str, int], sides: tuple[list[str], ...]) -> None:
        found.extend((*sorted(p), *(held[w] for w in sorted(p))) for p in _near(*sides))

    def out() -> pa.RecordBatch:
        a, b, na, nb = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(na, pa.int64()), pa.array(nb, pa.int64())], ["a", "b", "na", "nb"])

    at, held, sides = None, {}, ([], [], [])
    for b in batches:
        for cell, side, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if cell != at:
                if len(held) > 1:
                    flush(held, sides)
                    if len(found) >= ROWS:
                        yield out()
                        found.clear()
                at, held, sides = cell, {}, ([], [], [])
            if word not in sides[side][-1:]:
                held[word] = n
                sides[side].append(word)
    if len(held) > 1:
        flush(held, sides)
    if found:
        yield out()


def _pairs(rows: DataFrame) -> DataFrame:
    """Near pairs (a, b, na, nb) of words that meet in a cell, once for each cell."""
    return rows.select("cell", "side", "word", "n").repartition("cell").sortWithinPartitions("cell", "side", "word").mapInArrow(_compare, "a string, b string, na long, nb long")


def near_words(counts: DataFrame) -> DataFrame:
    """The distinct pairs (a, b, na, nb) of words (word, n) that differ by one inserted, deleted or replaced code point. counts: materialised.

    Bigrams are ordered by the number of words that have them (the driver holds
    this order; letters bound it to about 8,100 entries). One edit changes two
    bigrams at most and moves the others by one place at most, so two near
    words share one of their three rarest at the same place or the next. Only
    those are joined, in cells of bigram, place and length, and the words of a
    cell are verified by exact comparison. A cell of more than CELL words is
    cut by unchanged halves of words, and by words without one code point
    where that isn't enough; near words meet in each of these.
    """
    grams = counts.select("word").mapInArrow(_bigram_counts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    rank = {g: k for k, (_, g) in enumerate(sorted((n, g) for g, n in grams))}
    rows, out = materialise(_mapped(counts.select("word", "n"), _cells(rank)), "spelling-cells"), None
    for finer in (_halves, _deletions, None):
        few, many = _split(rows, "spelling-cells") if finer else (rows, None)
        out = _pairs(few) if out is None else out.unionAll(_pairs(few))
        if many is None:
            break
        rows = materialise(_mapped(many.select("cell", "side", "word", "n"), finer), "spelling-cells")
    return out.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, of forms (word, form) that are followed to the last: pointers double each round, so rounds grow with the logarithm of the longest chain."""
    at = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        asked = at.groupBy("root").agg(F.count(F.lit(1)).alias("rows"))
        steps = at.select(F.col("word").alias("root"), F.col("root").alias("next")).join(asked, "root")
        steps = materialise(steps, "spelling-steps")
        if steps.isEmpty():
            return at
        at = materialise(join_by_count(at, steps, "root", "rows", "word", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are counted over the whole texts of all documents. A word's form is
    its near word of largest n (of equal ones the first in code-point order)
    where that n is RATIO times the word's at least; root follows forms to the
    last. Null and empty texts have no words, a null id counts as an empty
    one, repeated rows count as often as they stand there, very long runs are
    words like others, and empty tables give no rows. Extra columns aren't read.
    """
    counts = materialise(word_counts(docs, id_col, text_col), "spelling-words")
    pairs = materialise(near_words(counts), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("own"), F.col("b").alias("near"), F.col("nb").alias("n"))
    both = both.unionAll(pairs.select(F.col("b"), F.col("nb"), F.col("a"), F.col("na")))
    best = both.groupBy("word", "own").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "near")).alias("best"))
    far = -F.col("best.m") >= RATIO * F.col("own")
    best = materialise(best.select("word", "n_near", F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.m")).alias("form_n")), "spelling-forms")
    ends = roots(best.where("form is not null").select("word", "form"))
    found = counts.join(best, "word", "left").join(ends, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = rf"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce([1, 2, 3, 4, 5, 6, 7, 8], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, k) AS v FROM range(256) AS r(k))),
low AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents),
runs AS (SELECT id, w, count(*) AS n, list_concat(list_transform(string_split(id || ':', ''), lambda c: ord(c)), flatten(list_transform(string_split(w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END))) AS bytes FROM low WHERE length(w) >= {LEAST_LENGTH} GROUP BY id, w),
hashed AS (SELECT w, n, xor(list_reduce(bytes, lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM runs, tab),
typed AS (SELECT CASE WHEN h % {TYPO} = 0 THEN substring(w, 1, CAST(h % length(w) AS BIGINT)) || substring(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cut AS (SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS x FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
pair AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.x = b.x AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.x = b.word UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.x = b.word),
best AS (SELECT p.word, count(*) AS n_near, min((-w.n, near)) AS b FROM pair p JOIN words w ON w.word = near GROUP BY p.word),
form AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= {RATIO} * n THEN b[2] END AS form, CASE WHEN -b[1] >= {RATIO} * n THEN -b[1] END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, 0 AS d FROM words UNION ALL SELECT walk.word, form.form, d + 1 FROM walk JOIN form ON form.word = walk.here WHERE form.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, d) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM form JOIN ends USING (word)
"""
