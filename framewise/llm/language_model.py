"""Language-model scoring with an Elias-Fano n-gram trie, in levels that are memory-mapped."""

from __future__ import annotations

import io
import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, shared_dir, words
from .elias_fano import Levels, Monotone, pack, write_shared

#: Pseudo-count of the lower order under each context (Dirichlet smoothing).
KAPPA = 8.0
#: Tokens of a chunk of documents, and of a shard of the trie at most about.
CHUNK, SHARD = 1_000_000, 1_250_000
#: Bytes of the words whose hashes a worker caches, at most about.
CACHE = 24 << 20
#: Word pairs beyond this share of the tokens in the heads of the partitions are counted apart, so that no shard holds one of them.
HOT_SHARE, HOT_DOCS = 5e-4, 64
#: Hashes of the end of a text and of what stands before its first word; no word holds a blank.
END, BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b"\n end", b"\n begin"))
#: Quantised log10 probabilities down to -TOP, one byte for words and two for pairs, finer towards 0, where errors of long texts add up.
TOP, BYTE, WORD = 18.0, 255, 65535

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xD6E8FEB86659FD93)


class _WordHash(dict):
    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 130
        if self.held > CACHE:
            self.clear()
            self.held = len(word) + 130
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (before * _ODD) ^ (word * _ODD2 + (before >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * _ODD2
    return x ^ (x >> np.uint64(29))


def _tokens(text: bytes | None, cache: _WordHash) -> np.ndarray:
    own = words(text)
    out = np.empty(len(own) + 1, np.uint64)
    out[:-1] = np.fromiter(map(cache.__getitem__, own), np.uint64, len(own))
    out[-1] = END
    return out


def _before(tokens: np.ndarray) -> np.ndarray:
    """Each token's context: the token before it; after an end, BEGIN."""
    out = np.empty_like(tokens)
    out[0] = BEGIN
    out[1:] = np.where(tokens[:-1] == END, BEGIN, tokens[:-1])
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    """Ids, held-out flags and token hashes of about CHUNK tokens of whole documents at a time."""
    cache, ids, out, own, n = _WordHash(), [], [], [], 0
    for b in batches:
        for i, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            t = _tokens(text.as_py(), cache)
            ids.append(i), out.append(h), own.append(t)
            n += len(t)
            if n >= CHUNK:
                yield ids, out, own
                ids, out, own, n = [], [], [], 0
    if ids:
        yield ids, out, own


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _cut(shard: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(shard, np.arange(shards + 1))


def _hot_pairs(rows: DataFrame) -> np.ndarray:
    """Hashes of word pairs that are frequent in the heads of the partitions: at most 1 / HOT_SHARE. Only balance depends on them, and no score: they are scored as the trie would."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = (b.slice(0, HOT_DOCS) for b in itertools.islice(batches, 1))
        for _, _, own in _chunks(head):
            t = np.concatenate(own)
            k, n = np.unique(_pair(_before(t), t), return_counts=True)
            some = n > max(1, HOT_SHARE / 4 * len(t))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(k[some].view(np.int64), 0)), pa.array(np.append(n[some], len(t)).astype(np.int64)), pa.array(np.append(np.zeros(some.sum(), bool), True))], ["k", "n", "whole"])

    found = rows.mapInArrow(run, "k long, n long, whole boolean").groupBy("k", "whole").agg(F.sum("n").alias("n"))
    total = sum(r.n for r in found.where("whole").collect())
    hot = found.where(~F.col("whole") & (F.col("n") > HOT_SHARE * total)).orderBy(F.desc("n")).limit(int(1 / HOT_SHARE)).collect()
    return np.sort(np.array([r.k for r in hot], np.int64).view(np.uint64))


def _in_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions in a small sorted table, or -1."""
    if not len(table):
        return np.full(len(x), -1)
    at = np.searchsorted(table, x).clip(max=len(table) - 1)
    return np.where(table[at] == x, at, -1)


def _count_words(rows: DataFrame, hot: np.ndarray, shards: int, folder: str) -> tuple[list[tuple], np.ndarray]:
    """Level 1: per range of hashes a file with the training words and their counts. Returns (shard, words, tokens, file), and the counts of hot pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(hot), np.int64)
        for _, out, own in _chunks(batches):
            own = [t for t, h in zip(own, out, strict=True) if not h]
            if not own:
                continue
            t = np.concatenate(own)
            k, n = np.unique(t, return_counts=True)
            at = _cut(_shard(k, shards), shards)
            used = [s for s in range(shards) if at[s] < at[s + 1]]
            number, blobs = list(used), [k[at[s] : at[s + 1]].tobytes() + n[at[s] : at[s + 1]].astype(np.uint32).tobytes() for s in used]
            where = _in_sorted(_pair(_before(t), t), hot)
            seen += np.bincount(where[where >= 0], minlength=len(hot))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])
        if seen.any():
            part = -1 - TaskContext.get().partitionId() % shards
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seen.tobytes()], pa.binary())], ["shard", "blob"])

    def merge(group: pa.Table) -> pa.Table:
        s = group.column("shard")[0].as_py()
        blobs = [b.as_py() for b in group.column("blob")]
        if s < 0:
            sums = sum(np.frombuffer(b, np.int64) for b in blobs)
            return pa.table({"shard": pa.array([s], pa.int32()), "words": [0], "tokens": [0], "file": [sums.tobytes().hex()]})
        sizes = [len(b) // 12 for b in blobs]
        k = np.concatenate([np.frombuffer(b, np.uint64, m) for b, m in zip(blobs, sizes, strict=True)])
        n = np.concatenate([np.frombuffer(b, np.uint32, m, 8 * m) for b, m in zip(blobs, sizes, strict=True)]).astype(np.int64)
        order = np.argsort(k)
        k, n = k[order], n[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        k, n = k[first], np.add.reduceat(n, first)
        path = f"{folder}/words-{s}"
        write_shared(path, pack(words=Monotone.build(k), totals=Monotone.build(np.cumsum(n))))
        return pa.table({"shard": pa.array([s], pa.int32()), "words": [len(k)], "tokens": [int(n.sum())], "file": [path]})

    parts = rows.mapInArrow(run, "shard int, blob binary")
    # Counts of hot pairs (at most 1 / HOT_SHARE numbers) come once a partition and combine in parts before they meet here.
    found = parts.groupBy("shard").applyInArrow(merge, "shard int, words long, tokens long, file string").collect()
    counts = sum((np.frombuffer(bytes.fromhex(r.file), np.int64) for r in found if r.shard < 0), np.zeros(len(hot), np.int64))
    return sorted((r.shard, r.words, r.tokens, r.file) for r in found if r.shard >= 0), counts


class _Words:
    """Level 1 in use: counts of hashes, each range mapped once a worker."""

    def __init__(self, files: list[tuple], shards: int):
        self.files, self.shards = {s: f for s, _, _, f in files}, shards
        self.levels: dict[int, Levels] = {}

    def __call__(self, k: np.ndarray) -> np.ndarray:
        """k: sorted. 0 for words outside the training texts."""
        out = np.zeros(len(k), np.int64)
        at = _cut(_shard(k, self.shards), self.shards)
        for s, f in self.files.items():
            if at[s] < at[s + 1]:
                if s not in self.levels:
                    self.levels[s] = Levels.from_path(f)
                level = self.levels[s]
                where, equal = level.words.successor(k[at[s] : at[s + 1]])
                found = np.flatnonzero(equal)
                if len(found):
                    sums = level.totals.get(np.concatenate([where[found], np.maximum(where[found] - 1, 0)])).astype(np.int64)
                    a, b = sums[: len(found)], sums[len(found) :]
                    out[at[s] + found] = np.where(where[found] > 0, a - b, a)
        return out


def _quantised(log: np.ndarray, top: int) -> np.ndarray:
    """Codes of log10 probabilities, rounded so that none grows."""
    return np.minimum(np.ceil(top * np.sqrt(-log / TOP)), top)


def _decoded(codes: np.ndarray, top: int) -> np.ndarray:
    return 10 ** (-TOP * (codes.astype(np.float64) / top) ** 2)


def _codes(n: np.ndarray, above: np.ndarray) -> np.ndarray:
    """The trie's codes of a pair's count over its context's count + KAPPA."""
    return _quantised(np.log10(n / (above + KAPPA)), WORD).astype(np.uint16)


def _stored(n: np.ndarray, above: np.ndarray) -> np.ndarray:
    """What the trie gives for pairs with these counts; 0 for unseen ones."""
    out = np.zeros(len(n))
    some = n > 0
    out[some] = _decoded(_codes(n[some], above[some]), WORD)
    return out


def _ipc(table: pa.Table) -> bytes:
    with io.BytesIO() as f:
        with pa.ipc.new_stream(f, table.schema) as w:
            w.write_table(table)
        return f.getvalue()


def _requests(rows: DataFrame, files: list[tuple], shards: int, hot: np.ndarray, hot_counts: np.ndarray, word_shards: int) -> DataFrame:
    """Per chunk: the documents with what is known of them so far, and for each shard the pairs that it counts and scores."""
    total, types = sum(f[2] for f in files), sum(f[1] for f in files)
    room = total + types + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seq = _Words(files, word_shards), TaskContext.get().partitionId() << 32
        starts = int(level(np.array([END], np.uint64))[0])
        for ids, out, own in _chunks(batches):
            sizes = np.array([len(t) for t in own])
            doc = np.repeat(np.arange(len(own)), sizes)
            t = np.concatenate(own)
            k, at = np.unique(t, return_inverse=True)
            c = level(k)
            count = c[at]
            base = np.bincount(doc, np.log10((count + 1) / room), len(own))
            known = np.bincount(doc[count > 0], minlength=len(own))
            before = _before(t)
            first = np.cumsum(sizes) - sizes
            above = np.empty_like(count)
            above[1:] = count[:-1]
            above[first] = starts
            p1 = _decoded(_quantised(np.log10((count + 1) / room), BYTE), BYTE)
            add = KAPPA * p1 / (above + KAPPA)
            # Hot pairs are scored here, with the trie's quantised probabilities.
            pairs = _pair(before, t)
            where = _in_sorted(pairs, hot)
            is_hot = where >= 0
            seen = np.where(is_hot, hot_counts[where], 0) if len(hot) else np.zeros(len(t), np.int64)
            hot_part = np.bincount(doc[is_hot], np.log10(_stored(seen[is_hot], above[is_hot]) + add[is_hot]), len(own)).astype(np.float64)
            meta = pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(out, pa.bool_()), "n_tokens": pa.array(sizes.astype(np.int64)), "n_known": pa.array(known.astype(np.int64)), "base": pa.array(base), "part": pa.array(hot_part)})
            number, blobs, head = [seq % shards], [_ipc(meta)], [True]
            # A context with more than an eighth of a shard's tokens is dealt by its words too.
            cold = ~is_hot
            own_shard = _shard(np.where(above * 8 > SHARD, pairs, before * _ODD), shards)
            w32 = (t * _ODD2 >> np.uint64(32)).astype(np.uint32)
            sel = np.flatnonzero(cold)
            order = sel[np.lexsort((doc[sel], w32[sel], before[sel], own_shard[sel]))]
            s, b, w, d = own_shard[order], before[order], w32[order], doc[order]
            new = np.append(True, (b[1:] != b[:-1]) | (w[1:] != w[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1])) if len(order) else np.zeros(0, bool)
            starts_at = np.flatnonzero(new)
            times = np.diff(np.append(starts_at, len(order)))
            order, s, b, w, d = order[starts_at], s[starts_at], b[starts_at], w[starts_at], d[starts_at]
            code = _quantised(np.log10((count[order] + 1) / room), BYTE).astype(np.uint8)
            train = ~np.array(out, bool)
            cuts = _cut(s, shards)
            for x in range(shards):
                lo, hi = cuts[x], cuts[x + 1]
                if lo == hi:
                    continue
                heads = np.flatnonzero(np.append(True, b[lo + 1 : hi] != b[lo : hi - 1])) + lo
                spread = np.diff(np.append(heads, hi))
                number.append(x)
                head.append(False)
                blobs.append(
                    b"".join(
                        (
                            np.array([len(own), len(heads), hi - lo], np.int64).tobytes(),
                            b[heads].tobytes(),
                            above[order[heads]].astype(np.int64).tobytes(),
                            spread.astype(np.uint32).tobytes(),
                            w[lo:hi].tobytes(),
                            d[lo:hi].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(),
                            times[lo:hi].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(),
                            code[lo:hi].tobytes(),
                            train[d[lo:hi]].tobytes(),
                        )
                    )
                )
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array([seq] * len(number), pa.int64()), pa.array(head, pa.bool_()), pa.array(blobs, pa.binary())], ["shard", "chunk", "head", "blob"])
            seq += 1

    return rows.mapInArrow(run, "shard int, chunk long, head boolean, blob binary")


def _parse(blob: bytes) -> tuple:
    n_docs, heads, n = np.frombuffer(blob, np.int64, 3)
    at = 24
    out = []
    for kind, m in ((np.uint64, heads), (np.int64, heads), (np.uint32, heads), (np.uint32, n), (np.uint8, 4 * n), (np.uint8, 4 * n), (np.uint8, n), (np.bool_, n)):
        a = np.frombuffer(blob, kind, m, at)
        at += a.nbytes
        out.append(a)
    for k in (4, 5):
        out[k] = np.ascontiguousarray(out[k].reshape(4, n).T).view("<u4").ravel()
    return int(n_docs), out


def _build(before: np.ndarray, word: np.ndarray, times: np.ndarray, above: np.ndarray) -> Levels:
    """Levels of a shard's training pairs (sorted by context, then word; repeated ones in a row).

    contexts: their hashes; pointers: where the successors of each begin;
    successors: their hashes made monotone by the context's rank;
    probability: log10 of count over (context's count + KAPPA), in two bytes.
    """
    new = np.append(True, (before[1:] != before[:-1]) | (word[1:] != word[:-1])) if len(before) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    n = np.add.reduceat(times, first) if len(first) else times
    b, w, a = before[first], word[first], above[first]
    heads = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
    rank = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(b))))
    code = _codes(n, a)
    return Levels.from_bytes(
        pack(
            contexts=Monotone.build(b[heads]),
            pointers=Monotone.build(np.append(heads, len(b)).astype(np.uint64)),
            successors=Monotone.build(rank.astype(np.uint64) << np.uint64(32) | w),
            probability=code,
        )
    )


def _look_up(trie: Levels, before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Stored probabilities of pairs, 0 for those that training didn't see. before: sorted."""
    out = np.zeros(len(word))
    heads = np.flatnonzero(np.append(True, before[1:] != before[:-1])) if len(before) else np.zeros(0, np.int64)
    rank, known = trie.contexts.successor(before[heads])
    spread = np.diff(np.append(heads, len(before)))
    rank, known = np.repeat(rank, spread), np.repeat(known, spread)
    some = np.flatnonzero(known)
    if len(some):
        at, equal = trie.successors.successor(rank[some].astype(np.uint64) << np.uint64(32) | word[some])
        end = trie.pointers.get(rank[some] + 1).astype(np.int64)
        hit = equal & (at < end)
        out[some[hit]] = _decoded(trie.probability[at[hit]], WORD)
    return out


def _score_shard(group: pa.Table) -> pa.Table:
    chunks, heads, out = [], [], []
    parts = []
    for chunk, head, blob in zip(group.column("chunk").to_pylist(), group.column("head").to_pylist(), group.column("blob"), strict=True):
        if head:
            chunks.append(chunk), heads.append(True), out.append(blob.as_py())
        else:
            parts.append((chunk, *_parse(blob.as_py())))
    if parts:
        before = np.concatenate([np.repeat(p[2][0], p[2][2]) for p in parts])
        above = np.concatenate([np.repeat(p[2][1], p[2][2]) for p in parts])
        word, times, code, train = (np.concatenate([p[2][k] for p in parts]) for k in (3, 5, 6, 7))
        sizes = [len(p[2][3]) for p in parts]
        order = np.lexsort((word, before))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        before, word, above = before[order], word[order], above[order]
        t = train[order]
        trie = _build(before[t], word[t], times[order][t].astype(np.int64), above[t])
        new = np.append(True, (before[1:] != before[:-1]) | (word[1:] != word[:-1]))
        first = np.flatnonzero(new)
        stored = _look_up(trie, before[first], word[first])[np.cumsum(new) - 1]
        p = stored + KAPPA * _decoded(code[order], BYTE) / (above + KAPPA)
        value = (np.log10(p))[back] * times
        at = 0
        for (chunk, n_docs, cols), m in zip(parts, sizes, strict=True):
            doc = cols[4].astype(np.int64)
            sums = np.bincount(doc, value[at : at + m], n_docs)
            at += m
            some = np.flatnonzero(sums).astype(np.uint32)
            chunks.append(chunk), heads.append(False), out.append(some.tobytes() + sums[some].tobytes())
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "head": pa.array(heads, pa.bool_()), "blob": pa.array(out, pa.binary())})


def _join_chunk(group: pa.Table) -> pa.Table:
    table, parts = None, []
    for head, blob in zip(group.column("head").to_pylist(), group.column("blob"), strict=True):
        if head:
            table = pa.ipc.open_stream(blob.as_py()).read_all()
        else:
            parts.append(blob.as_py())
    score = table.column("part").to_numpy().copy()
    for b in parts:
        n = len(b) // 12
        score[np.frombuffer(b, np.uint32, n)] += np.frombuffer(b, np.float64, n, 4 * n)
    return table.select(["doc_id", "held_out", "n_tokens", "n_known", "base"]).append_column("score", pa.array(score))


def score_documents(docs: DataFrame, out_of_training: str = "held_out", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Log10 probabilities of whole texts under a model of those rows of docs that aren't held out.

    Tokens are words with A-Z lowered, then one end. Unigrams: (count + 1) /
    (N + V + 1). Pairs: (count of the pair + KAPPA * unigram) / (count of the
    context + KAPPA), which sums to 1 (both are rounded down in it, so to
    a little less). Level 1 (words and their counts) lies in files by
    ranges of hashes in the shared folder and is memory-mapped by every
    worker; level 2 lies in shards by context, each built, mapped and searched
    where its pairs meet. Frequent contexts are dealt by their words too, and
    very frequent pairs are counted apart and scored alike, so that scores
    don't depend on how rows are partitioned. Words of one context are told
    apart by 32 bits of their hashes: of 100,000 unlike words after one word
    about one pair is taken for one. Null and empty texts are the one
    end token; repeated rows count and score each by itself; a null flag
    counts as not held out; an empty table gives no rows; extra columns are
    not read. Returns doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(out_of_training), F.lit(False)).alias("held_out"), F.col(text_col).cast("string").cast("binary").alias("text"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = _hot_pairs(rows)
    files, hot_counts = _count_words(rows, hot, shards, f"{shared_dir(spark)}/words-{uuid.uuid4().hex}")
    total = sum(f[2] for f in files)
    level2 = max(shards, math.ceil(total / SHARD))
    scored = _requests(rows, files, level2, hot, hot_counts, shards).groupBy("shard").applyInArrow(_score_shard, "chunk long, head boolean, blob binary")
    found = scored.groupBy("chunk").applyInArrow(_join_chunk, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_documents(docs.withColumn("held_out", held_out("doc_id", 7)))
