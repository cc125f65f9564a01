"""Near-duplicate groups by b-bit MinHash."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import broadcast_if_small, join_by_count, materialise, sorted_runs, words

WORDS = 5
#: Minima of a signature, in bands of ROWS; of each minimum BITS bits are kept for the estimate.
MINIMA, ROWS, BITS = 128, 5, 2
BANDS = MINIMA // ROWS
#: Standard deviations by which the estimate may fall short of the threshold before a candidate is let go.
SLACK = 5
#: Members that are compared beside one copy of a hub's text; members of a block of a bucket; members of a side of a tile of two blocks.
GROUP, BLOCK, TILE = 64, 4096, 256
#: Shingles that are compared at once in a tile.
COLUMNS = 4096
#: Bytes of the words whose hashes a worker caches, at most about.
CACHE = 24 << 20

_rng = np.random.default_rng(1)
_MUL = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, MINIMA, dtype=np.uint64)
_STEP = _rng.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEED = _rng.integers(0, 2**63, BANDS, dtype=np.uint64)


class _WordHash(dict):
    held = 0

    def __missing__(self, word: bytes) -> int:
        self.held += len(word) + 130
        if self.held >= CACHE:
            self.clear()
            self.held = len(word) + 130
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, cache: dict[bytes, int] | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; of fewer words than a shingle has, one for the whole."""
    own = words(text)
    if not own:
        return np.zeros(0, np.uint64)
    if len(own) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=len(own))], np.uint64)
    h = np.fromiter(map((cache if cache is not None else _WordHash()).__getitem__, own), np.uint64, len(own))
    n = len(own) - WORDS + 1
    total = h[:n] * _STEP[0]
    for j in range(1, WORDS):
        total += h[j : n + j] * _STEP[j]
    return np.unique(_mix(total))


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def signature(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of the minima's low bits (BITS x MINIMA / 64 words), and the band keys."""
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 2048):
        np.minimum(least, (own[k : k + 2048, None] * _MUL + _ADD).min(axis=0), out=least)
    low = _mix(least)
    planes = [np.packbits((low >> np.uint64(b) & np.uint64(1)).astype(np.uint8)).view(np.uint64) for b in range(BITS)]
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    return np.concatenate(planes), _mix((rows * _BAND).sum(axis=1, dtype=np.uint64) + _SEED)


def signatures(docs: DataFrame) -> DataFrame:
    """docs: doc_id long, text binary. Adds n_shingles, set_key (digest of the set), planes and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        for b in batches:
            n, keys, planes, bands = [], [], [], []
            for text in b.column(1):
                own = shingles(text.as_py(), cache)
                n.append(len(own))
                keys.append(_digest(own) if len(own) else None)
                p, k = signature(own) if len(own) else (None, None)
                planes.append(None if p is None else p.view(np.int64))
                bands.append(None if k is None else k.view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(planes, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_key", "planes", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, planes array<long>, bands array<long>")


def least_estimate(percent: int) -> float:
    """The estimate that a pair at the threshold falls under by chance only beyond SLACK deviations."""
    chance = 0.5**BITS
    p = percent / 100 + (1 - percent / 100) * chance
    return percent / 100 - SLACK * math.sqrt(p * (1 - p) / MINIMA) / (1 - chance)


def estimate(a: str, b: str):
    """Similarity by bit counts over the planes, corrected for chance agreement of BITS bits."""
    n = MINIMA // 64
    same = sum((F.bit_count(F.bitwise_not(_any_differ(a, b, w, n))) for w in range(n)), F.lit(0))
    return (same / MINIMA - 0.5**BITS) / (1 - 0.5**BITS)


def _any_differ(a: str, b: str, word: int, n: int):
    differ = None
    for bit in range(BITS):
        k = bit * n + word
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        differ = x if differ is None else differ.bitwiseOR(x)
    return differ


def shared_buckets(heads: DataFrame) -> DataFrame:
    """(key, node, hub) of the buckets with several nodes. heads: materialised (node, bands).

    Only a key and a node are shuffled for each band.
    """
    keyed = heads.select("node", F.explode("bands").alias("key"))
    sizes = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1"), "near-sizes")
    return materialise(join_by_count(keyed, sizes, "key", "n", "node").select("key", "node", "hub"), "near-shared")


def hub_pairs(shared: DataFrame, heads: DataFrame, least: float) -> DataFrame:
    """(a, b): each bucket's smallest node with the others whose estimate reaches least. A pair is there once, whatever buckets it shares."""
    pairs = materialise(shared.where("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "near-met")
    planes = heads.select(F.col("node").alias("b"), F.col("planes").alias("q"))
    hubs = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).join(heads.select(F.col("node").alias("a"), F.col("planes").alias("p")), "a")
    met = join_by_count(pairs.join(planes, "b"), materialise(hubs, "near-hubs"), "a", "n", "b")
    return materialise(met.where(estimate("p", "q") >= least).select("a", "b"), "near-pairs")


def with_texts(members: DataFrame, heads: DataFrame, docs: DataFrame) -> DataFrame:
    """members (node and more) with text and set_key: a text of one of the node's rows, and of rows of other sets under the same id, which set_key tells apart."""
    named = members.join(heads.select("node", "id", "set_key"), "node")
    ids = materialise(named.select(F.col("id").alias("doc_id")).distinct(), "near-ids")
    texts = docs.join(broadcast_if_small(ids), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text")
    return named.join(texts, "id").drop("id")


def confirm(pairs: DataFrame, heads: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold.

    A task streams over hubs: one copy of a hub's text, then up to about GROUP
    members' texts, one at a time.
    """
    hubs = materialise(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "near-fans")
    parts = F.ceil(F.col("n") / GROUP).cast("int")
    members = join_by_count(pairs, hubs, "a", "n", "b").select("a", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"), F.col("b").alias("node"))
    first = hubs.select("a", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("a").alias("node"))
    rows = with_texts(members.unionAll(first), heads, docs).withColumn("member", F.col("node") != F.col("a"))
    dealt = rows.select("a", "part", "member", "node", "set_key", "text").repartition("a", "part").sortWithinPartitions("a", "part", "member", "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, at, hub = _WordHash(), None, None
        for batch in batches:
            here = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            node, key, found = batch.column(3).to_pylist(), batch.column(4).to_pylist(), []
            for k, text in enumerate(batch.column(5)):
                own = shingles(text.as_py(), cache)
                if _digest(own) != key[k]:
                    continue  # another text of this id
                if node[k] == here[k][0]:
                    at, hub = here[k], own
                elif at == here[k] and _near(len(np.intersect1d(own, hub, assume_unique=True)), len(own), len(hub), percent):
                    found.append((at[0], node[k]))
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return materialise(dealt.mapInArrow(check, "a long, b long").distinct(), "near-links")


def _near(both, one, other, percent: int):
    return (both > 0) & (100 * both >= percent * (one + other - both))


def mixed_rows(shared: DataFrame, heads: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that hold several components: key, n, node, component, planes, bands (their low halves)."""
    marked = materialise(shared.select("key", "node").join(labels.withColumnRenamed("id", "node"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "near-marked")
    sizes = marked.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x < y").select("key", "n")
    rest = join_by_count(marked, materialise(sizes, "near-mixed"), "key", "n", "node")
    low = F.transform("bands", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int"))
    return rest.join(heads.select("node", "planes", low.alias("bands")), "node").select("key", "n", "node", "component", "planes", "bands")


def tile_members(rest: DataFrame, least: float) -> DataFrame:
    """Members of tiles that hold candidates: key, x, y, tile, node, component. rest: as mixed_rows gives it.

    A bucket is dealt into blocks of about BLOCK members; each pair of blocks
    is a cell that holds its rows once, and is worked on in tiles of TILE rows
    a side, so that no task holds a whole bucket. A pair is a candidate where
    its estimate reaches least, its components differ and no earlier band is
    shared: once in all buckets. Members come out, not pairs: at most two
    sides of a tile.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rest.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = dealt.select("key", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "component", "node", "planes", "bands")
    cells = cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "block", "component", "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in sorted_runs(batches, 3):
            node, component = t.column("node").to_numpy(), t.column("component").to_numpy()
            key, x, y = (t.column(c)[0].as_py() for c in range(3))
            planes = _matrix(t.column("planes"), np.int64).view(np.uint64)
            bands = _matrix(t.column("bands"), np.int32)
            band = int(np.argmax(bands[0] == np.int64(key).astype(np.int32)))
            half = int(np.searchsorted(t.column("block").to_numpy(), y)) if x < y else 0
            tile, out = 0, []
            for i in range(0, half or len(node), TILE):
                for j in range(half or i, len(node), TILE):
                    a, b = slice(i, min(i + TILE, half) if half else i + TILE), slice(j, j + TILE)
                    members = _candidates(planes, component, bands, a, b, band, least)
                    if len(members):
                        out.append((np.full(len(members), tile), members))
                    tile += 1
            if out:
                tiles, rows = (np.concatenate(c) for c in zip(*out, strict=True))
                head = [pa.array(np.full(len(rows), v), k) for v, k in ((key, pa.int64()), (x, pa.int32()), (y, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*head, pa.array(tiles, pa.int32()), pa.array(node[rows]), pa.array(component[rows])], ["key", "x", "y", "tile", "node", "component"])

    return materialise(cells.mapInArrow(meet, "key long, x int, y int, tile int, node long, component long"), "near-tiles")


def _matrix(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy() for c in column.chunks]).astype(kind, copy=False).reshape(len(column), -1)


def _candidates(planes: np.ndarray, component: np.ndarray, bands: np.ndarray, a: slice, b: slice, band: int, least: float) -> np.ndarray:
    """Row numbers that are in candidate pairs of two sides of a tile."""
    ca, cb = component[a], component[b]
    if ca[0] == ca[-1] == cb[0] == cb[-1]:  # rows are ordered by component
        return np.zeros(0, np.int64)
    n = MINIMA // 64
    same = np.full((len(ca), len(cb)), MINIMA, np.int64)
    for w in range(n):
        differ = np.zeros((len(ca), len(cb)), np.uint64)
        for bit in range(BITS):
            differ |= planes[a, None, bit * n + w] ^ planes[None, b, bit * n + w]
        same -= np.bitwise_count(differ)
    chance = 0.5**BITS
    i, j = np.nonzero(((same / MINIMA - chance) / (1 - chance) >= least) & (ca[:, None] != cb[None, :]))
    i, j = i + a.start, j + b.start
    i, j = i[i < j], j[i < j]
    new = ~(bands[i, :band] == bands[j, :band]).any(axis=1)
    return np.unique(np.concatenate([i[new], j[new]]))


def confirm_tiles(members: DataFrame, heads: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components among the members of each tile, confirmed on full sets: fewer than members."""
    rows = with_texts(members, heads, docs).select("key", "x", "y", "tile", "node", "component", "set_key", "text")
    dealt = rows.repartition("key", "x", "y", "tile").sortWithinPartitions("key", "x", "y", "tile", "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHash()
        for t in sorted_runs(batches, 4):
            node, component, sets, seen = [], [], [], set()
            for k, (i, c, key) in enumerate(zip(*(t.column(x).to_pylist() for x in ("node", "component", "set_key")), strict=True)):
                own = shingles(t.column("text")[k].as_py(), cache)
                if i not in seen and _digest(own) == key:
                    node.append(i), component.append(c), sets.append(own), seen.add(i)
            links = [(node[i], node[j]) for i, j in links_between(sets, np.array(component), percent)]
            a, b = zip(*links, strict=True) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return materialise(dealt.mapInArrow(check, "a long, b long"), "near-links")


def links_between(sets: list[np.ndarray], component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Row pairs of unlike components that reach the threshold, without those that others join already.

    Shared shingles of all pairs are counted by products of 0/1 matrices, a
    bounded number of shingles at a time.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    both = np.zeros((m, m))
    if m > 1:
        row = np.repeat(np.arange(m), size)
        _, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        some = times[col] > 1
        row, col = row[some], (np.cumsum(times > 1) - 1)[col[some]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        top = int(col[-1]) + 1 if len(col) else 0
        for first in range(0, top, COLUMNS):
            at = slice(*np.searchsorted(col, [first, first + COLUMNS]))
            one = np.zeros((m, min(COLUMNS, top - first)), np.float32)
            one[row[at], col[at] - first] = 1
            both += one @ one.T
    i, j = np.nonzero(np.triu(_near(both, size[:, None], size[None, :], percent) & (component[:, None] != component[None, :]), 1))
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    found = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(int(component[x])), find(int(component[y]))
        if p != q:
            root[p] = q
            found.append((x, y))
    return found


def near_groups(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components: doc_id, n_shingles, component_id, kept, one row per row of docs.

    Documents are linked when 100 * shared shingles >= percent * all shingles
    of both. Equal sets are one node. Nodes that share a band of minima are
    candidates: first every bucket's smallest node with the rest of its bucket;
    then, in buckets that still hold several components, all pairs across
    components in blocks. The b-bit estimate sorts candidates out, and links
    are confirmed on the full sets. component_id is the smallest id reachable.
    Null and empty texts and null ids are linked with nothing; rows that
    repeat an id are linked each by its own text, so an id may have several
    components; equal rows are one node; an empty table gives no rows; extra
    columns are not read. Long texts are compared whole.

    A pair at the threshold shares no band with a chance of
    (1 - (percent / 100) ** ROWS) ** BANDS: 4e-7 at 85, 5e-5 at 80.
    """
    least = least_estimate(percent)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    own = materialise(signatures(plain), "near-signatures")
    some = own.where("set_key is not null and doc_id is not null")
    heads = some.groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("planes").alias("planes"), F.first("bands").alias("bands"))
    heads = materialise(heads.withColumn("node", F.monotonically_increasing_id()), "near-heads")  # the numbers hold from here on

    shared = shared_buckets(heads)
    edges = confirm(hub_pairs(shared, heads, least), heads, plain, percent)
    labels = connected_components(edges, "a", "b")
    more = confirm_tiles(tile_members(mixed_rows(shared, heads, labels), least), heads, plain, percent)
    if not more.isEmpty():
        labels = connected_components(edges.unionAll(more), "a", "b")

    named = heads.select("node", "set_key", "id", "n").join(labels.withColumnRenamed("id", "node"), "node", "left")
    named = materialise(named.select("set_key", "id", "n", F.coalesce("component", "node").alias("component")), "near-named")
    least_ids = named.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = materialise(named.join(least_ids, "component").select("set_key", "n", "component_id"), "near-classes")
    found = join_by_count(some.select("doc_id", "n_shingles", "set_key"), classes, "set_key", "n", "doc_id").select("doc_id", "n_shingles", "component_id")
    alone = own.where("set_key is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)
