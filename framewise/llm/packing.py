"""Best-fit packing of token pieces with a swap-based local search."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pieces that are packed together; each such chunk may end in one underfull sequence.
CHUNK = 1 << 16
#: Bytes of a worker's cache of encoded words, at most about.
CACHE = 64 << 20
#: Bytes of text that are encoded together, about.
SLICE = 8 << 20
#: Largest code point of the words that the fast encoder takes; other words go to the tokenizers library.
PLAIN = "ɏ"
#: Words of such characters that hold no white space.
SIMPLE = "^[!-~\u00A1-\u024F]+$"


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes, by a byte-level BPE vocabulary.

    The pre-tokeniser never joins what stands before a single space with what
    follows it, so a text is cut at its single spaces and each part, with its
    leading space, is encoded once for all texts given together. Texts whose
    parts begin or end in white space (double spaces, a line end before a
    space) are encoded whole. Words are encoded by the same vocabulary's ranks;
    those with characters above U+024F by the tokenizers library itself, and so
    are texts that hold a special token's string, which becomes that token.
    Words that don't go through the ranks together are cached.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(json_path)
        self.special = [t.content.encode() for t in self.slow.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = list(map(len, ranks))
        self.fast = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        outer = self

        class Cache(dict):
            held = 0

            def __missing__(self, part: bytes) -> bytes | None:
                word = part.decode()
                found = outer.whole(" " + word) if word and not (word[0].isspace() or word[-1].isspace()) else None
                size = len(part) + len(found or b"") + 160
                self.held += size
                if self.held > CACHE:
                    self.clear()
                    self.held = size
                self[part] = found
                return found

        self.cache = Cache()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.fast.encode_ordinary(text), dtype="<u4").tobytes() if text.isascii() or max(text) <= PLAIN else self.library(text)

    def library(self, text: str) -> bytes:
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, words: pa.BinaryArray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
        """The ids of each word after a space, and which words can't stand alone.

        Words without white space are encoded as one text, and the lengths of
        its tokens tell where each word ends.
        """
        plain = pc.match_substring_regex(words.cast(pa.string()), SIMPLE)
        simple, odd = words.filter(plain), words.filter(pc.invert(plain)).to_pylist()
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(simple)], pa.int32()), simple), b" ")[0].as_py().decode()
        ids = np.asarray(self.fast.encode_ordinary(" " + text) if len(simple) else [], dtype="<u4")
        ends, size = np.cumsum(pc.binary_length(simple).to_numpy().astype(np.int64) + 1), np.cumsum(self.width[ids])
        to = np.searchsorted(size, ends) + 1
        if len(simple) and not np.array_equal(size[np.minimum(to, len(size)) - 1], ends):
            raise RuntimeError("a token goes on beyond its word")
        own = pa.Array.from_buffers(pa.large_binary(), len(simple), [None, pa.py_buffer(np.concatenate([[0], 4 * to]).astype(np.int64)), pa.py_buffer(ids)])
        known, at = list(map(self.cache.__getitem__, odd)), np.zeros(len(words), np.int64)
        mask, alone = plain.to_numpy(zero_copy_only=False), np.zeros(len(words), bool)
        at[mask], at[~mask] = np.arange(len(simple)), len(simple) + np.arange(len(odd))
        alone[~mask] = [x is None for x in known]
        return pa.concat_arrays([own, pa.array([x or b"" for x in known], pa.large_binary())]).take(pa.array(at)), alone

    def __call__(self, text: bytes) -> bytes:
        return next(self.many(pa.array([text], pa.binary())))

    def many(self, texts: pa.BinaryArray) -> Iterator[bytes]:
        """The ids of each text, null being empty. Parts of all texts are told apart and put together by Arrow; each distinct one is looked up once."""
        parts = pc.split_pattern(pc.fill_null(texts, b""), " ")
        at, flat = parts.offsets.to_numpy().astype(np.int64), parts.values
        rest = np.ones(at[-1] - at[0], bool)
        rest[at[:-1] - at[0]] = False
        coded = flat.slice(at[0], len(rest)).filter(pa.array(rest)).dictionary_encode()
        known, alone = self._words(coded.dictionary)
        joined = known.take(coded.indices)
        ends, data = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :], memoryview(joined.buffers()[2] or b"")
        lone = np.concatenate([[0], np.cumsum(alone[coded.indices.to_numpy()])])  # parts that can't stand alone
        before = at - at[0] - np.arange(len(at))
        for text, first, lo, hi in zip(texts, flat.take(pa.array(at[:-1])), before[:-1].tolist(), before[1:].tolist(), strict=True):
            first = first.as_py().decode()
            if not first and lo == hi:
                yield b""
            elif any(x in (whole := text.as_py()) for x in self.special):
                yield self.library(whole.decode())
            elif first and not first[-1].isspace() and lone[lo] == lone[hi]:
                yield self.whole(first) + bytes(data[ends[lo] : ends[hi]])
            else:
                yield self.whole(whole.decode())


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch of (id, text) in slices of about most bytes of text, a longer text alone."""
    step = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)) // most
    at = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def pieces(docs: DataFrame, vocabulary: tuple[str, str, str], length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenised documents cut into pieces: doc_id, piece, start, length, ids_crc32.

    A document is its ids and then id 0; null text is empty. Longer ones than
    length are cut; of their pieces the first may be shorter.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(*vocabulary)
        for b in (part for whole in batches for part in _slices(whole, SLICE)):
            at, piece, start, size, crc = [], [], [], [], []
            for row, ids in enumerate(encode.many(b.column(1))):
                ids += b"\0\0\0\0"
                n = len(ids) // 4
                k, begin = 0, 0
                while begin < n:
                    end = begin + (n - begin - 1) % length + 1
                    at.append(row), piece.append(k), start.append(begin), size.append(end - begin)
                    crc.append(zlib.crc32(ids[4 * begin : 4 * end]))
                    k, begin = k + 1, end
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(cut, f"doc_id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of row numbers. A bit mask of the free spaces finds the tightest bin."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        above = mask >> s
        if above:
            space = s + (above & -above).bit_length() - 1
            k = free[space].pop()
            if not free[space]:
                mask &= ~(1 << space)
            bins[k].append(i)
            left = space - s
        else:
            k, left = len(bins), capacity - s
            bins.append([i])
        if left:
            free[left].append(k)
            mask |= 1 << left
    return bins


def _sums(sizes: list[int]) -> tuple[int, int]:
    """Bit sets of the sizes and of the sums of two."""
    one = two = 0
    for s in sizes:
        two |= one << s
        one |= 1 << s
    return one, two


def _raised(bits: int, room: int) -> int:
    """Bit set of all numbers that are 1 to room above one of the set."""
    bits, width = bits << 1, 1
    while width < room:
        step = min(width, room - width)
        bits |= bits << step
        width += step
    return bits


class _Takers:
    """What the underfull bins can take: per bin the sums of one and of two pieces that an exchange with it would gain by.

    Bit sets lie with a word of all bins in one row, so a giver looks at all
    bins by the few words that its own sums stand in.
    """

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, capacity: int):
        self.bins, self.sizes, self.capacity = bins, sizes, capacity
        self.words, self.every = capacity // 64 + 1, (1 << capacity + 1) - 1
        self.one, self.two = np.zeros((self.words, len(bins)), "<u8"), np.zeros((self.words, len(bins)), "<u8")
        self.fill, self.changed, self.clock = np.zeros(len(bins), np.int64), np.zeros(len(bins), np.int64), 0
        for k in range(len(bins)):
            self.update(k)

    def _words(self, bits: int) -> np.ndarray:
        return np.frombuffer((bits & self.every).to_bytes(8 * self.words, "little"), "<u8")

    def update(self, k: int) -> None:
        own = self.sizes[self.bins[k]].tolist()
        self.fill[k], self.changed[k] = sum(own), self.clock
        room = self.capacity - int(self.fill[k])
        one, two = _sums(own) if room and own else (0, 0)
        self.one[:, k] = self._words(_raised(1 | one | two, room) if room and own else 0)
        self.two[:, k] = self._words(_raised(one, room) if room and own else 0)

    def find(self, give: int, since: int) -> int | None:
        """The fullest bin, at least as full as the giver and changed after since, that gains by an exchange with it."""
        at = np.flatnonzero((self.changed > since) & (self.fill >= self.fill[give])) if since >= 0 else slice(None)
        gains = np.zeros(len(at) if since >= 0 else len(self.bins), "<u8")
        for sums, takes in zip(_sums(self.sizes[self.bins[give]].tolist()), (self.one, self.two), strict=True):
            words = self._words(sums)
            for j in np.flatnonzero(words):
                gains |= takes[j, at] & words[j]
        found = np.flatnonzero(gains)
        found = at[found] if since >= 0 else found
        found = found[(found != give) & (self.fill[found] >= self.fill[give])]
        return int(found[np.argmax(self.fill[found])]) if len(found) else None


def local_search(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Moves, one-for-one and two-for-one exchanges between underfull bins, each raising the sum of squared fills, until none is left.

    The emptiest bins give to the fuller ones until they are empty. A giver
    that found nothing looks again only at bins that have changed since.
    """
    full = [b for b in bins if sum(sizes[i] for i in b) >= capacity]
    own = [list(b) for b in bins if sum(sizes[i] for i in b) < capacity]
    takers = _Takers(own, sizes, capacity)
    looked, moved = np.full(len(own), -1, np.int64), True
    while moved:
        moved = False
        for give in np.argsort(takers.fill, kind="stable").tolist():
            while 0 < takers.fill[give] < capacity:
                take = takers.find(give, int(looked[give]))
                if take is None:
                    looked[give] = takers.clock
                    break
                out, back = _exchange(own[give], own[take], sizes, capacity - int(takers.fill[take]))
                own[give] = [i for i in own[give] if i not in out] + list(back)
                own[take] = [i for i in own[take] if i not in back] + list(out)
                takers.clock += 1
                takers.update(give), takers.update(take)
                looked[give] = looked[take] = -1
                moved = True
    return full + [b for b in own if b]


def _exchange(give: list[int], take: list[int], sizes: np.ndarray, room: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """The exchange that fills take most: what goes there, and what comes back; None if nothing gains."""

    def choices(rows: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.array(rows, np.int64)
        if n < 2:
            return rows[:, None][: len(rows) if n else 1, :n], sizes[rows] if n else np.zeros(1, np.int64)
        a, b = np.triu_indices(len(rows), 1)
        return np.stack([rows[a], rows[b]], axis=1), sizes[rows[a]] + sizes[rows[b]]

    best, found = 0, None
    for n_out, n_back in ((1, 0), (1, 1), (2, 1), (1, 2)):
        (out, gives), (back, takes) = choices(give, n_out), choices(take, n_back)
        if best == room or not len(gives) or not len(takes):
            continue
        order = np.argsort(gives, kind="stable")
        at = np.searchsorted(gives[order], takes + room, "right") - 1
        gain = np.where(at >= 0, gives[order][at] - takes, 0)
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = int(gain[k]), (tuple(out[order[at[k]]].tolist()), tuple(back[k].tolist()))
    return found


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    full = np.flatnonzero(sizes == capacity)
    where[full] = np.arange(len(full))
    rest = np.flatnonzero(sizes < capacity)
    own = sizes[rest]
    for k, b in enumerate(local_search(best_fit(own, capacity), own, capacity)):
        rows = rest[b]
        where[rows] = len(full) + k
        offset[rows] = np.cumsum(sizes[rows]) - sizes[rows]
    return where, offset


def best_fit_packing(docs: DataFrame, vocabulary: tuple[str, str, str], length: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most length tokens.

    Returns per piece: the id, piece, start, length, ids_crc32, sequence_id,
    offset. Pieces are dealt by a hash into partitions, and each partition is
    packed in chunks of at most CHUNK pieces, so that no task holds more than
    that and every added partition costs at most about one underfull sequence.
    Equal documents, repeated ids and null ids are packed like any other rows;
    an empty or null text is the one token 0; an empty table gives no rows.
    Extra columns are not read.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, n = TaskContext.get().partitionId() << 40, [], 0

        def packed() -> pa.RecordBatch:
            nonlocal base, held, n
            t = pa.Table.from_batches(held).combine_chunks()
            where, offset = pack(t.column("length").to_numpy(), length)
            t = t.append_column("sequence_id", pa.array(where + base)).append_column("offset", pa.array(offset))
            base, held, n = base + int(where.max()) + 1, [], 0
            return t.to_batches()[0]

        for b in batches:
            while b.num_rows:
                part = b.slice(0, CHUNK - n)
                b = b.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == CHUNK:
                    yield packed()
        if n:
            yield packed()

    cut = pieces(docs, vocabulary, length, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    dealt = cut.repartition("doc_id", "piece", "start").sortWithinPartitions("doc_id", "piece", "length", "ids_crc32")
    return dealt.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def vocabulary_files() -> tuple[str, str, str]:
    """The public byte-level BPE vocabulary, as the tokenizers library and as ranks read it, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_files())
