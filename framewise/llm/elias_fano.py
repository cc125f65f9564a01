"""Elias-Fano sequences and n-gram trie levels in memory-mapped files."""

from __future__ import annotations

import io
import json
import mmap
import os
import tempfile

import numpy as np


class Monotone:
    """A non-decreasing sequence of 64-bit numbers: low bytes in planes, high parts in a bit vector.

    An element takes the low bytes and about two bits. The directory of high
    parts is unpacked for a batch of searches and dropped again.
    """

    def __init__(self, n: int, low: np.ndarray, upper: np.ndarray):
        self.n, self.low, self.upper = n, low, upper
        self.shift = np.uint64(8 * len(low))

    @classmethod
    def build(cls, values: np.ndarray) -> Monotone:
        values = np.ascontiguousarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        planes = min(7, max(0, -(-max(0, (top // max(n, 1)).bit_length() - 1) // 8)))
        low = np.stack([(values >> np.uint64(8 * k)).astype(np.uint8) for k in range(planes)]) if planes else np.zeros((0, n), np.uint8)
        bits = np.zeros((top >> 8 * planes) + n + 1, np.uint8)
        bits[(values >> np.uint64(8 * planes)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, low, np.packbits(bits))

    def directory(self) -> np.ndarray:
        """start[h]: elements whose high part is under h."""
        zeros = np.flatnonzero(np.unpackbits(self.upper) == 0)
        return np.concatenate([[0], zeros - np.arange(len(zeros))]).clip(max=self.n)

    def _low(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k, plane in enumerate(self.low):
            out |= plane[at].astype(np.uint64) << np.uint64(8 * k)
        return out

    def get(self, at: np.ndarray) -> np.ndarray:
        """Elements by position (ascending or not)."""
        ones = np.flatnonzero(np.unpackbits(self.upper))
        return (ones[at] - at).astype(np.uint64) << self.shift | self._low(at)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the position of the first element not under it, and whether they are equal."""
        if not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        start = self.directory()
        high = np.minimum(x >> self.shift, np.uint64(len(start) - 1)).astype(np.int64)
        beyond = (x >> self.shift) >= np.uint64(len(start) - 1)
        lo, hi = start[high], start[np.minimum(high + 1, len(start) - 1)]
        lo, hi = np.where(beyond, self.n, lo), np.where(beyond, self.n, hi)
        end = hi.copy()
        want = x & ((np.uint64(1) << self.shift) - np.uint64(1))
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            under = self._low(mid) < want[open_]
            lo[open_] = np.where(under, mid + 1, lo[open_])
            hi[open_] = np.where(under, hi[open_], mid)
        inside = np.flatnonzero(lo < end)
        equal = np.zeros(len(x), bool)
        equal[inside] = self._low(lo[inside]) == want[inside]
        return lo, equal


def pack(**parts: Monotone | np.ndarray) -> bytes:
    """Sequences and arrays in one file image: a head, then the parts at their offsets."""
    head, body = {}, io.BytesIO()

    def put(a: np.ndarray) -> list:
        at = body.tell()
        body.write(np.ascontiguousarray(a).tobytes())
        return [at, a.dtype.str, list(a.shape)]

    for name, p in parts.items():
        head[name] = ["m", p.n, put(p.low), put(p.upper)] if isinstance(p, Monotone) else ["a", put(p)]
    said = json.dumps(head).encode()
    return len(said).to_bytes(8, "little") + said + body.getvalue()


class Levels:
    """Read-only levels of a packed file image, memory-mapped."""

    def __init__(self, handle: io.FileIO):
        self.map = mmap.mmap(handle.fileno(), 0, access=mmap.ACCESS_READ)
        n = int.from_bytes(self.map[:8], "little")
        base = 8 + n

        def view(at: int, kind: str, shape: list[int]) -> np.ndarray:
            count = int(np.prod(shape))
            return np.frombuffer(self.map, kind, count, base + at).reshape(shape) if count else np.zeros(shape, kind)

        for name, p in json.loads(self.map[8:base]).items():
            setattr(self, name, Monotone(p[1], view(*p[2]), view(*p[3])) if p[0] == "m" else view(*p[1]))

    @classmethod
    def from_bytes(cls, image: bytes) -> Levels:
        """Through a temporary file that is already unlinked, so that nothing is left behind."""
        with tempfile.TemporaryFile() as f:
            f.write(image)
            f.flush()
            return cls(f)

    @classmethod
    def from_path(cls, uri: str) -> Levels:
        """Maps a file of the shared folder; a store that can't be mapped is copied to an unlinked file."""
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        if isinstance(store, fs.LocalFileSystem):
            with open(path, "rb") as f:
                return cls(f)
        with store.open_input_stream(path) as f, tempfile.TemporaryFile() as own:
            while part := f.read(1 << 24):
                own.write(part)
            own.flush()
            return cls(own)


def write_shared(uri: str, image: bytes) -> None:
    """Writes a file of the shared folder whole or not at all, so that a task may run twice."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with store.open_output_stream(part) as f:
        f.write(image)
    store.move(part, path)
