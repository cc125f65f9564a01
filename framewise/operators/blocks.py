"""A graph's edges in blocks, whose vertices move to weighted means in sweeps; only sums of vertices that several blocks share are shuffled."""

from __future__ import annotations

import io
import math
import os
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialise, shared_dir

#: Edges of a block, about: at most, and at least where there are more cores than blocks.
MOST, LEAST = 1 << 20, 1 << 14

_MESSAGE = "part int, sender int, told binary"


class Blocks:
    """Edges (ident, src, dst, weight, one offset an axis) with no nulls but in ident, and where their vertices are, positions (id, axes).

    Edges are dealt once by ranges of (dst, src, ident) and stay in a file a
    block of the shared folder, with the places of the block's vertices. A
    vertex of one block moves there. One of several has a home, dealt by a
    hash: each of its blocks sends its sums there, and gets its place back, so
    a sweep shuffles two messages a block that a shared vertex is in, and no edge.
    Steps write files named by round and sweep, equal each time they run.
    number is that of edges, or somewhat more. unknown has the idents (one row an edge) of edges with an end without a position.
    """

    def __init__(self, edges: DataFrame, positions: DataFrame, axes: tuple[str, ...], ident: str, own: float, number: int):
        spark = edges.sparkSession
        self.axes, self.ident, self.own = axes, ident, own
        self.folder = f"{shared_dir(spark)}/blocks-{uuid.uuid4().hex}"
        cores = spark.sparkContext.defaultParallelism
        self.parts = max(1, math.ceil(number / MOST), min(cores, number // LEAST))
        self.homes = max(min(cores, self.parts), self.parts // 8)
        at = positions.where(" and ".join(f"{a} is not null" for a in ("id", *axes))).select("id", *(F.col(a).cast("double").alias(a) for a in axes))
        kind = at.schema["id"].dataType
        edges = edges.select(ident, *(F.col(c).cast(kind).alias(c) for c in ("src", "dst")), *(F.col(c).cast("double").alias(c) for c in ("weight", *axes)))
        self._kinds = {ident: edges.schema[ident].dataType.simpleString(), "id": kind.simpleString()}
        ends = materialise(self._dealt(edges), "ends")
        held = [(r.block,) for r in ends.select("block").distinct().collect()]
        self.tokens = spark.createDataFrame(held, "part int")
        placed = ends.groupBy("id").agg(F.sort_array(F.collect_list("block")).alias("_blocks")).join(at, "id")
        placed = materialise(placed.withColumn("_home", F.when(F.size("_blocks") > 1, F.pmod(F.xxhash64("id"), F.lit(self.homes)).cast("int"))), "placed")
        materialise(self._housed(placed), "homes")
        self.unknown = materialise(self._seated(placed), "unknown")
        self.apart = self._apart()

    def _each(self, rows: DataFrame, step, schema: str) -> DataFrame:
        return rows.repartition(self.parts, "part").groupBy("part").applyInArrow(step, schema)

    def _dealt(self, edges: DataFrame) -> DataFrame:
        folder, ident, axes = self.folder, self.ident, self.axes

        def keep(batches):
            rows = list(batches)
            if not sum(b.num_rows for b in rows):
                return
            rows = pa.Table.from_batches(rows)
            block = rows["_block"][0].as_py()
            ends = pa.concat_arrays([*rows["src"].chunks, *rows["dst"].chunks]).dictionary_encode()
            n, ids = rows.num_rows, ends.dictionary
            held = [rows[ident], ends.indices[:n], ends.indices[n:], *(rows[c] for c in ("weight", *axes))]
            # Edges of one dst stand together, so that places are read and summed in order.
            held = pa.table(held, names=[f"c{k}" for k in range(len(held))]).take(pa.array(np.argsort(ends.indices[n:].to_numpy(), kind="stable")))
            _write_table(f"{folder}/edges-{block}", held)
            _write_table(f"{folder}/ids-{block}", pa.table({"id": ids}))
            yield from pa.table({"id": ids, "block": pa.array(np.full(len(ids), block, np.int32))}).to_batches(1 << 16)

        dealt = edges.repartitionByRange(self.parts, "dst", "src", ident).withColumn("_block", F.spark_partition_id())
        return dealt.mapInArrow(keep, f"id {self._kinds['id']}, block int")

    def _housed(self, placed: DataFrame) -> DataFrame:
        """Homes with their vertices in the order of ids, and which of them each block has."""
        folder, axes = self.folder, self.axes

        def house(rows: pa.Table) -> pa.Table:
            rows, home = rows.sort_by("id"), rows["part"][0].as_py()
            lists = rows["_blocks"].combine_chunks()
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            block, vertex = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            _write(f"{folder}/homes-{home}", **_routes(block, vertex))
            _write(f"{folder}/home-{home}-0-end", x=_columns(rows, axes))
            return pa.table({"home": pa.array([home], pa.int32())})

        shared = placed.where("_home is not null").withColumnRenamed("_home", "part")
        return self._each(shared.select("part", "id", "_blocks", *axes), house, "home int")

    def _seated(self, placed: DataFrame) -> DataFrame:
        """Blocks with their vertices' first places, and the order in which they tell each home of its vertices."""
        folder, axes, ident = self.folder, self.axes, self.ident

        def seat(rows: pa.Table) -> pa.Table:
            block, edges = rows["part"][0].as_py(), _Edges(folder, rows["part"][0].as_py())
            rows = rows.filter(pc.is_valid(rows["id"])).sort_by("id")
            vertex = pc.index_in(rows["id"], edges.ids()).to_numpy().astype(np.intp)
            x, known = np.zeros((len(axes), edges.vertices)), np.zeros(edges.vertices, bool)
            x[:, vertex], known[vertex] = _columns(rows, axes), True
            shared = pc.is_valid(rows["_home"]).to_numpy()
            _write(f"{folder}/routes-{block}", **_routes(rows["_home"].filter(pa.array(shared)).to_numpy(), vertex[shared]))
            _write(f"{folder}/block-{block}-0-end", x=x)
            dead = np.flatnonzero(~(known[edges.s] & known[edges.d]))
            _write(f"{folder}/dead-{block}-0", rows=dead)
            return pa.table({ident: edges.ident.take(pa.array(dead))})

        each = placed.select(F.explode("_blocks").alias("part"), "id", "_home", *axes)
        return self._each(each.unionByName(self.tokens, allowMissingColumns=True), seat, f"`{ident}` {self._kinds[ident]}")

    def idents(self) -> DataFrame:
        """The idents of edges whose ends are both known."""
        folder, ident = self.folder, self.ident

        def live(rows: pa.Table) -> pa.Table:
            block = rows["part"][0].as_py()
            found = _Edges(folder, block).ident
            keep = np.ones(len(found), bool)
            keep[_read(f"{folder}/dead-{block}-0")["rows"]] = False
            return pa.table({ident: found.filter(pa.array(keep))})

        return self._each(self.tokens, live, f"`{ident}` {self._kinds[ident]}")

    def _apart(self) -> DataFrame | None:
        """(ident, _blocks) of idents that several blocks hold; looked for only where the blocks' ranges of idents meet."""
        folder, ident, kind = self.folder, self.ident, self._kinds[self.ident]

        def span(rows: pa.Table) -> pa.Table:
            block = rows["part"][0].as_py()
            ends = pc.min_max(_Edges(folder, block).ident)
            return pa.table({"block": pa.array([block], pa.int32()), "low": pa.array([ends["min"].as_py()], ends["min"].type), "high": pa.array([ends["max"].as_py()], ends["max"].type)})

        spans = [tuple(r) for r in self._each(self.tokens, span, f"block int, low {kind}, high {kind}").collect() if r.low is not None]

        def meets(rows: pa.Table) -> pa.Table:
            block, found = rows["part"][0].as_py(), _Edges(folder, rows["part"][0].as_py()).ident
            low, high = next(((a, b) for k, a, b in spans if k == block), (None, None))
            inside = pa.array(np.zeros(len(found), bool))
            for k, a, b in spans:
                if k != block and low is not None and a <= high and low <= b:
                    inside = pc.or_kleene(inside, pc.and_kleene(pc.greater_equal(found, pa.scalar(a, found.type)), pc.less_equal(found, pa.scalar(b, found.type))))
            found = found.filter(inside).unique()
            return pa.table({ident: found, "_block": pa.array(np.full(len(found), block, np.int32))})

        order = sorted(spans, key=lambda s: s[1])
        if all(a[2] < b[1] for a, b in zip(order, order[1:], strict=False)):
            return None
        met = self._each(self.tokens, meets, f"`{ident}` {kind}, _block int")
        return materialise(met.groupBy(ident).agg(F.collect_set("_block").alias("_blocks")).where(F.size("_blocks") > 1), "apart")

    def _dropped(self, gone: DataFrame) -> DataFrame:
        """(part, idents): what each block must leave out."""
        rows = gone.select(ident := self.ident, F.col("_block").alias("part"))
        if self.apart is not None:
            rows = rows.unionAll(gone.select(ident).join(self.apart, ident).select(ident, F.explode("_blocks"))).distinct()
        return rows.groupBy("part").agg(F.collect_list(ident).alias("idents"))

    def swept(self, k: int, sweeps: int, gone: DataFrame | None, limit: float) -> DataFrame:
        """(ident, src, dst, _block, _miss) of edges that miss by limit or more after round k: gone (ident, _block) left out for good, then sweeps.

        Rounds go from 1 up, each after the one before was read whole.
        """
        folder, own, ident, axes = self.folder, self.own, self.ident, self.axes
        said = self.tokens if gone is None else self.tokens.unionByName(self._dropped(gone), allowMissingColumns=True)

        def begin(block: int, edges: _Edges, rows: pa.Table):
            """A block's places after the round before, and all edges that are out."""
            x, dead = _read(f"{folder}/block-{block}-{k - 1}-end")["x"], _read(f"{folder}/dead-{block}-{k - 1}")["rows"]
            if "idents" in rows.column_names:
                out = pa.concat_arrays([a.flatten() for a in rows["idents"].chunks])
                dead = np.union1d(dead, np.flatnonzero(pc.is_in(edges.ident, out).to_numpy(zero_copy_only=False)))
            _write(f"{folder}/dead-{block}-{k}", rows=dead)
            _forget([f"{folder}/block-{block}-{k - 2}-end", f"{folder}/dead-{block}-{k - 2}", *(f"{folder}/block-{block}-{k - 1}-{j}" for j in range(1, sweeps + 1))])
            return x, dead

        def resume(block: int, rows: pa.Table, i: int):
            return _told(_read(f"{folder}/block-{block}-{k}-{i}")["x"], _read(f"{folder}/routes-{block}"), rows), _read(f"{folder}/dead-{block}-{k}")["rows"]

        def move(i):
            def step(rows: pa.Table) -> pa.Table:
                block, edges = rows["part"][0].as_py(), _Edges(folder, rows["part"][0].as_py())
                x, dead = resume(block, rows, i) if i else begin(block, edges, rows)
                sums, weight = edges.sums(x, dead)
                with np.errstate(invalid="ignore", divide="ignore"):
                    _write(f"{folder}/block-{block}-{k}-{i + 1}", x=(own * x + sums) / (own + weight))
                return _messages(block, _read(f"{folder}/routes-{block}"), np.vstack([sums, weight]) if i == 0 else sums)

            return step

        def meet(i):
            def step(rows: pa.Table) -> pa.Table:
                home = rows["part"][0].as_py()
                routes, before = _read(f"{folder}/homes-{home}"), f"{k}-{i}" if i else f"{k - 1}-end"
                x = _read(f"{folder}/home-{home}-{before}")["x"]
                total = np.zeros((len(x) + (i == 0), x.shape[1]))
                for where, values in _heard(routes, rows):
                    total[:, where] += values
                if i == 0:
                    _write(f"{folder}/weight-{home}-{k}", w=total[-1])
                    _forget([f"{folder}/home-{home}-{k - 2}-end", f"{folder}/weight-{home}-{k - 2}", *(f"{folder}/home-{home}-{k - 1}-{j}" for j in range(1, sweeps))])
                weight = total[-1] if i == 0 else _read(f"{folder}/weight-{home}-{k}")["w"]
                with np.errstate(invalid="ignore", divide="ignore"):
                    x = (own * x + total[: len(x)]) / (own + weight)
                _write(f"{folder}/home-{home}-{f'{k}-{i + 1}' if i + 1 < sweeps else f'{k}-end'}", x=x)
                return _messages(home, routes, x)

            return step

        def measure(rows: pa.Table) -> pa.Table:
            block, edges = rows["part"][0].as_py(), _Edges(folder, rows["part"][0].as_py())
            x, dead = resume(block, rows, sweeps) if sweeps else begin(block, edges, rows)
            _write(f"{folder}/block-{block}-{k}-end", x=x)
            miss = np.sqrt(sum((a.take(edges.s) - a.take(edges.d) - o) ** 2 for a, o in zip(x, edges.offsets, strict=True)))
            far = ~(miss < limit)
            far[dead] = False
            far, ids = np.flatnonzero(far), edges.ids()
            ends = {c: ids.take(pa.array(v[far])) for c, v in (("src", edges.s), ("dst", edges.d))}
            return pa.table({ident: edges.ident.take(pa.array(far)), **ends, "_block": pa.array(np.full(len(far), block, np.int32)), "_miss": miss[far]})

        for i in range(sweeps):
            said = self._each(self._each(said, move(i), _MESSAGE), meet(i), _MESSAGE).unionByName(self.tokens, allowMissingColumns=True)
        kind = self._kinds["id"]
        return self._each(said, measure, f"`{ident}` {self._kinds[ident]}, src {kind}, dst {kind}, _block int, _miss double")


class _Edges:
    """A block's edges, memory-mapped where the shared folder allows."""

    def __init__(self, folder: str, block: int):
        self._ids = f"{folder}/ids-{block}"
        self.ident, self.s, self.d, self.weight, *self.offsets = (c.chunk(0) for c in _read_table(f"{folder}/edges-{block}").columns)
        self.s, self.d, self.weight, *self.offsets = (c.to_numpy() for c in (self.s, self.d, self.weight, *self.offsets))
        self.vertices = int(max(self.s.max(), self.d.max())) + 1

    def ids(self) -> pa.Array:
        return _read_table(self._ids)["id"].chunk(0)

    def sums(self, x: np.ndarray, dead: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vertex's weighted sum, an axis a row, of where its edges say it is, and its weight; dead edges say nothing."""
        s, d, w, n = self.s.astype(np.intp), self.d.astype(np.intp), self.weight.copy(), self.vertices
        w[dead] = 0
        out = []
        for a, o in zip(x, self.offsets, strict=True):
            at_s, at_d = w * (a.take(d) + o), w * (a.take(s) - o)
            at_s[dead], at_d[dead] = 0, 0
            out.append(np.bincount(s, at_s, n) + np.bincount(d, at_d, n))
        return np.stack(out), np.bincount(s, w, n) + np.bincount(d, w, n)


def _columns(rows: pa.Table, axes: tuple[str, ...]) -> np.ndarray:
    return np.stack([rows[a].to_numpy() for a in axes])


def _routes(to: np.ndarray, vertex: np.ndarray) -> dict[str, np.ndarray]:
    """Vertices by whom they are told to, each in the given order."""
    order = np.argsort(to, kind="stable")
    names, starts = np.unique(to[order], return_index=True)
    return {"names": names.astype(np.int32), "ends": np.append(starts, len(to)), "vertex": vertex[order]}


def _messages(sender: int, routes: dict[str, np.ndarray], values: np.ndarray) -> pa.Table:
    cut = [values[:, routes["vertex"][a:b]].tobytes() for a, b in zip(routes["ends"], routes["ends"][1:], strict=False)]
    return pa.table({"part": pa.array(routes["names"]), "sender": pa.array(np.full(len(cut), sender, np.int32)), "told": pa.array(cut, pa.binary())})


def _heard(routes: dict[str, np.ndarray], rows: pa.Table):
    """(vertices, values) of each message, by sender."""
    said = sorted((f, v) for f, v in zip(rows["sender"].to_pylist(), rows["told"].to_pylist(), strict=True) if f is not None)
    for sender, values in said:
        k = int(np.searchsorted(routes["names"], sender))
        where = routes["vertex"][routes["ends"][k] : routes["ends"][k + 1]]
        yield where, np.frombuffer(values).reshape(-1, len(where))


def _told(x: np.ndarray, routes: dict[str, np.ndarray], rows: pa.Table) -> np.ndarray:
    for where, values in _heard(routes, rows) if "sender" in rows.column_names else ():
        x[:, where] = values
    return x


def _write_image(uri: str, image) -> None:
    """Writes a file of the shared folder whole or not at all, so that a task may run twice."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with store.open_output_stream(part) as f:
        f.write(image)
    store.move(part, path)


def _write(uri: str, **arrays: np.ndarray) -> None:
    image = io.BytesIO()
    np.savez(image, **arrays)
    _write_image(uri, image.getbuffer())


def _read(uri: str) -> dict[str, np.ndarray]:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f, np.load(io.BytesIO(f.read())) as held:
        return {k: held[k] for k in held.files}


def _write_table(uri: str, rows: pa.Table) -> None:
    image = pa.BufferOutputStream()
    with pa.ipc.new_file(image, rows.schema) as f:
        f.write_table(rows.combine_chunks())
    _write_image(uri, image.getvalue())


def _read_table(uri: str) -> pa.Table:
    store, path = fs.FileSystem.from_uri(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)).read_all()


def _forget(uris: list[str]) -> None:
    for uri in uris:
        store, path = fs.FileSystem.from_uri(uri)
        if store.get_file_info(path).type == fs.FileType.File:
            store.delete_file(path)
