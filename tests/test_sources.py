"""Data sources, the journal sink, data set layouts and the live tag map."""

import json
import math
import random
from datetime import datetime
from pathlib import Path
from statistics import median

import numpy as np
import pytest
from pyspark.sql import Row

from framewise.plans.ship import ship
from framewise.sources import datasets, formats, packets
from framewise.streaming import tag_map


def packet(k):
    rng = np.random.default_rng(k)
    depth = rng.integers(0, 65536, packets.DEPTH).astype(np.uint16)
    return packets.encode(np.zeros(packets.SMALL, np.uint8), depth, {"k": k}), depth


def test_packet_source_pushes_frames_down(spark, tmp_path):
    ship(spark)
    formats.register(spark)
    parts = [packet(k) for k in range(4)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.bin").write_bytes(packets.batch([p for p, _ in parts]))
    (tmp_path / "a" / "y.bin").write_bytes(packets.batch([parts[0][0], b"broken-frame"]))
    (tmp_path / "a" / "z.bin").write_bytes(b"BATH nothing")
    df = spark.read.format("framewise_packets").option("path", f"{tmp_path}/a").load()
    rows = {(Path(r.path).name, r.frame): r for r in df.collect()}
    assert {k: r.error is None for k, r in rows.items()} == {("x.bin", 0): True, ("x.bin", 1): True, ("x.bin", 2): True, ("x.bin", 3): True, ("y.bin", 0): True, ("y.bin", 1): False, ("z.bin", 0): False}
    assert all(rows["x.bin", k].depth == d.astype("<u2").tobytes() and json.loads(rows["x.bin", k].metadata) == {"k": k} for k, (_, d) in enumerate(parts))
    some = df.where("frame >= 1 and frame < 3")
    assert sorted((Path(r.path).name, r.frame) for r in some.collect()) == [("x.bin", 1), ("x.bin", 2), ("y.bin", 1)]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(frame" in plan and ">=" not in plan  # the reader took both bounds
    reader = formats.PacketReader(f"{tmp_path}/a")
    from pyspark.sql.datasource import EqualTo, IsNotNull, LessThan

    left = list(reader.pushFilters([EqualTo(("frame",), 2), IsNotNull(("frame",)), LessThan(("path",), "q")]))
    assert [type(f).__name__ for f in left] == ["IsNotNull", "LessThan"] and (reader.low, reader.high) == (2, 3)
    assert len(reader.partitions()) == 3 and [r[1] for p in reader.partitions() for r in reader.read(p)] == [2]
    assert spark.read.format("framewise_packets").option("path", f"{tmp_path}/a/x.bin").load().count() == 4


def test_journal_sink_counts_what_it_drops(spark, tmp_path):
    ship(spark)
    formats.register(spark)
    source, sink = f"{tmp_path}/in", f"{tmp_path}/journal"
    kinds = "stream string, sequence long, t double"
    frames = [("rgb", k, k / 30) for k in range(50)] + [("depth", k, k / 30) for k in range(5)] + [(None, 1, 0.0)]
    spark.createDataFrame(frames, kinds).coalesce(1).write.parquet(source)

    def run():
        rows = spark.readStream.schema(kinds).parquet(source)
        rows.writeStream.format("framewise_journal").option("path", sink).option("capacity", 20).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()

    run()
    counts = {r.stream: (r.admitted, r.dropped) for r in formats.journal_counts(spark, sink).collect()}
    assert counts == {"rgb": (20, 30), "depth": (5, 0), "None": (1, 0)}
    rows = formats.journal_rows(spark, sink, kinds).collect()
    assert sorted(r.sequence for r in rows if r.stream == "rgb") == list(range(20)) and len(rows) == 26
    # A batch that was written but never committed doesn't count, and one that is committed again counts once.
    writer = formats.JournalWriter(sink, 20)
    lost = writer.write(iter(spark.createDataFrame([("rgb", 999, 9.0)], kinds).collect()))
    assert formats.journal_rows(spark, sink, kinds).count() == 26
    writer.commit([lost, None], 7)
    writer.commit([lost, None], 7)
    assert formats.journal_rows(spark, sink, kinds).where("sequence = 999").count() == 1
    assert {r.stream: r.admitted for r in formats.journal_counts(spark, sink).collect()}["rgb"] == 21
    gone = writer.write(iter(spark.createDataFrame([("rgb", 1000, 9.0)], kinds).collect()))
    writer.abort([gone, None], 8)
    assert not (tmp_path / "journal" / "rows" / gone.file).exists()
    spark.createDataFrame([("rgb", 70, 9.0)], kinds).coalesce(1).write.mode("append").parquet(source)
    run()
    assert {r.stream: (r.admitted, r.dropped) for r in formats.journal_counts(spark, sink).collect()}["rgb"] == (22, 30)


def test_data_set_layouts(spark, tmp_path):
    (tmp_path / "rgb.txt").write_text("# time file\n1.00 a.png\n1.03 b.png\n\n1.20 c.png\nx d.png\n1.30\n")
    (tmp_path / "depth.txt").write_text("1.01 a_d.png\n1.045 b_d.png\n1.90 z_d.png\n")
    (tmp_path / "groundtruth.txt").write_text("1.005 1 2 3 0 0 0 1\n1.5 1 2 3 0 0 0 1\n1.02 oops 2 3 0 0 0 1\n")
    rows = datasets.listed_frames(spark, str(tmp_path)).collect()
    good = sorted((r.frame, r.t, r.rgb, r.depth, r.pose and r.pose[2]) for r in rows if r.error is None)
    assert good == [(0, 1.0, "a.png", "a_d.png", 3.0), (1, 1.03, "b.png", "b_d.png", None)]
    assert sorted(r.error for r in rows if r.error) == ["broken line in rgb.txt"] * 2
    assert [r.rgb for r in datasets.listed_frames(spark, str(tmp_path), stride=2, offset=1).where("error is null").collect()] == ["b.png"]
    frame = {"timestamp_s": 2.5, "rgb": "r.png", "depth": "d.png", "reference_pose": np.eye(4).tolist()}
    (tmp_path / "manifest.json").write_text(json.dumps({"frames": [frame, {"timestamp_s": 3.0, "rgb": "r.png"}, {**frame, "reference_pose": None}]}, indent=1))
    got = datasets.recorded_frames(spark, str(tmp_path)).orderBy("frame").collect()
    assert [r.error is None for r in got] == [True, False, True] and got[0].pose == np.eye(4).ravel().tolist() and got[2].pose is None
    eye = "\n".join(" ".join(map(str, r)) for r in np.eye(4))
    (tmp_path / "t.log").write_text(f"0 0 1\n{eye}\n1 1 2\n{eye.replace('1.0', 'one')}\n2 2 3\n1 2 3\n")
    poses = datasets.trajectory(spark, f"{tmp_path}/t.log").orderBy("frame").collect()
    assert [r.error is None for r in poses] == [True, False, False] and poses[0].pose == np.eye(4).ravel().tolist()


def by_hand(rows, capacity):
    """The rules over lists, one session and sighting after the other."""
    out, marks = [], {}
    for s, view, m, *point, range_m, repeated in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        own = marks.setdefault((s, m), {"p": [], "strikes": 0, "gone": False})
        state = "added"
        far = own["p"] and math.dist(point, [median(c) for c in zip(*own["p"], strict=True)]) > 0.04 + 0.006 * range_m**2
        own["strikes"] = own["strikes"] + 1 if far else 0
        own["gone"] = own["gone"] or repeated or own["strikes"] == 2
        if own["gone"]:
            own["p"], state = [], "excluded"
        elif far:
            state = "conflict"
        elif not own["p"] and sum(bool(v["p"]) for (t, _), v in marks.items() if t == s) >= capacity:
            state = "full"
        else:
            own["p"].append(tuple(point))
            if len(own["p"]) > 8:
                del own["p"][2]
        out.append((s, view, m, state, len(own["p"])))
    return sorted(out)


class _Store:
    """A state of one session that counts calls."""

    def __init__(self):
        self.value, self.calls = None, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            self.value = args[0] if name == "update" else self.value
            return self if name in ("getValueState", "getMapState") else self.value if name == "get" else None

        return call


def test_live_tag_map_reads_its_state_once_a_batch():
    """every call of the state store is a round trip."""
    store, fold = _Store(), tag_map.TagMap(1000)
    fold.init(store)
    row = Row("session", "view", "mark", "x", "y", "z", "range_m", "repeated", "ts")
    times = type("T", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    for batch in range(2):
        rows = [row(1, 500 * batch + i, i % 3, 0.0, 0.0, 0.0, 1.0, False, datetime(2024, 1, 1)) for i in range(300)]
        found = list(fold.handleInputRows((1,), iter(rows), times))
        assert [r.n_samples for r in found] == [8 if batch else min(8, i // 3 + 1) for i in range(300)]
    assert store.calls < 10


def test_live_tag_map_over_batches(spark, tmp_path):
    ship(spark)
    from datetime import datetime, timedelta

    rng = random.Random(4)
    rows = []
    for view in range(160):
        for m in rng.sample(range(5), 2):
            jump = 1.0 if rng.random() < 0.12 and m != 3 else 0.0
            rows.append((view % 2, view, m, m + jump + rng.uniform(-0.01, 0.01), 0.0, 2.0, 2.0, view == 90 and m == 1))
    kinds = "session long, view long, mark long, x double, y double, z double, range_m double, repeated boolean, ts timestamp"
    base, start = f"{tmp_path}/seen", datetime(2024, 1, 1)
    for k in range(4):
        part = [(*r, start + timedelta(seconds=r[1])) for r in rows if r[1] // 40 == k]
        spark.createDataFrame(part, kinds).coalesce(1).write.mode("append").parquet(base)
    stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(base)
    out = f"{tmp_path}/out"
    tag_map.live_tag_map(stream, capacity=4).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == by_hand(rows, 4)
    assert {"added", "conflict", "excluded", "full"} == {r[3] for r in got}
    assert tag_map.kept(list(range(9))) == [0, 1, 3, 4, 5, 6, 7, 8] and not tag_map.apart((0, 0, 0), [(0, 0, 0.03)], 1.0)


@pytest.mark.parametrize("bad", [b"", b"abc"])
def test_packet_source_of_odd_files(spark, tmp_path, bad):
    ship(spark)
    formats.register(spark)
    (tmp_path / "a.bin").write_bytes(bad)
    assert [r.error is None for r in spark.read.format("framewise_packets").option("path", str(tmp_path)).load().collect()] == [False]
