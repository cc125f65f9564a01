"""A live map of marks as a stream: bounded samples per mark, two strikes, capacity, and an end by a timer."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import median

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Samples of a mark that stay of more: the first and the last ones; conflicts in a row that exclude it; marks of a session.
FIRST, LAST, STRIKES, CAPACITY = 2, 6, 2, 256
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def kept(samples: list) -> list:
    """The first two and the last six of more than eight samples."""
    return samples if len(samples) <= FIRST + LAST else samples[:FIRST] + samples[-LAST:]


def apart(point: tuple[float, float, float], samples: list[tuple[float, float, float]], range_m: float) -> bool:
    """Whether a sighting lies further from the median of the samples than its range allows."""
    middle = [median(axis) for axis in zip(*samples, strict=True)]
    return sum((a - b) ** 2 for a, b in zip(point, middle, strict=True)) ** 0.5 > 0.04 + 0.006 * range_m**2


class TagMap(StatefulProcessor):
    """State per session, one value: for each mark its samples, its strikes and whether it is excluded for good; and the timer that is set."""

    def __init__(self, quiet_ms: int, capacity: int = CAPACITY):
        self.quiet_ms, self.capacity = quiet_ms, capacity

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "marks array<struct<mark: long, xs: array<double>, ys: array<double>, zs: array<double>, strikes: int, excluded: boolean>>, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """The state is read and written once a batch, as every call of the store is a round trip."""
        held, timer = self.held.get() or ((), None)
        marks = {m[0]: (list(zip(*m[1:4], strict=True)), m[4], m[5]) for m in held}
        n = sum(bool(m[0]) for m in marks.values())
        last, out = 0, []
        for r in sorted(rows, key=lambda r: (r.view, r.mark)):
            last = max(last, int(r.ts.timestamp() * 1000))
            samples, strikes, excluded = marks.get(r.mark, ([], 0, False))
            point, state = (r.x, r.y, r.z), "excluded"
            if not excluded and r.repeated:
                excluded = True
            elif not excluded and samples and apart(point, samples, r.range_m):
                strikes += 1
                excluded = strikes >= STRIKES
                state = "excluded" if excluded else "conflict"
            elif not excluded and not samples and n >= self.capacity:
                state = "full"
            elif not excluded:
                n += not samples
                samples, strikes, state = kept([*samples, point]), 0, "added"
            if excluded and samples:
                samples, n = [], n - 1
            if state != "full":
                marks[r.mark] = (samples, strikes, excluded)
            out.append(Row(session=key[0], view=r.view, mark=r.mark, state=state, n_samples=len(samples)))
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = max(last, timerValues.getCurrentWatermarkInMs()) + self.quiet_ms
        self.handle.registerTimer(timer)
        axes = lambda samples: [list(c) for c in zip(*samples, strict=True)] if samples else [[], [], []]
        self.held.update(([(mark, *axes(samples), strikes, excluded) for mark, (samples, strikes, excluded) in marks.items()], timer))
        return iter(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.clear()
        return iter(())


def live_tag_map(stream: DataFrame, quiet: str = "10 minutes", quiet_ms: int = 600_000, capacity: int = CAPACITY) -> DataFrame:
    """(session, view, mark, state, n_samples) of each sighting of a mark by an accepted view.

    stream: session, view, mark (longs), the mark's place in the world x, y, z,
    its range_m from the camera, repeated (seen twice in one view) and ts, an
    event time. A sighting near the median of the mark's samples is added (the first two
    and last six stay); a far one is a conflict, and the second in a row
    excludes the mark for good, as a repeated one does at once. Beyond
    ``capacity`` marks of a session new ones are full. A session's state ends
    when event time has passed its last row by quiet_ms. Rows of a batch are
    taken by view; state is bounded by capacity, not by the stream.
    Needs the RocksDB state store, which this sets for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = stream.withColumn("repeated", F.coalesce("repeated", F.lit(False))).where("session is not null and mark is not null and x is not null and y is not null and z is not null").withWatermark("ts", quiet)
    return rows.groupBy("session").transformWithState(TagMap(quiet_ms, capacity), "session long, view long, mark long, state string, n_samples int", "Append", "EventTime")
