"""Which events an earlier observation covers, found in one pass over each key's time line."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 0.2 - 1e-9
SEP = "\u001f"


class Staircase:
    """Observations of one set of signs, without those that another one beats: later ones have less confidence, so the
    first that is recent enough has the most."""

    __slots__ = ("seen", "conf")

    def __init__(self) -> None:
        self.seen: list[int] = []
        self.conf: list[float] = []

    def add(self, seen: int, conf: float) -> None:
        at = bisect_left(self.seen, seen)
        if at < len(self.seen) and self.conf[at] >= conf:
            return
        stop = bisect_right(self.seen, seen)
        start = stop
        while start and self.conf[start - 1] <= conf:
            start -= 1
        self.seen[start:stop] = [seen]
        self.conf[start:stop] = [conf]

    def best(self, after: int) -> float | None:
        """The most confidence among observations seen after a moment; earlier ones are forgotten."""
        at = bisect_right(self.seen, after)
        if at:
            del self.seen[:at], self.conf[:at]
        return self.conf[0] if self.conf else None


class TimeLine:
    """One key's observations by their sets of signs, and for every set asked about the sets that contain it."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.kinds: dict[str, tuple[frozenset[str], Staircase]] = {}
        self.above: dict[str, tuple[frozenset[str], list[Staircase]]] = {}

    def observe(self, shown: str, seen: int, conf: float) -> None:
        if shown not in self.kinds:
            signs, stairs = frozenset(shown.split(SEP)), Staircase()
            self.kinds[shown] = signs, stairs
            for asked, holders in self.above.values():
                if asked <= signs:
                    holders.append(stairs)
        self.kinds[shown][1].add(seen, conf)

    def covers(self, shown: str, us: int, conf: float) -> bool:
        if shown not in self.above:
            asked = frozenset(shown.split(SEP))
            self.above[shown] = asked, [stairs for signs, stairs in self.kinds.values() if asked <= signs]
        best = [stairs.best(us - self.window) for stairs in self.above[shown][1]]
        return any(b is not None and conf - b < TOLERANCE for b in best)


def _sweep(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, line = None, TimeLine(window)
        for batch in batches:
            hits = []
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for user, like, day, at, side, event, seen, shown, conf in zip(*columns, strict=True):
                if (user, like, day) != key:
                    key, line = (user, like, day), TimeLine(window)
                if side:
                    line.observe(shown, seen, conf)
                elif line.covers(shown, at, conf):
                    hits.append(event)
            yield pa.RecordBatch.from_arrays([pa.array(hits, pa.int64())], ["event_id"])

    return run


def covered(events: DataFrame, window: int) -> DataFrame:
    """Ids of events that an observation covers: one of the same (user_id, like), seen within ``window`` before the event or
    at its moment and answered before it, whose signs (``signs``, array<string>) hold the event's, and whose confidence
    (``conf``) is not lower by 0.2 or more.

    ``events`` has event_id, user_id, like, us, signs, conf, asks (whether the event wants to know) and answered_us (null:
    no observation). Time is cut into stretches of the window's length; an observation can cover events of its own stretch
    and of the next, so it goes to these two and every stretch of a key is swept by itself, in order of time. Work is a
    few searches an event and set of signs that contains its own; sets are few, as fixed lists bound them, while observations
    may be many. A row without user, signs or confidence (null, NaN) covers nothing and is not covered.
    """
    day = F.floor(F.col("us") / window)
    # an answer dated before its event counts from the event on
    at = F.when(F.col("answered_us").isNotNull(), F.greatest(F.col("answered_us"), F.col("us") - 1))

    def row(test: Column, stretch: Column, moment: Column, side: int) -> Column:
        return F.when(test, F.struct(stretch.alias("day"), moment.alias("at"), F.lit(side).alias("side")))

    rows = F.array(
        row(F.col("asks"), day, F.col("us"), 0),
        row(F.floor(at / window) <= day, day, at, 1),
        row(F.floor(at / window) <= day + 1, day + 1, at, 1),
    )
    known = events.where("user_id IS NOT NULL AND signs IS NOT NULL AND conf IS NOT NULL AND NOT isnan(conf)")
    moments = known.withColumn("shown", F.array_join("signs", SEP)).select(
        "user_id", "like", "event_id", "us", "shown", "conf", F.inline(F.array_compact(rows))
    )
    key = ["user_id", "like", "day"]
    lines = moments.select(*key, "at", "side", "event_id", "us", "shown", F.col("conf").cast("double"))
    return lines.repartition(*key).sortWithinPartitions(*key, "at", "side").mapInArrow(_sweep(window), "event_id long").distinct()
