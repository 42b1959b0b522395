"""State machines on keyed streams, with event-time timers: notices, and pending events of live sessions.

Timers clear what is over, so the state of a key that has fallen silent goes when the watermark passes its last
deadline. Rows of a micro-batch are taken in order of time; rows later than the watermark are dropped by the engine.
The batch twins in ``notices`` state what the streams must give."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from privatrail.dims.decisions import DEFAULT_AFTER_SECONDS, RATE_LIMIT_HOURS, RESOLVED_SECONDS, UNANSWERED_SECONDS

SECOND = 1_000_000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NOTICE = "session_id string, signature string, kind string, event_id long, notice_id long, level int, ignored boolean, events long, closes_us long"
SETTLED = "session_id string, event_id long, status string, default_action string, taken_us long"
LIMITED = "event_id long, is_limited boolean"
_NOTICE, _SETTLED, _LIMITED = (Row(*[f.split()[0] for f in fields.split(", ")]) for fields in (NOTICE, SETTLED, LIMITED))


def _after(us: int) -> int:
    """The first millisecond behind a time: a timer there has seen every row up to it."""
    return us // 1000 + 1


def rocksdb(spark) -> None:
    """Value and map state with timers need this store; queries started later use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Notices(StatefulProcessor):
    """The open notice of a (session, signature): an event folds onto it, an answer shortens what it answers, and a
    timer closes it. ``open`` holds the notice, ``waiting`` its events that nobody has answered."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "notice_id long, level int, events long, until long, answered long")
        self.waiting = handle.getMapState("waiting", "event_id long", "us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        # an answer comes before an event of the same time, unless it answers this very event
        at_once = set()
        for r in sorted(rows, key=lambda r: (r.us, r.is_event, r.event_id)):
            if not r.is_event:
                if not self._answer(r.event_id, r.us):
                    at_once.add((r.event_id, r.us))
                continue
            yield from self._close(key, r.us)
            now = self.open.get() if self.open.exists() else (r.event_id, 0, 0, 0, None)
            notice, level, events, until, answered = now
            level = max(level, r.level)
            # only warnings wait for an answer
            keeps = (UNANSWERED_SECONDS if r.level > 0 else RESOLVED_SECONDS) * SECOND
            if r.level > 0:
                self.waiting.updateValue((r.event_id,), (r.us,))
                late = until
            else:
                late = max(until, r.us + keeps)
            self.open.update((notice, level, events + 1, late, answered))
            if (r.event_id, r.us) in at_once:
                self._answer(r.event_id, r.us)
            yield _NOTICE(*key, "event", r.event_id, notice, level, answered is not None and answered < r.us, None, None)
        if self.open.exists():
            self.handle.registerTimer(_after(self._closes()))

    def _closes(self) -> int:
        """When the notice closes if nothing more happens: an hour behind an unanswered event, ten minutes behind others."""
        until = self.open.get()[3]
        return max([until, *[us + UNANSWERED_SECONDS * SECOND for (us,) in self.waiting.values()]])

    def _answer(self, event_id: int, us: int) -> bool:
        """Does the answer belong to an event that waits?"""
        if not self.open.exists() or not self.waiting.containsKey((event_id,)):
            return False
        (asked,) = self.waiting.getValue((event_id,))
        if us >= asked + UNANSWERED_SECONDS * SECOND:
            return True  # too late: it had gone
        self.waiting.removeKey((event_id,))
        notice, level, events, until, answered = self.open.get()
        first = us if answered is None else min(answered, us)
        self.open.update((notice, level, events, max(until, asked + RESOLVED_SECONDS * SECOND, us), first))
        return True

    def _close(self, key, now: int) -> Iterator[Row]:
        if not self.open.exists() or (closes := self._closes()) > now:
            return
        notice, level, events, _, answered = self.open.get()
        self.open.clear()
        self.waiting.clear()
        yield _NOTICE(*key, "closed", None, notice, level, answered is not None, events, closes)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        yield from self._close(key, expiredTimerInfo.getExpiryTimeInMs() * 1000)

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """Pending events of a session. One takes its default when a page waits for it and nobody answers in time; it is
    aborted, and takes its default too, when the session falls silent before that."""

    def __init__(self, gap_us: int, seconds: int = DEFAULT_AFTER_SECONDS):
        self.gap, self.patience = gap_us, seconds * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long")
        self.pending = handle.getMapState("pending", "event_id long", "us long, waits boolean, default_action string")

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N803
        """Takes over events that were pending before the stream began."""
        self._hold(initialState)
        self.last.update((max(self.last.get()[0] if self.last.exists() else 0, initialState.us),))
        self._wake()

    def _hold(self, r) -> None:
        self.pending.updateValue((r.event_id,), (r.us, r.waits, r.default_action))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        at_once = set()
        for r in sorted(rows, key=lambda r: (r.us, r.is_beat, r.event_id or 0)):
            # an answer in the very moment still counts; a beat in the moment of the end opens a new session
            yield from self._settle(key, r.us + 1 if r.is_beat else r.us, r.us if r.is_beat else None)
            if not r.is_beat:
                if self.pending.exists() and self.pending.containsKey((r.event_id,)):
                    self.pending.removeKey((r.event_id,))
                else:
                    at_once.add((r.event_id, r.us))
                continue
            self.last.update((max(self.last.get()[0] if self.last.exists() else 0, r.us),))
            if r.default_action is not None and (r.event_id, r.us) not in at_once:
                self._hold(r)
        self._wake()

    def _due(self, us: int, waits: bool) -> tuple[int, str]:
        over = self.last.get()[0] + self.gap
        return min((us + self.patience, "defaulted") if waits else (over, "aborted"), (over, "aborted"))

    def _settle(self, key, before: int, beat: int | None = None) -> Iterator[Row]:
        """Events due before a time. At a beat, only the session's end may fall on the very moment."""
        if not self.last.exists():
            return
        for (event_id,), (us, waits, default) in sorted(self.pending.iterator()):
            due, status = self._due(us, waits)
            if due < before and not (beat is not None and due == beat and status == "defaulted"):
                self.pending.removeKey((event_id,))
                yield _SETTLED(*key, event_id, status, default, due)

    def _wake(self) -> None:
        if not self.last.exists():
            return
        due = [self._due(us, waits)[0] for us, waits, _ in self.pending.values()]
        self.handle.registerTimer(_after(min([self.last.get()[0] + self.gap, *due])))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        yield from self._settle(key, now)
        if self.last.exists() and self.last.get()[0] + self.gap < now:
            self.last.clear()
            self.pending.clear()
        else:
            self._wake()

    def close(self) -> None:
        pass


class RateLimit(StatefulProcessor):
    """The likes of a (user, kind of observation): ``seen`` holds the latest answered one for every distinct set of
    signals, red flags and confidence, ``open`` those that nobody has answered. A check looks at the distinct sets of one
    key, however many events a day has."""

    def __init__(self, hours: int = RATE_LIMIT_HOURS):
        self.window = hours * 3600 * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "shown string", "us long, conf double")
        self.open = handle.getMapState("open", "event_id long", "us long, shown string, conf double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N803
        last = 0
        for r in sorted(rows, key=lambda r: (r.us, r.side, r.event_id)):
            last = max(last, r.us)
            if r.side == 1:
                self._answer(r.event_id, r.us)
                continue
            # an answer of the same moment is not before the event
            yield _LIMITED(r.event_id, bool(not r.high_impact and self._covered(r)))
            self.open.updateValue((r.event_id,), (r.us, self._shown(r), r.conf))
        self.handle.registerTimer(_after(last + self.window))

    @staticmethod
    def _shown(r) -> str:
        """Signals, flags and confidence as one key; the confidence is 0 where it does not weigh."""
        return "\u001e".join(["\u001f".join(sorted(r.sig)), "\u001f".join(sorted(r.flags)), repr(r.conf)])

    @staticmethod
    def _sets(shown: str) -> tuple[set[str], set[str]]:
        sig, flags, _ = shown.split("\u001e")
        return set(sig.split("\u001f")) - {""}, set(flags.split("\u001f")) - {""}

    def _covered(self, r) -> bool:
        for (shown,), (us, conf) in self.seen.iterator():
            sig, flags = self._sets(shown)
            if r.us - us < self.window and set(r.sig) <= sig and set(r.flags) <= flags and (not r.weighs or r.conf - conf < 0.2 - 1e-9):
                return True
        return False

    def _answer(self, event_id: int, us: int) -> None:
        if not self.open.exists() or not self.open.containsKey((event_id,)):
            return
        asked, shown, conf = self.open.getValue((event_id,))
        self.open.removeKey((event_id,))
        if not self.seen.containsKey((shown,)) or self.seen.getValue((shown,))[0] < asked:
            self.seen.updateValue((shown,), (asked, conf))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N803
        old = expiredTimerInfo.getExpiryTimeInMs() * 1000 - self.window
        left = 0
        for state in (self.seen, self.open):
            for k, v in list(state.iterator()):
                if v[0] < old:
                    state.removeKey(k)
                else:
                    left = max(left, v[0])
        if left:
            self.handle.registerTimer(_after(left + self.window))
        return iter(())

    def close(self) -> None:
        pass


def _timed(log: DataFrame, delay: str) -> DataFrame:
    return log.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", delay)


def notice_stream(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Folded events and closed notices of a stream (see ``notices.notice_log``)."""
    return _timed(log, delay).groupBy("session_id", "signature").transformWithState(
        statefulProcessor=Notices(), outputStructType=NOTICE, outputMode="Append", timeMode="EventTime"
    )


def session_stream(log: DataFrame, gap_us: int, delay: str = "1 hour", seconds: int = DEFAULT_AFTER_SECONDS, pending: DataFrame | None = None) -> DataFrame:
    """What becomes of the pending events of a stream (see ``notices.session_log``); ``pending`` has those from before."""
    first = pending.groupBy("session_id") if pending is not None else None
    return _timed(log, delay).groupBy("session_id").transformWithState(
        statefulProcessor=Sessions(gap_us, seconds), outputStructType=SETTLED, outputMode="Append", timeMode="EventTime", initialState=first
    )


def rate_limited_stream(log: DataFrame, delay: str = "1 hour", hours: int = RATE_LIMIT_HOURS) -> DataFrame:
    """(event_id, is_limited) for every event of a stream of ``decisions.observations``."""
    return _timed(log, delay).groupBy("user_id", "like").transformWithState(
        statefulProcessor=RateLimit(hours), outputStructType=LIMITED, outputMode="Append", timeMode="EventTime"
    )
