"""Streams with state and timers against their batch twins, and what their state is once a key has fallen silent."""

import uuid

import pytest
from pyspark.sql import functions as F

from privatrail.operators import decisions as D
from privatrail.plans import stream as PS
from privatrail.plans.decisions import judged
from privatrail.sources.model import model
from privatrail.streaming import decisions as DS
from privatrail.streaming import notices as N
from privatrail.streaming import stateful as S

SECOND = 1_000_000
BASE = 1_700_000_000  # a stream drops what is not after its first watermark, 1970
EVENTS = "session_id string, us long, event_id long, signature string, level int"


@pytest.fixture(autouse=True)
def store(spark):
    S.rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def streamed(spark, tmp_path, log, build, cuts, closing):
    """Rows of a stream over a log that arrives in parts, and the rows of state that are left behind the last. ``closing``
    rows of keys of their own move the watermark on."""
    base = tmp_path / uuid.uuid4().hex[:8]
    bounds = [None, *cuts, None]
    parts = [log.where(F.lit(True) if a is None else F.col("us") >= a).where(F.lit(True) if b is None else F.col("us") < b) for a, b in zip(bounds, bounds[1:])]
    for part in [*parts, *closing]:
        part.coalesce(1).write.mode("append").parquet(str(base / "in"))
        stream = spark.readStream.schema(log.schema).parquet(str(base / "in"))
        q = build(stream).writeStream.format("parquet").option("checkpointLocation", str(base / "cp")).outputMode("append").trigger(availableNow=True).start(str(base / "out"))
        q.awaitTermination()
    kept = {}
    for name in ("open", "waiting", "pending", "last", "seen"):
        try:
            reader = spark.read.format("statestore").option("path", str(base / "cp")).option("stateVarName", name)
            kept[name] = reader.load().count()
        except Exception as e:  # the processor has no such variable
            assert "STATE" in str(e).upper()
    return spark.read.parquet(str(base / "out")).collect(), kept


def moved(spark, log, **values):
    """A row far behind all others, in a key of its own."""
    row = log.limit(1)
    for c, t in log.dtypes:
        row = row.withColumn(c, F.lit(values.get(c)).cast(t)) if c in values else row
    return row


def test_notices(spark, tmp_path):
    rows = [("1", (BASE + 10 + 100 * i) * SECOND, i, ("a", "b", None)[i % 3], (i * 7) % 3) for i in range(1, 60)]
    rows += [("2", (BASE + 2000 * i) * SECOND, 100 + i, "a", i % 3) for i in range(12)]
    events = spark.createDataFrame(rows, EVENTS)
    # some at once, some late within the hour, one too late, two answers to one event, one to an event without a signature
    answers = spark.createDataFrame(
        [(e, (BASE + s) * SECOND) for e, s in ((4, 500), (4, 450), (7, 4000), (10, 9000), (101, 2000), (103, 8500), (3, 311), (16, 1700))], "event_id long, us long"
    )
    want = {r.event_id: (r.notice_id, r.level, r.ignored) for r in N.fold_events(events.where("signature IS NOT NULL"), answers).collect()}
    closed = {(r.session_id, r.signature, r.notice_id, r.level, r.answered, r.events, r.closes_us) for r in N.closed_notices(events, answers).collect()}
    assert any(v[2] for v in want.values()) and len(closed) > 4

    log = N.notice_log(events, answers)
    end = [moved(spark, log, session_id="end", signature="end", us=u, event_id=u, level=0, is_event=True) for u in ((BASE + 10**6 * k) * SECOND for k in (1, 2, 3))]
    got, kept = streamed(spark, tmp_path, log, lambda s: S.notice_stream(s, "0 seconds"), [(BASE + s) * SECOND for s in (1_500, 4_000, 9_000)], end)
    assert {r.event_id: (r.notice_id, r.level, r.ignored) for r in got if r.kind == "event" and r.session_id != "end"} == want
    shut = [(r.session_id, r.signature, r.notice_id, r.level, r.ignored, r.events, r.closes_us) for r in got if r.kind == "closed" and r.session_id != "end"]
    assert len(shut) == len(set(shut)) and set(shut) == closed
    # only the key that moved the watermark may still hold something
    assert kept["open"] <= 1 and kept["waiting"] <= 1


def test_pending_events_of_sessions(spark, tmp_path):
    gap = 200 * SECOND
    beats = [(f"s{k}", (BASE + 1000 * k + d) * SECOND, 100 * k + i) for k in range(6) for i, d in enumerate((0, 30, 90, 91, 250, 700, 720))]
    events = spark.createDataFrame(beats, "session_id string, us long, event_id long")
    held = events.where("event_id % 3 <> 2").select("*", (F.col("event_id") % 2 == 0).alias("waits"), F.when(F.col("event_id") % 4 < 2, "cancel").otherwise("block").alias("default_action"))
    answers = events.where("event_id % 5 = 0").select("event_id", (F.col("us") + (F.col("event_id") % 7) * 40 * SECOND).alias("us"))
    want = {tuple(r) for r in N.settled(held, N.sessions(N.with_event_time(events), "200 seconds"), answers, gap).collect()}
    assert {r[2] for r in want} == {"aborted", "defaulted"}

    log = N.session_log(events, held, answers)
    end = [moved(spark, log, session_id="end", us=u, event_id=u, is_beat=True, waits=None, default_action=None) for u in ((BASE + 10**6 * k) * SECOND for k in (1, 2, 3))]
    build = lambda s: S.session_stream(s, gap, "0 seconds")
    got, kept = streamed(spark, tmp_path, log, build, [(BASE + s) * SECOND for s in (60, 1_100, 3_500)], end)
    assert sorted(map(tuple, got)) == sorted(want)
    assert kept["pending"] == 0 and kept["last"] <= 1


def test_events_pending_before_the_stream(spark, tmp_path):
    log = spark.createDataFrame([("a", 50 * SECOND, 2, True, True, "block"), ("b", 20 * SECOND, 1, False, None, None)], "session_id string, us long, event_id long, is_beat boolean, waits boolean, default_action string")
    before = spark.createDataFrame([("a", 10 * SECOND, 7, False, "cancel"), ("b", 5 * SECOND, 1, True, "cancel"), ("b", 6 * SECOND, 9, True, "cancel")], "session_id string, us long, event_id long, waits boolean, default_action string")
    end = [moved(spark, log, session_id="end", us=u, event_id=u, is_beat=True, default_action=None) for u in (10**12, 2 * 10**12)]
    got, _ = streamed(spark, tmp_path, log, lambda s: S.session_stream(s, 100 * SECOND, "0 seconds", pending=before), [], end)
    assert {tuple(r) for r in got} == {
        ("a", 7, "aborted", "cancel", 150 * SECOND), ("a", 2, "defaulted", "block", 110 * SECOND), ("b", 9, "defaulted", "cancel", 66 * SECOND)
    }


def test_rate_limit(spark, sf, tmp_path):
    keep = ["event_id", "user_id", "us", "event_type", "requester_key", "categories", "dark_patterns", "signals", "clauses", "confidence", "red_flags", "high_impact"]
    j = judged(spark, sf).select(*keep).persist()
    answers = model(spark, sf, "responses")
    want = {r.event_id for r in D.rate_limited(j, answers).collect()}
    log = DS.observations(j, answers)
    span = log.agg(F.min("us").alias("a"), F.max("us").alias("b")).first()
    end = [moved(spark, log, user_id=-1, like="end", us=span.b + k * 10**13, event_id=-k, side=0) for k in (1, 2, 3)]
    got, kept = streamed(spark, tmp_path, log, lambda s: S.rate_limited_stream(s, "0 seconds"), [span.a + (span.b - span.a) // 2], end)
    told = {r.event_id: r.is_limited for r in got if r.event_id >= 0}
    assert {k for k, v in told.items() if v} == want and want and len(told) == j.where("event_type <> 'form_observed'").count()
    assert kept["seen"] == 0 and kept["open"] <= 1
    j.unpersist()


def test_late_results_of_a_repeated_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 10), (2, 0, 999), (3, None, 5)], "event_id long, us long, result_us long")
    for batch in (0, 1, 1):  # the second is taken again, as after a failure
        N.write_with_late(rows.withColumn("event_id", F.col("event_id") + 10 * batch), batch, 100, str(tmp_path / "in_time"), str(tmp_path / "late"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "in_time")).collect()) == [1, 11]
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "late")).collect()) == [2, 3, 12, 13]


def test_held_events_are_those_that_interrupt(spark, sf):
    held = PS.held_events(spark, sf)
    last = {r.event_id: r.o for r in model(spark, sf, "decision_log").groupBy("event_id").agg(F.max_by("outcome", "seq").alias("o")).collect()}
    assert {r.event_id for r in held.collect()} == {e for e, o in last.items() if o == "INTERVENE"}
