"""Streams: coalescing, timeouts, liveness, late results, windowed counts.

The functions run on finished logs too, so a batch run states what a stream must give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from privatrail.dims.decisions import DEFAULT_AFTER_SECONDS, RESOLVED_SECONDS, UNANSWERED_SECONDS


def with_event_time(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros(F.col("us")))


def read_events(spark, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A directory of Parquet files as a stream; any other source with this schema will do."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return with_event_time(reader.parquet(path))


def coalesced(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Notices of (session_id, signature): repeats fold onto the first; the level never falls.

    A notice stays open for an hour after its last event, ten minutes once answered. With a
    watermark this runs on a stream and emits a notice when it has closed.
    """
    gap = F.when(F.col("answered"), f"{RESOLVED_SECONDS} seconds").otherwise(f"{UNANSWERED_SECONDS} seconds")
    open_ = events.where("signature IS NOT NULL")
    if watermark:
        open_ = open_.withWatermark("ts", watermark)
    return open_.groupBy("session_id", "signature", F.session_window("ts", gap).alias("w")).agg(
        F.min_by("event_id", F.struct("us", "event_id")).alias("notice_id"),
        F.count("*").alias("events"),
        F.max("level").alias("level"),
        F.bool_or("answered").alias("answered"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
    ).drop("w")


def notice_log(events: DataFrame, responses: DataFrame) -> DataFrame:
    """One log of signed events and of the first answers to them, by (session, signature): what ``notice_stream`` reads."""
    signed = events.where("signature IS NOT NULL").select("session_id", "signature", "us", "event_id", F.col("level").cast("int").alias("level"))
    first = responses.groupBy("event_id").agg(F.min("us").alias("answered_us"))
    answers = signed.drop("us", "level").join(first, "event_id").select("session_id", "signature", F.col("answered_us").alias("us"), "event_id", F.lit(None).cast("int").alias("level"))
    return signed.withColumn("is_event", F.lit(True)).unionByName(answers.withColumn("is_event", F.lit(False)))


def _islands(events: DataFrame, responses: DataFrame) -> DataFrame:
    """Signed events with ``island``, the notice of their (session, signature) that they belong to. A warning keeps its
    notice open for an hour; once answered, until ten minutes after it came or until the answer, whichever is later. An
    event that warns of nothing keeps it open for ten minutes."""
    first = responses.groupBy("event_id").agg(F.min("us").alias("answered_us"))
    hour, short = UNANSWERED_SECONDS * 1_000_000, RESOLVED_SECONDS * 1_000_000
    in_time = (F.col("level") > 0) & (F.col("answered_us") < F.col("us") + hour)
    open_ = events.where("signature IS NOT NULL").select("session_id", "signature", "us", "event_id", F.col("level").cast("int").alias("level")).join(first, "event_id", "left")
    open_ = open_.withColumn("answer", F.when(in_time, F.col("answered_us"))).withColumn(
        "until", F.when(F.col("level") <= 0, F.col("us") + short).when(F.col("answer").isNotNull(), F.greatest(F.col("us") + short, "answer")).otherwise(F.col("us") + hour)
    )
    own = Window.partitionBy("session_id", "signature").orderBy("us", "event_id")
    earlier = F.max("until").over(own.rowsBetween(Window.unboundedPreceding, -1))
    return open_.withColumn("fresh", (F.col("us") >= F.coalesce(earlier, F.col("us"))).cast("int")).withColumn("island", F.sum("fresh").over(own))


def fold_events(events: DataFrame, responses: DataFrame) -> DataFrame:
    """What each event gets: the notice it belongs to, the notice's level so far, and whether it is ignored because the
    notice was answered before. events: session_id, signature, us, event_id, level. Batch twin of
    ``stateful.notice_stream``; unsigned events are notices of their own."""
    notice = Window.partitionBy("session_id", "signature", "island").orderBy("us", "event_id")
    answered = F.min("answer").over(notice.rowsBetween(Window.unboundedPreceding, -1))
    folded = _islands(events, responses).select(
        "event_id",
        F.first("event_id").over(notice).alias("notice_id"),
        F.max("level").over(notice).alias("level"),
        F.coalesce(answered < F.col("us"), F.lit(False)).alias("ignored"),
    )
    alone = events.where("signature IS NULL").select("event_id", F.col("event_id").alias("notice_id"), F.col("level").cast("int").alias("level"), F.lit(False).alias("ignored"))
    return folded.unionByName(alone)


def closed_notices(events: DataFrame, responses: DataFrame) -> DataFrame:
    """Every notice with its highest level, whether it was answered, its events, and when it opens and closes."""
    return _islands(events, responses).groupBy("session_id", "signature", "island").agg(
        F.min_by("event_id", F.struct("us", "event_id")).alias("notice_id"), F.max("level").alias("level"), F.max("answer").isNotNull().alias("answered"),
        F.count(F.lit(1)).alias("events"), F.min("us").alias("first_us"), F.max("until").alias("closes_us"),
    ).drop("island")


def expiry(notices: DataFrame, asof_us: int) -> DataFrame:
    """When each notice closes, and whether it is open at a time."""
    return notices.select("notice_id", "closes_us", ((F.col("first_us") <= asof_us) & (F.col("closes_us") > asof_us)).alias("is_open"))


def session_log(events: DataFrame, pending: DataFrame, responses: DataFrame) -> DataFrame:
    """One log of a session's events, those that are held with their default, and the answers to these: what
    ``session_stream`` reads. pending: event_id, waits (a page waits for the answer), default_action."""
    held = pending.select("event_id", "waits", "default_action")
    beats = events.select("session_id", "us", "event_id").join(held, "event_id", "left").withColumn("is_beat", F.lit(True))
    owner = beats.where("default_action IS NOT NULL").select("event_id", "session_id")
    answers = responses.select("event_id", "us").join(owner, "event_id")
    none = answers.withColumn("is_beat", F.lit(False)).withColumn("waits", F.lit(None).cast("boolean")).withColumn("default_action", F.lit(None).cast("string"))
    return beats.unionByName(none)


def settled(pending: DataFrame, live: DataFrame, responses: DataFrame, gap_us: int, seconds: int = DEFAULT_AFTER_SECONDS) -> DataFrame:
    """What becomes of held events that nobody answers: the default is taken for a waiting page in time, or the event is
    aborted when its session ends before. Batch twin of ``session_stream``. pending: session_id, event_id, us, waits,
    default_action; live: what ``sessions`` gives."""
    first = responses.groupBy("event_id").agg(F.min("us").alias("answered_us"))
    spans = live.select("session_id", "opened_us", "last_us", (F.col("last_us") + gap_us).alias("over_us"))
    met = pending.join(spans, "session_id").where(F.col("us").between(F.col("opened_us"), F.col("last_us"))).join(first, "event_id", "left")
    patience = F.when(F.col("waits"), F.col("us") + seconds * 1_000_000)
    met = met.withColumn("taken_us", F.least(patience, "over_us")).withColumn("status", F.when(F.col("taken_us") == F.col("over_us"), "aborted").otherwise("defaulted"))
    late = F.col("answered_us").isNull() | (F.col("answered_us") > F.col("taken_us"))
    return met.where(late).select("session_id", "event_id", "status", "default_action", "taken_us")


def ended(pending: DataFrame, live: DataFrame, responses: DataFrame, gap_us: int) -> DataFrame:
    """Pending events whose session fell silent before anyone answered: they are aborted, and take their default when
    the session is known to be over. pending: event_id, session_id, us, default_action; live: what ``sessions`` gives."""
    first = responses.groupBy("event_id").agg(F.min("us").alias("answered_us"))
    spans = live.select("session_id", "opened_us", "last_us", (F.col("last_us") + gap_us).alias("over_us"))
    inside = F.col("us").between(F.col("opened_us"), F.col("last_us"))
    met = pending.join(spans, "session_id").where(inside).join(first, "event_id", "left")
    late = F.col("answered_us").isNull() | (F.col("answered_us") > F.col("over_us"))
    return met.where(late).select("event_id", F.lit("aborted").alias("status"), "default_action", F.col("over_us").alias("taken_us"))


def timed_out(pending: DataFrame, responses: DataFrame, seconds: int = DEFAULT_AFTER_SECONDS) -> DataFrame:
    """Held events nobody answered in time take their default action."""
    first = responses.groupBy("event_id").agg(F.min("us").alias("answered_us"))
    late = F.col("answered_us").isNull() | (F.col("answered_us") - F.col("us") > seconds * 1_000_000)
    return pending.join(first, "event_id", "left").where(late).select(
        "event_id", "default_action", (F.col("us") + seconds * 1_000_000).alias("taken_us")
    )


def sessions(beats: DataFrame, gap: str = "5 seconds", watermark: str | None = None) -> DataFrame:
    """Live stretches of each session; a longer silence closes it. With a watermark this runs on a stream and emits a
    stretch when it is over."""
    if watermark:
        beats = beats.withWatermark("ts", watermark)
    return beats.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("beats"), F.min("us").alias("opened_us"), F.max("us").alias("last_us")
    ).drop("w")


def split_late(results: DataFrame, limit_us: int) -> tuple[DataFrame, DataFrame]:
    """Results in time, and late ones to be kept as aborted; nothing is lost silently."""
    # a result without a time is not known to be in time
    late = F.coalesce(F.col("result_us") - F.col("us") > limit_us, F.lit(True))
    return results.where(~late), results.where(late).withColumn("status", F.lit("aborted"))


def write_with_late(batch: DataFrame, batch_id: int, limit_us: int, path: str, late_path: str) -> None:
    """For ``foreachBatch``: both sides of the split go to the folder of their batch, which a repeated batch replaces, so
    that no row is there twice."""
    kept, late = split_late(batch, limit_us)
    kept.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    late.write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")


def once_per_digest(documents: DataFrame, watermark: str = "30 days") -> DataFrame:
    """Each text of an origin is analysed once within the watermark (stream)."""
    return documents.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["origin", "digest"])


def once_per_digest_batch(documents: DataFrame) -> DataFrame:
    return documents.groupBy("origin", "digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def windowed_counts(events: DataFrame, width: str = "1 hour", watermark: str | None = None) -> DataFrame:
    """Events per requester and time window; with a watermark it runs on a stream."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    return events.groupBy(F.window("ts", width).alias("w"), "requester_key").agg(F.count("*").alias("n")).select(
        F.unix_micros("w.start").alias("start_us"), "requester_key", "n"
    )
