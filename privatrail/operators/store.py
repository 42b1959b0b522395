"""The event store as tables: sanitised appends, upserts on read, caches, purge, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from privatrail.dims.decisions import (
    FIELD_KEYS,
    RETENTION_DAYS,
    UPLOAD_TTL_SECONDS,
)
from privatrail.dims.patterns import DROPPED_KEYS, HASH_KEYS, ID_KEYS, STORE_PATTERNS
from privatrail.functions import urls as U

DAY_US = 86_400_000_000


def stored_events(events: DataFrame) -> DataFrame:
    """What may be kept of an event: no payload, fields, context or path; public identity only."""
    dropped = [c for c in ("payload_ref", "fields", "context", "exe_path", "text") if c in events.columns]
    return events.drop(*dropped).withColumn(
        "requester_key", U.public_identity(F.col("requester_key"), redact_for_store(F.col("requester_key")))
    )


def upsert_on_read(log: DataFrame, key: str = "event_id", order: str = "seq", keep_first: str = "status") -> DataFrame:
    """Current row per key of an append-only log; ``keep_first`` is not changed by later writes."""
    rest = [c for c in log.columns if c not in (key, keep_first, order)]
    current = log.groupBy(key).agg(
        F.max_by(F.struct(*rest), F.col(order)).alias("r"), F.min_by(keep_first, order).alias(keep_first)
    )
    return current.select(key, "r.*", keep_first)


def append_log(df: DataFrame, path: str, ts_us: str = "us") -> None:
    """Append to a Parquet log partitioned by day."""
    day = F.to_date(F.timestamp_micros(F.col(ts_us)))
    df.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def fold_status(log: DataFrame) -> DataFrame:
    """Event status from its transitions: ``complete`` counts only while pending."""
    setting = F.col("transition").isin("pending", "aborted")
    folded = log.groupBy("event_id").agg(
        F.max_by(F.when(setting, F.col("transition")), F.when(setting, F.col("seq"))).alias("last_set"),
        F.max(F.when(setting, F.col("seq"))).alias("set_at"),
        F.max(F.when(F.col("transition") == "complete", F.col("seq"))).alias("done_at"),
    )
    return folded.select(
        "event_id",
        F.when(F.col("last_set").isNull(), "complete")
        .when((F.col("last_set") == "pending") & (F.col("done_at") > F.col("set_at")), "complete")
        .otherwise(F.col("last_set"))
        .alias("status"),
    )


def uncached(docs: DataFrame, cache: DataFrame, asof_us: int) -> DataFrame:
    """Documents still to be analysed: no live cache entry for the same origin and text."""
    live = cache.where(F.col("expires_us") > asof_us).select("origin", "digest")
    return docs.withColumn("digest", F.sha2("text", 256)).join(live, ["origin", "digest"], "left_anti")


def purge(
    events: DataFrame, children: DataFrame, asof_us: int, days: int = RETENTION_DAYS
) -> tuple[DataFrame, DataFrame]:
    """Events inside the retention window, and the child rows of those events."""
    kept = events.where(F.col("us") >= asof_us - days * DAY_US)
    return kept, children.join(kept.select("event_id"), "event_id", "left_semi")


PREFERENCES = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("preferences", T.MapType(T.StringType(), T.StringType())),
])


def export_preferences(prefs: DataFrame, version: int | Column = 1) -> DataFrame:
    """One JSON document per user."""
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "preference"))))
    grouped = prefs.groupBy("user_id").agg(entries.alias("preferences"))
    v = F.lit(version) if isinstance(version, int) else version
    return grouped.select(
        "user_id", F.to_json(F.struct(v.cast("int").alias("version"), "user_id", "preferences")).alias("document")
    )


def import_preferences(documents: DataFrame) -> DataFrame:
    """Rows of every document in the supported version; others are not imported."""
    parsed = documents.select(F.from_json("document", PREFERENCES).alias("d")).where(
        (F.col("d.version") == 1) & F.col("d.preferences").isNotNull()
    )
    return parsed.select(F.col("d.user_id").alias("user_id"), F.explode("d.preferences").alias("category", "preference"))


def diagnostics(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def sample_long(docs: DataFrame, limit: int, keep: int) -> DataFrame:
    """For callers that want samples only: documents over ``limit`` characters keep their first and last ``keep`` and are
    marked partial. No other operator calls this; analyses read whole texts."""
    long = F.length("text") > limit
    cut = F.concat(F.left("text", F.lit(keep)), F.lit("\n"), F.right("text", F.lit(keep)))
    return docs.withColumn("partial", long).withColumn("text", F.when(long, cut).otherwise(F.col("text")))


MESSAGE = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("file_count", T.LongType()),
    T.StructField("field", T.MapType(T.StringType(), T.StringType())),
    T.StructField("_corrupt", T.StringType()),
])
EVENT_TYPES = [
    "file_upload", "form_observed", "form_submit", "consent_banner", "policy_document", "tracking", "permission_request",
    "system_access", "clipboard_read", "screen_capture", "startup_registration", "redacted_document", "deep_check",
]


def validate_messages(raw: DataFrame, body: str = "body", max_bytes: int | None = None) -> DataFrame:
    """Parse JSON messages against the closed schema; adds ``reasons`` (empty when valid).

    Rows with reasons belong in quarantine, the others go on. ``max_bytes`` adds a limit of the receiving channel
    (MESSAGE_MAX_BYTES for the host bridge); without it any size is read.
    """
    allowed = F.array(*[F.lit(f.name) for f in MESSAGE.fields if f.name != "_corrupt"])
    parsed = raw.withColumn(
        "m", F.from_json(body, MESSAGE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    ).withColumn("keys", F.json_object_keys(body))
    m = F.col("m")
    extra = F.size(F.array_except("keys", allowed)) > 0
    fields = F.size(F.array_except(F.map_keys(m["field"]), F.array(*map(F.lit, FIELD_KEYS)))) > 0

    def reason(test: Column, name: str) -> Column:
        return F.when(test, F.lit(name))

    malformed = F.col("keys").isNull() | m["_corrupt"].isNotNull()
    checks = [
        reason(F.octet_length(body) > max_bytes if max_bytes else F.lit(False), "too_large"),
        reason(malformed, "malformed"),
        reason(~malformed & extra, "unknown_key"),
        reason(~malformed & fields, "field_key"),
        reason(~malformed & ~F.coalesce(m["event_type"], F.lit("")).isin(EVENT_TYPES), "event_type"),
        reason(~malformed & ~m["confidence"].between(0, 1), "confidence"),
        reason(~malformed & (m["file_count"] < 1), "file_count"),
    ]
    return parsed.withColumn("reasons", F.array_compact(F.array(*checks))).drop("keys")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    good = F.size("reasons") == 0
    return validated.where(good).drop("reasons"), validated.where(~good)


def html_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags become spaces."""
    out = html
    for tag in ("script", "style", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[\s\S]*?</{tag}>", " ")
    return F.regexp_replace(out, "<[^>]+>", " ")


def public_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``text``, the visible text of the whole page."""
    return pages.withColumn("text", html_text(F.col(html)))


def checked_trackers(candidates: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """One row on a supplied tracker list: ``n`` distinct entries, ``malformed`` ones, ``ok`` and the ``reason`` why not.
    The list itself is never changed or exchanged; bounds are the caller's."""
    bad = F.coalesce(~F.col("domain").rlike("^[a-z0-9.-]+$"), F.lit(True))
    counted = candidates.select("domain").distinct().agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("malformed"))
    reason = F.when(F.col("malformed") > 0, "malformed")
    if low is not None:
        reason = reason.when(F.col("n") < low, "too_short")
    if high is not None:
        reason = reason.when(F.col("n") > high, "too_long")
    reason = F.coalesce(reason, F.lit(""))
    return counted.withColumn("ok", reason == "").withColumn("reason", reason)


def reassemble_uploads(chunks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Chunks to whole uploads: contiguous from 0, right size, no pause between two chunks above the time limit.

    Totals are checked first; only the parts of uploads that pass are put together.
    """
    order = Window.partitionBy("upload_id").orderBy("seq", "us")
    pause = F.col("us") - F.lag("us").over(order)
    totals = chunks.select("upload_id", "seq", F.length("data").alias("length"), pause.alias("pause")).groupBy("upload_id").agg(
        (F.count("*") == F.max("seq") + 1).alias("contiguous"),
        F.sum("length").alias("received"),
        (F.coalesce(F.max("pause"), F.lit(0)) <= UPLOAD_TTL_SECONDS * 1_000_000).alias("in_time"),
    )
    good = F.coalesce(F.col("contiguous") & (F.col("received") == F.col("size")) & F.col("in_time"), F.lit(False))
    judged = sizes.join(totals, "upload_id", "left").select("upload_id", good.alias("good"))
    parts = chunks.join(judged.where("good").select("upload_id"), "upload_id", "left_semi").groupBy("upload_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "data"))).alias("parts")
    )
    return judged.join(parts, "upload_id", "left").select(
        "upload_id",
        F.when(F.col("good"), "complete").otherwise("aborted").alias("status"),
        F.array_join(F.transform("parts", lambda p: p["data"]), "").alias("content"),
    )


def redact_for_store(text: Column, scanned: Column | None = None) -> Column:
    """Stored text: URLs to origins, placeholders renamed, then the second-pass patterns.

    ``scanned`` is the text after span redaction where the caller has run it.
    """
    value = text if scanned is None else scanned
    value = F.regexp_replace(
        value, r"(https?://)(?:[^\s<>\"'/?#@]*@)?([^\s<>\"'/?#]*)[^\s<>\"']*", "$1$2"
    )
    # <FULL_NAME> becomes <redacted:full_name>: only the placeholder's own letters are lowered
    parts = F.split(F.regexp_replace(value, r"<([A-Z_]+(?:\.[A-Z_]+)*)>", "\u0001$1\u0001"), "\u0001", -1)
    renamed = F.array_join(
        F.transform(
            parts,
            lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("<redacted:"), F.lower(x), F.lit(">"))).otherwise(x),
        ),
        "",
    )
    value = F.when(F.contains(value, F.lit("<")), renamed).otherwise(value)
    for category, pattern in STORE_PATTERNS:
        value = F.regexp_replace(value, pattern, f"<redacted:{category}>")
    return value


def sanitize_schema(df: DataFrame) -> DataFrame:
    """Schema-driven sanitiser: walks the schema on the driver and emits one projection.

    Payload keys are dropped, well-formed ids, hashes and timestamps stay, paths are hashed
    and every other string is redacted, at any depth.
    """
    uuid = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

    def clean(col: Column, kind: T.DataType, name: str) -> Column:
        if isinstance(kind, T.StringType):
            safe = F.when(U.is_path(col), U.public_identity(col)).otherwise(redact_for_store(col))
            if name in ID_KEYS:
                return F.when(col.rlike(uuid), col).otherwise(safe)
            if name in HASH_KEYS:
                return F.when(col.rlike("(?i)^[0-9a-f]{64}$"), col).otherwise(safe)
            if name == "ts":
                return F.when(F.try_to_timestamp(col).isNotNull(), col).otherwise(safe)
            return safe
        if isinstance(kind, T.StructType):
            kept = [
                clean(col[f.name], f.dataType, f.name).alias(f.name)
                for f in kind.fields
                if f.name not in DROPPED_KEYS
            ]
            return F.when(col.isNotNull(), F.struct(*kept))
        if isinstance(kind, T.ArrayType):
            return F.transform(col, lambda x: clean(x, kind.elementType, name))
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            kept = F.map_filter(col, lambda k, v: ~k.isin(DROPPED_KEYS))
            return F.transform_values(kept, lambda k, v: clean(v, kind.valueType, ""))
        return col

    return df.select(
        *[clean(F.col(f.name), f.dataType, f.name).alias(f.name) for f in df.schema.fields if f.name not in DROPPED_KEYS]
    )
