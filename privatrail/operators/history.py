"""History and reporting over the event, decision and response logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def latest(log: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Last row per key as a hash aggregate: combines before the shuffle, no sort per key."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*")


def event_history(events: DataFrame, decisions: DataFrame, responses: DataFrame) -> DataFrame:
    """Events with their latest decision and latest response."""
    d = latest(decisions.select("event_id", "seq", "outcome", "risk"), "event_id").drop("seq")
    r = latest(responses.select("event_id", "seq", "action"), "event_id").drop("seq")
    return (
        events.join(d, "event_id", "left")
        .join(r, "event_id", "left")
        .withColumn("action", F.coalesce("action", F.lit("")))
    )


def history(
    events: DataFrame, decisions: DataFrame, responses: DataFrame, limit: int | None = None,
    requester: str | None = None, outcome: str | None = None,
) -> DataFrame:
    """The newest events first: all of them, or ``limit`` where the caller gives one."""
    if requester:
        events = events.where(F.col("requester_key") == requester)
    joined = event_history(events, decisions, responses)
    if outcome:
        joined = joined.where(F.col("outcome") == outcome)
    ordered = joined.orderBy(F.col("us").desc(), F.col("event_id").desc())
    return ordered if limit is None else ordered.limit(limit)


def outcome_counts(decisions: DataFrame) -> DataFrame:
    return latest(decisions.select("event_id", "seq", "outcome"), "event_id").groupBy("outcome").agg(
        F.count("*").alias("n")
    )


def since(events: DataFrame, cache: DataFrame) -> DataFrame:
    """First timestamp seen anywhere. Each side is reduced before the union."""
    return (
        events.agg(F.min("us").alias("us"))
        .unionByName(cache.agg(F.min("created_us").alias("us")))
        .agg(F.min("us").alias("since_us"))
    )


def requesters_by_kind(events: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return events.groupBy("requester_kind").agg(count("requester_key").alias("requesters"))


def tracker_counts(events: DataFrame) -> DataFrame:
    """Distinct (site, tracker) pairs and distinct trackers."""
    pairs = events.where("event_type = 'tracking'").select(
        "requester_key", F.explode("tracker_domains").alias("domain")
    ).distinct()
    return pairs.agg(F.count("*").alias("trackers"), F.count_distinct("domain").alias("networks"))


def tracked_sites(events: DataFrame) -> DataFrame:
    sites = events.where("event_type = 'tracking'").groupBy("requester_key").agg(
        F.bool_or("fingerprinting").alias("fp")
    )
    return sites.agg(
        F.count("*").alias("tracked_sites"), F.count_if("fp").alias("fingerprinting_sites")
    )


def files_checked(events: DataFrame, decisions: DataFrame) -> DataFrame:
    done = events.where("event_type = 'file_upload' AND status = 'complete'").select("event_id", "file_count")
    last = latest(decisions.select("event_id", "seq", "outcome"), "event_id")
    return done.join(last, "event_id", "left").agg(
        F.coalesce(F.sum(F.coalesce("file_count", F.lit(1))), F.lit(0)).alias("files"),
        F.count_if(F.col("outcome").isin("INFORM", "INTERVENE")).alias("sensitive_files"),
    )


def banner_and_grant_counts(events: DataFrame) -> DataFrame:
    """Banners, their sites, distinct grants and the apps holding them, in one scan."""
    per = events.where("event_type IN ('consent_banner', 'permission_request')").groupBy(
        "event_type", "requester_key", F.when(F.col("event_type") == "permission_request", F.col("permission")).alias("permission")
    ).agg(F.count("*").alias("n"))
    banner, grant = F.col("event_type") == "consent_banner", F.col("event_type") == "permission_request"
    return per.agg(
        F.coalesce(F.sum(F.when(banner, F.col("n"))), F.lit(0)).alias("banners"),
        F.count_distinct(F.when(banner, F.col("requester_key"))).alias("banner_sites"),
        F.count_if(grant).alias("grants"),
        F.count_distinct(F.when(grant, F.col("requester_key"))).alias("granted_apps"),
    )


def live_documents(cache: DataFrame, asof_us: int) -> DataFrame:
    """Documents read that have not expired, per kind, with the words in them."""
    return (
        cache.where((F.col("expires_us") > asof_us) & ~F.col("missing"))
        .groupBy("kind")
        .agg(F.count("*").alias("documents"), F.sum("word_count").alias("words"))
    )


def decided_by_action(decisions: DataFrame, responses: DataFrame) -> DataFrame:
    """The answer that counts per event, and how many were authorised in advance."""
    r = latest(responses.select("event_id", "seq", "action"), "event_id").drop("seq")
    d = latest(decisions.select("event_id", "seq", "auto_action"), "event_id").drop("seq")
    return r.join(d, "event_id", "left").groupBy("action").agg(
        F.count("*").alias("n"), F.count_if(F.col("auto_action") == F.col("action")).alias("automatic")
    )


def tally(events: DataFrame, decisions: DataFrame, cache: DataFrame, asof_us: int) -> DataFrame:
    """The overview figures as (metric, value) rows.

    The event log is read once: it is first reduced to one row per distinct combination the
    figures need, and every distinct count is taken from that reduction.
    """
    is_track, is_banner = F.col("event_type") == "tracking", F.col("event_type") == "consent_banner"
    is_grant = F.col("event_type") == "permission_request"
    reduced = events.groupBy(
        "event_type", "requester_kind", "requester_key",
        F.when(is_grant, F.col("permission")).alias("permission"),
        F.when(is_track, F.col("tracker_domains")).alias("tracker_domains"),
        F.when(is_track, F.col("fingerprinting")).alias("fingerprinting"),
    ).agg(F.count("*").alias("n"), F.min("us").alias("first_us"))
    key = F.col("requester_key")

    def dist(*cols: Column) -> Column:
        return F.count_distinct(*cols)

    per_row = reduced.select("*", F.explode_outer("tracker_domains").alias("domain"))
    # an exploded list repeats its group: count banners only on its first element
    figures = per_row.agg(
        F.min("first_us").alias("first_event_us"),
        dist(F.when(F.col("requester_kind") == "website", key)).alias("sites"),
        dist(F.when(F.col("requester_kind") != "website", key)).alias("apps"),
        dist(F.when(F.col("domain").isNotNull(), F.struct(key, F.col("domain")))).alias("trackers"),
        dist(F.col("domain")).alias("tracker_networks"),
        dist(F.when(is_track, key)).alias("tracked_sites"),
        dist(F.when(F.col("fingerprinting"), key)).alias("fingerprinting_sites"),
        F.coalesce(F.sum(F.when(is_banner, F.col("n"))), F.lit(0)).alias("banners"),
        dist(F.when(is_banner, key)).alias("banner_sites"),
        dist(F.when(is_grant, F.struct(key, F.col("permission")))).alias("grants"),
        dist(F.when(is_grant, key)).alias("granted_apps"),
    )
    files = files_checked(events, decisions)
    docs = cache.where((F.col("expires_us") > asof_us) & ~F.col("missing")).agg(
        F.count_if(F.col("kind") == "policy").alias("policies"),
        F.count_if(F.col("kind") == "terms").alias("terms"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("document_words"),
    )

    def long(df: DataFrame) -> DataFrame:
        pairs = [
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in df.columns
        ]
        return df.select(F.inline(F.array(*pairs)))

    return long(figures).unionByName(long(files)).unionByName(long(docs))


def activity_cube(events: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events by class, outcome and day with all subtotals."""
    d = latest(decisions.select("event_id", "seq", "outcome"), "event_id").drop("seq")
    day = F.floor(F.col("us") / 86_400_000_000).alias("day")
    flat = events.select("event_id", "event_type", day).join(d, "event_id", "left")
    # the finest level first: the cube then expands groups, not events
    fine = flat.groupBy("event_type", "outcome", "day").agg(F.count("*").alias("n"))
    return fine.cube("event_type", "outcome", "day").agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n")
    )
