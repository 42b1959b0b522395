"""Decisions on a stream: the level rules by stream-static joins, and the 24-hour rate limit with state.

Each has a batch twin that states what the stream must give: ``decide`` itself for the decisions, and
``operators.decisions.rate_limited`` for the rate limit, whose stream is ``stateful.rate_limited_stream``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privatrail.operators import decisions as D


def decide(
    events: DataFrame, necessity: DataFrame, profiles: DataFrame, users: DataFrame, requesters: DataFrame, limited: DataFrame | None = None
) -> DataFrame:
    """Decisions of a batch or a stream of events. All context is static, so every join is stream-static and keeps no
    state; ``limited`` (event_id) is a static table of rate-limited events, if any."""
    judged = D.judge_categories(D.with_context(events, necessity, profiles, users, requesters))
    if limited is None:
        limited = events.sparkSession.createDataFrame([], "event_id long")
    return D.with_urgency(D.decide_events(judged, limited))


def observations(judged: DataFrame, responses: DataFrame) -> DataFrame:
    """One log of what the rate limit looks at: events (side 0) and answers (side 1), by user and kind of observation."""
    signals = F.when(F.col("event_type") == "consent_banner", F.col("dark_patterns")).when(F.col("event_type") == "tracking", F.col("signals"))
    signals = F.coalesce(signals.when(F.col("event_type") == "policy_document", F.col("clauses")), F.array().cast("array<string>"))
    like = F.concat_ws("\u001f", "requester_key", "event_type", F.array_join(F.sort_array("categories"), ","))
    shown = judged.where("event_type <> 'form_observed'").select(
        "user_id", "us", F.lit(0).alias("side"), "event_id", like.alias("like"), F.sort_array(signals).alias("sig"), F.sort_array("red_flags").alias("flags"),
        F.when(F.col("event_type") == "tracking", F.col("confidence")).otherwise(0.0).alias("conf"),
        (F.col("event_type") == "tracking").alias("weighs"), "high_impact",
    )
    none = F.lit(None)
    answered = responses.select(
        "user_id", "us", F.lit(1).alias("side"), "event_id", like.alias("like"), none.cast("array<string>").alias("sig"),
        none.cast("array<string>").alias("flags"), none.cast("double").alias("conf"), none.cast("boolean").alias("weighs"), none.cast("boolean").alias("high_impact"),
    )
    return shown.unionByName(answered)
