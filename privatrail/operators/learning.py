"""Learning from responses: streaks, rules, suggestions, remembered answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from privatrail.dims.categories import PROTECTED_ROOTS
from privatrail.dims.decisions import ACTIVE_STREAK, AUTOMATABLE, KEEP_SITES, SUGGEST_AFTER_SITES


def is_protected(category: Column) -> Column:
    return F.substring_index(category, ".", 1).isin(PROTECTED_ROOTS)


#: Answers of one key are taken in stretches of this many microseconds, so that a busy key is spread over them.
STRETCH_US = 6 * 3_600_000_000


def rule_state(responses: DataFrame) -> DataFrame:
    """Per user, category and purpose: decisions made and the current run of ``continue``.

    Each stretch of time of a key is reduced to a summary: how many answers, how many of them trail as ``continue``, and
    whether all are. Summaries merge in order: a stretch that is ``continue`` throughout adds to the run behind it, any
    other starts it anew. The answers move once, and a key holding most of them is spread over its stretches.
    """
    key = ["user_id", "category", "purpose"]
    flat = responses.select(
        "user_id", "purpose", F.explode("categories").alias("category"), "us", "event_id", "seq",
        F.floor(F.col("us") / STRETCH_US).alias("stretch"), (F.col("action") == "continue").alias("goes_on"),
    )
    inside = Window.partitionBy(*key, "stretch").orderBy("us", "event_id", "seq")
    numbered = flat.select(*key, "stretch", "goes_on", F.row_number().over(inside).alias("no"))
    summaries = numbered.groupBy(*key, "stretch").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(~F.coalesce("goes_on", F.lit(False)), F.col("no"))), F.lit(0)).alias("last_other")
    )
    # a row per stretch of time with answers: few whatever the key
    merged = summaries.groupBy(*key).agg(
        F.sum("n").alias("total_decisions"), F.sort_array(F.collect_list(F.struct("stretch", "n", "last_other"))).alias("parts")
    )
    run = F.aggregate(
        "parts", F.lit(0).cast("long"), lambda run, x: F.when(x["last_other"] == 0, run + x["n"]).otherwise(x["n"] - x["last_other"])
    )
    return merged.select(*key, "total_decisions", run.alias("consecutive_continue"))


def active_rules(state: DataFrame) -> DataFrame:
    return state.where(
        (F.col("consecutive_continue") >= ACTIVE_STREAK) & ~is_protected(F.col("category"))
    ).select("user_id", "category", "purpose")


def _automatable(responses: DataFrame) -> DataFrame:
    return (
        responses.where(F.col("action").isin(AUTOMATABLE) & (F.col("requester_key") != ""))
        .groupBy("user_id", "action", "requester_key")
        .agg(F.min(F.struct("us", "event_id", "seq")).alias("first_seen"))
    )


def suggestions(responses: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """Protective actions taken on enough distinct sites to offer as a default.

    ``closed`` (user_id, action) holds what was already suggested, declined or made automatic.
    """
    sites = _automatable(responses)
    counted = sites.groupBy("user_id", "action").agg(
        F.count("*").alias("sites")
    ).where(F.col("sites") >= SUGGEST_AFTER_SITES)
    return counted if closed is None else counted.join(closed, ["user_id", "action"], "left_anti")


def remembered_sites(responses: DataFrame, most: int = KEEP_SITES) -> DataFrame:
    """The last ``most`` sites per user and action, by first sight."""
    w = Window.partitionBy("user_id", "action").orderBy(F.col("first_seen").desc())
    return _automatable(responses).withColumn("rank", F.row_number().over(w)).where(
        F.col("rank") <= most
    ).select("user_id", "action", "requester_key", "rank")


def overrides(responses: DataFrame) -> DataFrame:
    """The last answer given with 'remember', per user and requester."""
    last = F.max_by("action", F.struct("us", "event_id", "seq"))
    return (
        responses.where("remember")
        .groupBy("user_id", "requester_key")
        .agg(F.when(last == "continue", "allow").otherwise("ask").alias("override"))
    )


def expected_permissions(responses: DataFrame) -> DataFrame:
    """Union of the categories of everything marked as expected, one row per category."""
    return (
        responses.where("action = 'mark_expected'")
        .select("user_id", "requester_key", F.explode("categories").alias("category"))
        .distinct()
    )


def valid_responses(responses: DataFrame, offered: DataFrame) -> DataFrame:
    """Responses whose action was offered; of several, the first answer counts."""
    first = responses.join(offered.select("event_id", "actions"), "event_id").where(
        F.array_contains("actions", F.col("action"))
    )
    return first.groupBy("event_id").agg(F.min_by("action", F.struct("us", "seq")).alias("action"))
