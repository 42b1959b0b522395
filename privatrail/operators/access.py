"""Access monitoring over tables of grants, manifests, startup items and clipboard events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from privatrail.operators.timeline import before
from privatrail.dims.web import (
    EXTENSION_ACCESSES,
    PERMISSION_CATEGORIES,
    SYSTEM_BUNDLE_PREFIX,
    SYSTEM_IDENTITIES,
    SYSTEM_PATHS,
    USER_FACING_BUNDLES,
)

MANIFEST = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("permissions", T.ArrayType(T.StringType())),
    T.StructField("host_permissions", T.ArrayType(T.StringType())),
])


def permission_category(permission: Column) -> Column:
    pairs = [F.lit(x) for kv in PERMISSION_CATEGORIES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), permission)


def breadth(n: Column) -> Column:
    return F.least(F.lit(1.0), n / F.lit(3.0))


def extension_access(manifests: DataFrame) -> DataFrame:
    """What each extension manifest (bundle_id, manifest JSON) can reach; harmless ones drop out."""
    m = F.from_json("manifest", MANIFEST)
    none = F.array().cast("array<string>")
    perms = F.concat(F.coalesce(m["permissions"], none), F.coalesce(m["host_permissions"], none))
    accesses = F.sort_array(F.array_intersect(perms, F.array(*map(F.lit, EXTENSION_ACCESSES))))
    watching = F.arrays_overlap("accesses", F.array(F.lit("tabs"), F.lit("webRequest"), F.lit("<all_urls>")))
    categories = F.array_compact(
        F.array(
            F.when(F.array_contains("accesses", "history"), "browser_history"),
            F.when(F.array_contains("accesses", "clipboardRead"), "clipboard"),
            F.when(watching, "browsing_activity"),
        )
    )
    return (
        manifests.select("bundle_id", m["name"].alias("name"), accesses.alias("accesses"))
        .where(F.size("accesses") > 0)
        .withColumn("categories", categories)
        .withColumn("breadth", breadth(F.size("accesses")))
    )


def is_system_component(bundle_id: Column, exe_path: Column) -> Column:
    """Part of the operating system: nobody can explain or revoke it app by app."""
    identity = F.lower(F.trim(bundle_id))
    path = F.regexp_replace(F.lower(F.trim(exe_path)), r"\\", "/")
    facing = [SYSTEM_BUNDLE_PREFIX + name for name in USER_FACING_BUNDLES]
    known = F.lit(False)
    for prefix in SYSTEM_IDENTITIES:
        known = known | F.startswith(identity, F.lit(prefix))
    under = F.lit(False)
    for prefix in SYSTEM_PATHS:
        under = under | F.startswith(path, F.lit(prefix))
    return F.when(F.startswith(identity, F.lit(SYSTEM_BUNDLE_PREFIX)), ~identity.isin(facing)).otherwise(known | under)


def grant_changes(snapshots: DataFrame) -> DataFrame:
    """New, changed and removed grants between consecutive snapshots of each user.

    A user's snapshots are the distinct days seen for them. Each row is compared with the
    row of the same client and service one snapshot earlier, found by an equi join on the
    snapshot's number, so a busy user's history is not one ordered pass in one task.
    """
    key = ["user_id", "client", "service"]
    days = snapshots.select("user_id", "day").distinct()
    w = Window.partitionBy("user_id").orderBy("day")
    numbered = days.withColumn("snap", F.row_number().over(w))
    ends = numbered.groupBy("user_id").agg(F.max("snap").alias("last_snap"))
    rows = snapshots.join(numbered, ["user_id", "day"])
    previous = rows.select(
        *key, (F.col("snap") + 1).alias("snap"), F.col("auth_value").alias("old_auth"), F.col("last_modified").alias("old_modified"),
        F.lit(True).alias("had"),
    )
    both = rows.withColumn("has", F.lit(True)).drop("day").join(previous, [*key, "snap"], "full_outer").join(ends, "user_id")
    change = (
        F.when(F.col("has").isNull(), "removed")
        .when(F.col("snap") == 1, "standing")
        .when(F.col("had").isNull(), "new")
        .when(
            F.col("auth_value").eqNullSafe(F.col("old_auth")) & F.col("last_modified").eqNullSafe(F.col("old_modified")), "same"
        )
        .otherwise("changed")
    )
    return (
        both.where(F.col("snap") <= F.col("last_snap"))
        .withColumn("change", change)
        .where("change <> 'same'")
        .select(
            *key, "snap", "change",
            F.when(F.col("auth_value").isin("1", "2", "3"), "granted").otherwise("denied").alias("state"),
            permission_category(F.col("service")).alias("category"),
        )
        .where("category IS NOT NULL")
    )


def access_breadth(snapshots: DataFrame) -> DataFrame:
    """Per user, day and client: how much of the system the granted services reach."""
    granted = snapshots.where(F.col("auth_value").isin("1", "2", "3")).withColumn("category", permission_category(F.col("service")))
    return (
        granted.where("category IS NOT NULL")
        .groupBy("user_id", "day", "client")
        .agg(F.count_distinct("category").alias("categories"))
        .withColumn("breadth", breadth(F.col("categories")))
    )


def clipboard_exposures(copies: DataFrame, focus: DataFrame, allowlist: DataFrame, bucket_us: int = 86_400_000_000) -> DataFrame:
    """Focus moving to an application that did not write the sensitive clipboard content.

    As-of join of focus changes to the last copy and the last focus before them.
    """
    c = copies.select(
        "user_id", "us", "event_id", F.lit(None).cast("string").alias("requester_key"),
        F.struct("writer_key", "categories", "cloud_sync", F.col("event_id").alias("copy_id")).alias("clip"),
    )
    f = focus.select("user_id", "us", "event_id", "requester_key", F.lit(None).cast(c.schema["clip"].dataType).alias("clip"))
    merged = before(
        c.unionByName(f), ["user_id"], ["us", "event_id"],
        {"last_clip": F.col("clip"), "last_focus": F.col("requester_key")},
        F.floor(F.col("us") / bucket_us),
    )
    exposed = merged.where(
        F.col("requester_key").isNotNull()
        & ~F.col("requester_key").eqNullSafe(F.col("last_focus"))
        & (F.size("last_clip.categories") > 0)
        & (F.col("requester_key") != F.col("last_clip.writer_key"))
    )
    return exposed.join(allowlist, ["user_id", "requester_key"], "left_anti").select(
        "user_id", "event_id", "us", "requester_key", "last_clip.writer_key", "last_clip.copy_id", "last_clip.categories", "last_clip.cloud_sync"
    )
