"""Tracking signals per site from request, cookie, API-call and storage logs.

Every signal first reduces its log to (site, something small) with a combining aggregate, so a
site with a large share of all rows is merged before the shuffle and never collected whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from privatrail.dims import web as W
from privatrail.functions import urls as U
from privatrail.operators.domains import tracker_hosts


def _first(seen: DataFrame, most: int | None, newest: bool) -> DataFrame:
    """All rows, or a site's first or newest ``most`` where the caller asks for that."""
    if most is None:
        return seen
    order = F.col("first_id").desc() if newest else F.col("first_id")
    return seen.withColumn("_rank", F.row_number().over(Window.partitionBy("site").orderBy(order))).where(F.col("_rank") <= most).drop("_rank")


def snapshot_hosts(requests: DataFrame, most: int | None = None) -> DataFrame:
    """(site, host, first_id): the distinct hosts of each site."""
    return _first(requests.groupBy("site", "host").agg(F.min("event_id").alias("first_id")), most, newest=True)


def snapshot_urls(requests: DataFrame, most: int | None = None) -> DataFrame:
    """(site, url, first_id): the distinct addresses of each site."""
    return _first(requests.groupBy("site", "url").agg(F.min("event_id").alias("first_id")), most, newest=False)


def _hosts(requests: DataFrame) -> DataFrame:
    """Distinct (site, host) over request hosts, canonical names and URL hosts."""
    return (
        requests.select("site", F.explode(F.array(F.col("host"), F.col("cname"), U.host_of(F.col("url")))).alias("host"))
        .select("site", U.clean_host(F.col("host")).alias("host"))
        .where("host <> ''")
        .distinct()
    )


def known_trackers(requests: DataFrame, trackers: DataFrame) -> DataFrame:
    """(site, host, owner) of listed trackers a site talks to."""
    pairs = _hosts(requests)
    return pairs.join(tracker_hosts(pairs, trackers).where("is_tracker"), "host").select("site", "host", "owner")


def tracking_pixels(requests: DataFrame) -> DataFrame:
    """(site, host) of third-party pixel hosts with a pixel-like request on the same site."""
    site_host = U.host_of(F.col("site"))
    host = F.col("host")
    url = F.col("url")
    pixelish = (U.host_of(url) == F.lower(host)) & (
        F.contains(F.lower(U.path_of(url)), F.lit("pixel")) | U.has_query_key(url, W.PIXEL_KEYS)
    )
    per_host = requests.groupBy("site", "host").agg(F.bool_or("is_pixel").alias("is_pixel"), F.bool_or(pixelish).alias("pixelish"))
    third_party = (host != "") & (host != site_host) & ~F.endswith(host, F.concat(F.lit("."), site_host))
    return per_host.where(F.col("is_pixel") & F.col("pixelish") & third_party).select("site", F.lower("host").alias("host"))


def persistent_cookies(cookies: DataFrame, trackers: DataFrame) -> DataFrame:
    """(site, host, owner) of trackers that keep a third-party cookie for 30 days or more."""
    lasting = cookies.where(F.col("third_party") & (F.col("lifetime_days") >= W.MIN_COOKIE_DAYS))
    pairs = lasting.select("site", U.clean_host(F.col("domain")).alias("host")).distinct()
    return pairs.join(tracker_hosts(pairs, trackers).where("is_tracker"), "host").select("site", "host", "owner")


def url_signals(requests: DataFrame) -> DataFrame:
    """Per site: decorated links, identity linking, beacons."""
    return requests.groupBy("site").agg(
        F.bool_or(U.has_query_key(F.col("url"), W.DECORATION_KEYS)).alias("url_decoration"),
        F.bool_or(F.col("url").rlike(W.IDENTITY_LINK)).alias("identity_linking"),
        F.count_if("is_pixel").alias("pixel_beacons"),
    )


def fingerprinting(api_calls: DataFrame) -> DataFrame:
    """Per site: canvas, audio and enumeration fingerprinting."""
    def any_of(names: list[str]):
        return F.bool_or(F.col("call").isin(names))

    enum = F.count_distinct(F.when(F.col("call").isin(W.ENUMERATION), F.col("call")))
    flags = api_calls.groupBy("site").agg(
        (any_of(W.CANVAS_READ) & any_of(W.CANVAS_WRITE)).alias("canvas"),
        (any_of(W.AUDIO_CONTEXT) & any_of(W.AUDIO_READ)).alias("audio"),
        (enum >= 3).alias("enumeration"),
    )
    return flags.withColumn("fingerprinting", F.col("canvas") | F.col("audio") | F.col("enumeration"))


def shared_storage(storage_ids: DataFrame) -> DataFrame:
    """(origin, shared): identifiers of an origin that other origins hold too."""
    pairs = storage_ids.select("hash", "origin").distinct()
    wide = pairs.groupBy("hash").agg(F.count("*").alias("origins")).where("origins > 1").select("hash")
    return pairs.join(wide, "hash", "left_semi").groupBy("origin").agg(F.count("*").alias("shared"))


def cname_cloaking(requests: DataFrame, trackers: DataFrame) -> DataFrame:
    """Sites reaching a tracker behind an alias of their own."""
    pairs = requests.where("cname IS NOT NULL").select("site", U.clean_host(F.col("cname")).alias("host")).distinct()
    hit = tracker_hosts(pairs, trackers).where("is_tracker").select("host")
    return pairs.join(hit, "host", "left_semi").select("site").distinct()


def _met(requests: DataFrame, cookies: DataFrame) -> DataFrame:
    """(site, host) with how they met, and on the row of a request's own host what its address shows: one pass over
    requests. Hosts may be empty; such rows only carry their site."""
    host, url, site_host = F.col("host"), F.col("url"), U.host_of(F.col("site"))
    third = F.coalesce((host != "") & (host != site_host) & ~F.endswith(host, F.concat(F.lit("."), site_host)), F.lit(False))
    pixelish = (U.host_of(url) == F.lower(host)) & (F.contains(F.lower(U.path_of(url)), F.lit("pixel")) | U.has_query_key(url, W.PIXEL_KEYS))
    names = ["request", "alias", "marked", "pixelish", "cookie", "decorated", "linked"]

    def entry(name, **flags):
        return F.struct(
            F.coalesce(U.clean_host(name), F.lit("")).alias("host"),
            *[F.coalesce(flags.get(n, F.lit(False)), F.lit(False)).alias(n) for n in names],
            F.coalesce(flags.get("beacon", F.lit(False)), F.lit(False)).cast("long").alias("beacons"),
        )

    yes = F.lit(True)
    own = entry(
        host, request=yes, marked=F.col("is_pixel") & third, pixelish=pixelish & third, decorated=U.has_query_key(url, W.DECORATION_KEYS),
        linked=url.rlike(W.IDENTITY_LINK), beacon=F.col("is_pixel"),
    )
    others = F.filter(
        F.array(entry(F.col("cname"), request=yes, alias=F.col("cname").isNotNull()), entry(U.host_of(url), request=yes)), lambda e: e["host"] != ""
    )
    met = requests.select("site", F.explode(F.concat(F.array(own), others)).alias("e")).select("site", "e.*")
    lasting = F.col("third_party") & (F.col("lifetime_days") >= W.MIN_COOKIE_DAYS)
    kept = cookies.select("site", entry(F.when(lasting, F.col("domain")), cookie=lasting).alias("e")).select("site", "e.*")
    return met.unionByName(kept).groupBy("site", "host").agg(*[F.bool_or(n).alias(n) for n in names], F.sum("beacons").alias("beacons"))


def analyze_tracking(
    requests: DataFrame, cookies: DataFrame, api_calls: DataFrame, storage_ids: DataFrame, trackers: DataFrame
) -> DataFrame:
    """One row per site: signals, companies (not hosts), confidence.

    All hosts a site meets become one (site, host) table in one pass, its distinct hosts are matched with the list once,
    and what the four logs say of a site meets in one aggregate.
    """
    met = _met(requests, cookies)
    named = met.join(tracker_hosts(met, trackers), "host", "left")
    tracked = F.coalesce(F.col("is_tracker"), F.lit(False))
    hit = (F.col("host") != "") & (tracked | (F.col("marked") & F.col("pixelish")))
    per_site = named.groupBy("site").agg(
        F.count_if(hit).alias("n_hosts"),
        F.sort_array(F.collect_set(F.when(hit, F.col("owner")))).alias("tracker_domains"),
        F.bool_or(F.col("cookie") & tracked).alias("lasting"),
        F.bool_or(F.col("alias") & tracked).alias("cloaked"),
        F.bool_or("decorated").alias("url_decoration"),
        F.bool_or("linked").alias("identity_linking"),
        F.sum("beacons").alias("pixel_beacons"),
    )
    shared = shared_storage(storage_ids).withColumnRenamed("origin", "site")
    everything = per_site
    for part in (fingerprinting(api_calls).select("site", "fingerprinting"), shared, storage_ids.select(F.col("origin").alias("site")).distinct()):
        everything = everything.unionByName(part, allowMissingColumns=True)
    joined = everything.groupBy("site").agg(*[F.max(c).alias(c) for c in everything.columns if c != "site"])
    has = F.coalesce(F.col("n_hosts"), F.lit(0)) > 0
    signals = F.array_compact(
        F.array(
            F.when(F.col("lasting"), "persistent_third_party_cookies"),
            F.when(has, "known_tracker_requests"),
            F.when(F.col("url_decoration"), "url_decoration"),
            F.when(F.col("fingerprinting"), "fingerprinting"),
            F.when(F.col("shared") > 0, "cross_origin_storage_identifier"),
            F.when(F.col("cloaked"), "cname_cloaking"),
            F.when((F.col("pixel_beacons") > 0) & has, "tracking_pixels"),
            F.when(F.col("identity_linking"), "identity_linking"),
        )
    )
    n = F.size("signals")
    score = F.lit(0.35) + n * 0.12 + F.least(F.coalesce("n_hosts", F.lit(0)), F.lit(4)) * 0.05
    return joined.withColumn("signals", signals).select(
        "site",
        (n > 0).alias("detected"),
        "signals",
        F.coalesce("tracker_domains", F.array().cast("array<string>")).alias("tracker_domains"),
        F.coalesce("fingerprinting", F.lit(False)).alias("fingerprinting"),
        F.when(n > 0, F.least(F.lit(0.99), score)).otherwise(0.0).alias("confidence"),
    )
