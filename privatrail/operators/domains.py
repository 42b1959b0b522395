"""Hosts, owning domains and requester purposes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privatrail.dims.categories import purposes
from privatrail.dims.web import PURPOSE_KEYWORDS
from privatrail.functions import urls as U


def longest_listed_suffix(hosts: DataFrame, listed: DataFrame, host: str = "host", keep_tld: bool = True) -> DataFrame:
    """(host, domain): the longest listed suffix of each distinct host on label boundaries.

    Hosts are made distinct first and expanded to their few suffixes, so the match is an
    equi join whatever the list's size; the planner broadcasts the list only if it is small.
    """
    distinct = hosts.select(U.clean_host(F.col(host)).alias("host")).where("host <> ''").distinct()
    n_labels = F.size(F.split("host", r"\."))
    suffixes = distinct.select("host", n_labels.alias("n_labels"), F.explode(U.host_suffixes(F.col("host"))).alias("x")).select(
        "host", "n_labels", F.col("x.n").alias("n"), F.col("x.suffix").alias("domain")
    )
    if not keep_tld:
        suffixes = suffixes.where(F.col("n") < F.greatest(F.lit(1), F.col("n_labels") - 1))
    return suffixes.join(listed.select("domain").distinct(), "domain").groupBy("host").agg(
        F.min_by("domain", "n").alias("domain")
    )


def tracker_hosts(hosts: DataFrame, trackers: DataFrame, host: str = "host") -> DataFrame:
    """Distinct hosts with ``is_tracker`` and the company's ``owner`` domain. The hosts are read once: suffixes that are
    not listed stay, so that every host comes out."""
    distinct = hosts.select(U.clean_host(F.col(host)).alias("host")).where("host <> ''").distinct()
    suffixes = distinct.select("host", F.explode(U.host_suffixes(F.col("host"))).alias("x")).select("host", "x.n", F.col("x.suffix").alias("domain"))
    listed = trackers.select("domain").distinct().withColumn("listed", F.lit(True))
    found = suffixes.join(listed, "domain", "left").groupBy("host").agg(F.min_by(F.when(F.col("listed"), F.col("domain")), F.when(F.col("listed"), F.col("n"))).alias("domain"))
    return found.select(
        "host",
        F.col("domain").isNotNull().alias("is_tracker"),
        F.coalesce("domain", U.registrable_domain(F.col("host"))).alias("owner"),
    )


def curated_purpose(hosts: DataFrame, sites: DataFrame, host: str = "host") -> DataFrame:
    """(host, purpose) from a site list; a bare top-level label never matches."""
    found = longest_listed_suffix(hosts, sites, host, keep_tld=False)
    # a domain listed twice keeps its least purpose, so that no host is multiplied
    named = sites.groupBy("domain").agg(F.min("purpose").alias("purpose"))
    return found.join(named, "domain").select("host", "purpose", "domain")


def keyword_purpose(text: Column) -> Column:
    """struct<purpose, confidence, source> from the words around a page or an app."""
    return F.transform(F.array(F.lower(text)), _purpose_of)[0]


def _purpose_of(lower: Column) -> Column:
    votes = [
        F.struct(F.regexp_count(lower, F.lit("(?iuUd)" + pattern)).alias("n"), F.lit(name).alias("purpose"))
        for name, pattern in PURPOSE_KEYWORDS.items()
    ]

    def decide(best: Column) -> Column:
        scored = F.struct(
            best["purpose"].alias("purpose"),
            F.least(F.lit(0.9), F.lit(0.65) + best["n"] * 0.08).alias("confidence"),
            F.lit("local_signals").alias("source"),
        )
        named = F.coalesce(*[F.when(F.contains(lower, F.lit(p.replace("_", " "))), F.lit(p)) for p in purposes()])
        by_name = F.struct(
            F.coalesce(named, F.lit("unknown")).alias("purpose"),
            F.when(named.isNotNull(), 0.65).otherwise(0.0).alias("confidence"),
            F.when(named.isNotNull(), "category_metadata").otherwise("insufficient_signals").alias("source"),
        )
        return F.when(best["n"] > 0, scored).otherwise(by_name)

    return F.transform(F.array(F.greatest(*votes)), decide)[0]


def page_signals(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with ``host`` and ``signal_text``: the title, description and headings of the page, without markup."""
    page = F.coalesce(F.col(html), F.lit(""))
    title = F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1)
    about = F.regexp_extract(page, r"(?is)<meta[^>]*name=.description.[^>]*content=.([^\"'>]*)", 1)
    heads = F.array_join(F.regexp_extract_all(page, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), " ")
    text = F.regexp_replace(F.concat_ws(" ", title, about, heads), "<[^>]*>", " ")
    return pages.withColumn("host", U.host_of(F.col(url))).withColumn("signal_text", text)


def infer_purpose(requesters: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds ``inferred`` to (host, signal_text): the site list first, then the wording.

    The wording is judged in its row; only the distinct hosts are matched with the list and joined back. A missing
    host or wording counts as empty.
    """
    curated = curated_purpose(requesters.select("host").distinct(), sites).select("host", F.col("purpose").alias("site_purpose"))
    words = keyword_purpose(F.concat_ws(" ", "signal_text", "host"))
    by_list = F.struct(
        F.col("site_purpose").alias("purpose"), F.lit(0.95).alias("confidence"), F.lit("curated_domain").alias("source")
    )
    inferred = F.when(F.col("site_purpose").isNotNull(), by_list).otherwise(words)
    return requesters.join(curated, "host", "left").withColumn("inferred", inferred).drop("site_purpose")


def enrich_requesters(requesters: DataFrame, sites: DataFrame) -> DataFrame:
    """Fill in purpose and confidence only where they are not known yet."""
    known = (F.col("purpose") != "unknown") & (F.col("purpose_confidence") > 0)
    out = infer_purpose(requesters, sites)
    return (
        out.withColumn("purpose_confidence", F.when(known, F.col("purpose_confidence")).otherwise(F.col("inferred.confidence")))
        .withColumn("purpose", F.when(known, F.col("purpose")).otherwise(F.col("inferred.purpose")))
        .drop("inferred")
    )
