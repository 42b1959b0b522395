"""Consent banners: platform, purposes, dark patterns, vendor counts.

A banner's parts are separate tables keyed by banner_id; each is reduced to one row per
banner before the join. A banner has a handful of buttons and toggles by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privatrail.dims import web as W
from privatrail.functions.validators import quoted


def _search(text: Column, pattern: str) -> Column:
    return text.rlike("(?iuUd)" + pattern)


def cmp_of(selectors: Column, given: Column) -> Column:
    """Consent platform: the first known one whose selectors overlap, else the given name."""
    known = [
        F.when(F.arrays_overlap(selectors, F.array(*[F.lit(s) for s in sel])), F.lit(name))
        for name, sel in W.CMP_SELECTORS
    ]
    return F.coalesce(*known, F.lower(given))


def purposes_in(text: Column) -> Column:
    """Consent purposes a text names, as an array."""
    return F.array_compact(
        F.array(*[F.when(_search(text, p), F.lit(name)) for name, p in W.CONSENT_PURPOSES.items()])
    )


def button_roles(buttons: DataFrame) -> DataFrame:
    """One row per banner: is there an accept, and how do the first accept and reject look."""
    accept = F.col("visible") & ((F.col("role") == "accept") | _search(F.col("text"), W.ACCEPT_WORDS))
    reject = (
        F.col("visible") & (F.col("layer") == 1) & ((F.col("role") == "reject") | _search(F.col("text"), W.REJECT_WORDS))
    )
    look = F.struct("area", "contrast")
    return buttons.groupBy("banner_id").agg(
        F.count("*").alias("n_buttons"),
        F.min_by(F.when(accept, look), F.when(accept, F.col("ord"))).alias("accept"),
        F.min_by(F.when(reject, look), F.when(reject, F.col("ord"))).alias("reject"),
    )


def toggle_facts(toggles: DataFrame) -> DataFrame:
    """One row per banner: folded purposes, pre-ticked optional, legitimate interest on."""
    folded = purposes_in(F.col("purpose"))
    named = F.when(F.size(folded) > 0, folded).otherwise(F.array("purpose"))
    return toggles.groupBy("banner_id").agg(
        F.array_distinct(F.flatten(F.collect_list(named))).alias("toggle_purposes"),
        F.bool_or(F.col("optional") & F.col("enabled") & ~F.col("legitimate_interest")).alias("preticked"),
        F.bool_or(F.col("legitimate_interest") & F.col("enabled")).alias("legitimate"),
    )


def tcf_facts(tcf: DataFrame) -> DataFrame:
    """One row per banner: purposes behind the framework's ids, and optional ones already on."""
    table = "map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in W.TCF_PURPOSES) + ")"
    named = tcf.withColumn("purpose", F.expr(f"try_element_at({table}, purpose_id)")).where("purpose IS NOT NULL")
    return named.groupBy("banner_id").agg(
        F.collect_set("purpose").alias("tcf_purposes"),
        F.bool_or(F.col("enabled") & (F.col("purpose_id") != "1")).alias("tcf_preticked"),
    )


def vendors_in_text(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, "(?i)" + W.VENDORS_IN_TEXT, 1).try_cast("int"), F.lit(0))


def analyze_consent(banners: DataFrame, buttons: DataFrame, toggles: DataFrame, tcf: DataFrame) -> DataFrame:
    """One row per banner: detected, platform, purposes, vendor count, dark patterns."""
    none = F.array().cast("array<string>")
    b = (
        banners.join(button_roles(buttons), "banner_id", "left")
        .join(toggle_facts(toggles), "banner_id", "left")
        .join(tcf_facts(tcf), "banner_id", "left")
        .withColumn("platform", cmp_of(F.col("selectors"), F.col("cmp")))
    )
    text = F.col("text")
    detected = (
        F.col("platform").isin([name for name, _ in W.CMP_SELECTORS])
        | F.col("tcf_present")
        | (F.col("fixed_or_sticky") & (F.coalesce("n_buttons", F.lit(0)) > 0) & _search(text, W.COOKIE_WORDS))
    )
    purposes = F.sort_array(
        F.array_distinct(
            F.concat(F.coalesce("tcf_purposes", none), purposes_in(text), F.coalesce("toggle_purposes", none))
        )
    )
    accept, reject = F.col("accept"), F.col("reject")
    faint = ((accept["area"] > 0) & (reject["area"] < accept["area"] * 0.5)) | (
        (accept["contrast"] >= 4.5) & (reject["contrast"] < 3)
    )
    patterns = F.array_distinct(
        F.array_compact(
            F.array(
                F.when(F.col("tcf_preticked"), "preticked_optional"),
                F.when(accept.isNotNull() & reject.isNull(), "reject_absent_first_layer"),
                F.when(accept.isNotNull() & reject.isNotNull() & faint, "reject_visually_deemphasised"),
                F.when(F.col("preticked"), "preticked_optional"),
                F.when(F.col("legitimate"), "legitimate_interest_default_on"),
                F.when(_search(text, W.SHAMING), "confirmshaming"),
                F.when(F.col("reject_clicks") >= 2, "layered_rejection"),
            )
        )
    )
    vendors = F.greatest("vendor_count", "tcf_vendor_count")
    return b.withColumn("detected", detected).select(
        "banner_id",
        "site",
        "detected",
        F.col("platform").alias("cmp"),
        F.when(F.col("detected"), purposes).otherwise(none).alias("purposes"),
        F.when(F.col("detected"), vendors).otherwise(F.col("vendor_count")).alias("vendor_count"),
        F.when(F.col("detected"), patterns).otherwise(none).alias("dark_patterns"),
    )
