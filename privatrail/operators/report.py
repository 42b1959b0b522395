"""Consolidated report per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from privatrail.dims import dimension
from privatrail.dims.categories import CATEGORIES
from privatrail.dims.decisions import SECTIONS
from privatrail.dims.policy import CLAUSES

_COLUMNS = ["site", "kind", "severity", "tone", "summary"]


def site_findings(
    tracking: DataFrame, consent: DataFrame, clauses: DataFrame, profiles: DataFrame | None = None, excess: DataFrame | None = None,
    uploads: DataFrame | None = None, forms: DataFrame | None = None,
) -> DataFrame:
    """Findings of every analysis, each said once per site.

    ``tracking`` (site, tracker_domains, fingerprinting), ``consent`` (site, dark_patterns), ``clauses`` (site, kind,
    clause), ``profiles`` (site, policy_missing, retention), ``excess`` (site, category) of data collected without a use,
    ``uploads`` (site, category) of files sent, ``forms`` (site, flag) of judged fields; each is reduced to one row per
    site and finding before they meet.
    """
    def row(kind: str, severity: str, tone: str, summary: str):
        return [F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(tone).alias("tone"), F.lit(summary).alias("summary")]

    followed = tracking.where((F.size("tracker_domains") > 0) | F.col("fingerprinting")).select("site").distinct()
    weighted = consent.where(F.size("dark_patterns") > 0).select("site").distinct()
    dim = dimension(clauses.sparkSession, [(c.name, c.title, "warn" if c.material else "info") for c in CLAUSES], "clause, summary, tone")
    once = clauses.groupBy("site", "clause").agg(F.min("kind").alias("kind"))
    said = once.join(F.broadcast(dim), "clause").withColumn("severity", F.lit("INFORM"))
    found = [
        followed.select("site", *row("tracking", "INFORM", "warn", "visits are followed across sites")),
        weighted.select("site", *row("consent", "INTERVENE", "warn", "the cookie choice is not even-handed")),
        said.select(*_COLUMNS),
    ]
    if profiles is not None:
        found.append(profiles.where("policy_missing").select("site").distinct().select("site", *row("policy", "INFORM", "warn", "no policy was found")))
        kept = profiles.where("retention = 'after_deletion'").select("site").distinct()
        found.append(kept.select("site", *row("policy", "INFORM", "warn", "data stays after an account is deleted")))
    labels = dimension(clauses.sparkSession, [(c, label) for c, label, _ in CATEGORIES], "category, label")
    if excess is not None:
        named = excess.select("site", "category").distinct().join(F.broadcast(labels), "category")
        summary = F.concat(F.lit("collected without a use: "), F.col("label")).alias("summary")
        found.append(named.select("site", *row("policy", "INFORM", "warn", "")[:3], summary))
    if uploads is not None:
        named = uploads.select("site", "category").distinct().join(F.broadcast(labels), "category")
        found.append(named.select("site", *row("uploads", "INFORM", "info", "")[:3], F.concat(F.lit("sent in a file: "), F.col("label")).alias("summary")))
    if forms is not None:
        asked = forms.where("flag").select("site").distinct()
        found.append(asked.select("site", *row("forms", "INTERVENE", "warn", "a form asks for more than it needs")))
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out


def desktop_findings(events: DataFrame, decisions: DataFrame, asof_us: int, seconds: int = 300) -> DataFrame:
    """Recent clipboard and screen events whose latest decision was worth saying, once per event."""
    recent = events.where(F.col("event_type").isin("clipboard_read", "screen_capture") & F.col("us").between(asof_us - seconds * 1_000_000, asof_us))
    told = decisions.groupBy("event_id").agg(F.max_by("outcome", "seq").alias("outcome")).where("outcome <> 'IGNORE'")
    return recent.join(told, "event_id").select("event_id", "requester_key", F.col("event_type").alias("kind"), F.col("outcome").alias("severity"))


def sections(sites: DataFrame, findings: DataFrame, available: DataFrame) -> DataFrame:
    """Every site's four sections with their findings, an all-clear, or 'not available'.

    ``available`` (site, kind) says which analyses ran. The four sections are a constant list
    inside each site's row.
    """
    spark = sites.sparkSession
    kinds = dimension(spark, [(key, kind) for key, _, names, _, _ in SECTIONS for kind in names], "section, kind")
    texts = dimension(spark, [(i, key, title, clean, absent) for i, (key, title, _, clean, absent) in enumerate(SECTIONS)], "pos, section, title, clean, absent")
    found = findings.join(F.broadcast(kinds), "kind").groupBy("site", "section").agg(
        F.count("*").alias("n"), F.bool_or(F.col("severity") == "INTERVENE").alias("serious")
    )
    ran = available.join(F.broadcast(kinds), "kind").select("site", "section").distinct().withColumn("ran", F.lit(True))
    names = F.array(*[F.lit(key) for key, *_ in SECTIONS])
    grid = sites.select("site").distinct().select("site", F.explode(names).alias("section"))
    out = grid.join(found, ["site", "section"], "left").join(ran, ["site", "section"], "left").join(F.broadcast(texts), "section")
    n = F.coalesce("n", F.lit(0))
    return out.select(
        "site", "pos", "section", "title", n.alias("findings"), F.coalesce("serious", F.lit(False)).alias("serious"),
        F.coalesce("ran", F.lit(False)).alias("available"),
        F.when(n > 0, F.lit("")).when(F.col("ran"), F.col("clean")).otherwise(F.col("absent")).alias("message"),
    )


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Questions first, then warnings, then notes; a site has at most a few dozen findings."""
    w = Window.partitionBy("site").orderBy(
        (F.col("severity") != "INTERVENE").cast("int"), (F.col("tone") != "warn").cast("int"), "kind", "summary"
    )
    return findings.withColumn("rank", F.row_number().over(w))
