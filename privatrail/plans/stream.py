from __future__ import annotations

from pyspark.sql import functions as F

from privatrail.dims.decisions import ACTIONS, SECTIONS
from privatrail.dims import values_sql
from privatrail.dims.policy import CLAUSES
from privatrail.dims.categories import CATEGORIES
from privatrail.operators import decisions as D
from privatrail.operators import forms as O
from privatrail.operators import policy as L
from privatrail.operators import report as R
from privatrail.plans.forms import JUDGED, LABELLED
from privatrail.plans.policy import CLAIMS, COLLECTED
from privatrail.plans.registry import query
from privatrail.sources.model import model, with_model
from privatrail.streaming import notices as N

SIG = """
WITH sg AS (SELECT *, CASE WHEN event_type IN ('file_upload', 'form_submit', 'policy_document', 'clipboard_read') THEN NULL ELSE array_to_string(list_concat([event_type, requester_key],
  CASE event_type WHEN 'tracking' THEN [] WHEN 'consent_banner' THEN list_concat(list_concat([cmp], list_sort(dark_patterns)), list_sort(consent_purposes)) WHEN 'permission_request' THEN [permission, state]
  WHEN 'system_access' THEN list_sort(accesses) WHEN 'screen_capture' THEN [CASE WHEN active THEN 'active=True' ELSE 'active=False' END] WHEN 'startup_registration' THEN [mechanism]
  WHEN 'redacted_document' THEN [file_path] ELSE list_sort(categories) END), chr(31)) END AS signature FROM pevents)
"""


def _signed(spark, sf):
    return D.notice_signature(model(spark, sf, "pevents"))


@query("w02_notice_signatures", with_model("pevents", body=SIG + "SELECT event_id, signature FROM sg"))
def w02(spark, sf):
    return _signed(spark, sf).select("event_id", "signature")


_islands = lambda part, gap: f"SELECT *, sum(CASE WHEN us >= prev_end THEN 1 ELSE 0 END) OVER (PARTITION BY {part} ORDER BY us, event_id) AS island FROM (SELECT *, coalesce(max(us + {gap}) OVER (PARTITION BY {part} ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_end FROM src) q"


_islands = lambda part, gap: f"SELECT *, sum(CASE WHEN us >= prev_end THEN 1 ELSE 0 END) OVER (PARTITION BY {part} ORDER BY us, event_id) AS island FROM (SELECT *, coalesce(max(us + {gap}) OVER (PARTITION BY {part} ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_end FROM src) q"

# the level of an event's latest decision, and its first answer
LATEST = """, lv AS (SELECT event_id, CASE max_by(outcome, seq) WHEN 'INTERVENE' THEN 2 WHEN 'INFORM' THEN 1 ELSE 0 END AS level FROM decision_log GROUP BY event_id),
  an AS (SELECT event_id, min(us) AS answered_us FROM responses GROUP BY event_id)"""
FOLDED = (
    SIG + LATEST + """, so AS (SELECT sg.event_id, session_id, signature, us, coalesce(level, 0) AS level,
      CASE WHEN coalesce(level, 0) > 0 AND answered_us < us + 3600000000 THEN answered_us END AS answer FROM sg LEFT JOIN lv USING (event_id) LEFT JOIN an USING (event_id)),
    src AS (SELECT *, CASE WHEN level = 0 THEN 600000000 WHEN answer IS NOT NULL THEN greatest(600000000, answer - us) ELSE 3600000000 END AS gap FROM so WHERE signature IS NOT NULL),
    isl AS (""" + _islands("session_id, signature", "gap") + ")"
)


def _noticed(spark, sf):
    latest = model(spark, sf, "decision_log").groupBy("event_id").agg(F.max_by("outcome", "seq").alias("outcome"))
    level = F.when(F.col("outcome") == "INTERVENE", 2).when(F.col("outcome") == "INFORM", 1).otherwise(0)
    return _signed(spark, sf).join(latest, "event_id", "left").withColumn("level", level)


@query(
    "w03_coalesced_notices",
    with_model("pevents", "decision_log", "responses", body=SIG + LATEST + f""", src AS (SELECT sg.event_id, session_id, signature, us, coalesce(level, 0) AS level, answered_us IS NOT NULL AS answered,
      CASE WHEN answered_us IS NOT NULL THEN 600000000 ELSE 3600000000 END AS gap FROM sg LEFT JOIN lv USING (event_id) LEFT JOIN an USING (event_id) WHERE signature IS NOT NULL),
    isl AS ({_islands("session_id, signature", "gap")})
    SELECT session_id, signature, min_by(event_id, (us, event_id)) AS notice_id, count(*) AS events, max(level) AS level, bool_or(answered) AS answered, min(us) AS first_us, max(us) AS last_us FROM isl GROUP BY session_id, signature, island"""),
)
def w03(spark, sf):
    answered = model(spark, sf, "responses").select("event_id").distinct().withColumn("hit", F.lit(True))
    ev = _noticed(spark, sf).join(answered, "event_id", "left").withColumn("answered", F.coalesce("hit", F.lit(False)))
    return N.coalesced(N.with_event_time(ev))


@query(
    "w03_event_notices",
    with_model("pevents", "decision_log", "responses", body=FOLDED + """
    SELECT a.event_id, min_by(b.event_id, (b.us, b.event_id)) AS notice_id, CAST(max(b.level) AS INT) AS level, coalesce(bool_or(b.answer < a.us AND b.event_id <> a.event_id), FALSE) AS ignored
    FROM isl a JOIN isl b ON a.session_id = b.session_id AND a.signature = b.signature AND a.island = b.island AND (b.us, b.event_id) <= (a.us, a.event_id) GROUP BY a.event_id
    UNION ALL SELECT event_id, event_id, CAST(level AS INT), FALSE FROM so WHERE signature IS NULL"""),
)
def w03_events(spark, sf):
    """What ``notice_stream`` says of every event."""
    return N.fold_events(_noticed(spark, sf), model(spark, sf, "responses"))


WASOF = 1704067200000000 + 20 * 86_400_000_000


@query(
    "w04_notice_expiry",
    with_model("pevents", "decision_log", "responses", body=FOLDED + f""", nt AS (SELECT min_by(event_id, (us, event_id)) AS notice_id, min(us) AS f, max(us + gap) AS closes_us FROM isl GROUP BY session_id, signature, island)
    SELECT notice_id, closes_us, f <= {WASOF} AND closes_us > {WASOF} AS is_open FROM nt"""),
)
def w04(spark, sf):
    return N.expiry(N.closed_notices(_noticed(spark, sf), model(spark, sf, "responses")), WASOF)


DEFAULTS = "CASE event_type " + " ".join(f"WHEN '{c}' THEN '{d}'" for c, (_, d) in ACTIONS.items()) + " END"
HELD = "(SELECT event_id FROM decision_log GROUP BY event_id HAVING max_by(outcome, seq) = 'INTERVENE')"


def held_events(spark, sf):
    """Events whose latest decision interrupts, with the default they take and whether a page waits for the answer."""
    latest = model(spark, sf, "decision_log").groupBy("event_id").agg(F.max_by("outcome", "seq").alias("outcome")).where("outcome = 'INTERVENE'")
    default = F.create_map(*[F.lit(x) for c, (_, d) in ACTIONS.items() for x in (c, d)])
    held = model(spark, sf, "pevents").join(latest.select("event_id"), "event_id", "left_semi")
    return held.withColumn("default_action", F.try_element_at(default, F.col("event_type"))).withColumn("waits", F.col("requester_kind") == "website")


@query(
    "w05_timed_out_defaults",
    with_model("pevents", "responses", "decision_log", body=f"""SELECT e.event_id, {DEFAULTS} AS default_action, e.us + 60000000 AS taken_us
    FROM pevents e LEFT JOIN (SELECT event_id, min(us) AS a FROM responses GROUP BY event_id) r USING (event_id)
    WHERE requester_kind = 'website' AND event_id IN {HELD} AND (a IS NULL OR a - e.us > 60000000)"""),
)
def w05(spark, sf):
    return N.timed_out(held_events(spark, sf).where("waits"), model(spark, sf, "responses"))


@query(
    "w07_live_sessions",
    with_model("pevents", body=f"""WITH src AS (SELECT * FROM pevents), isl AS ({_islands("session_id", "1800000000")})
    SELECT session_id, count(*) AS beats, min(us) AS opened_us, max(us) AS last_us FROM isl GROUP BY session_id, island"""),
)
def w07(spark, sf):
    return N.sessions(N.with_event_time(model(spark, sf, "pevents")), "30 minutes")


ENDED = f"""WITH src AS (SELECT * FROM pevents), isl AS ({_islands("session_id", "1800000000")}),
  en AS (SELECT session_id, island, max(us) + 1800000000 AS over_us FROM isl GROUP BY ALL),
  hd AS (SELECT i.event_id, i.session_id, i.us, {DEFAULTS} AS default_action, over_us, requester_kind = 'website' AS waits, a
    FROM isl i JOIN en USING (session_id, island) LEFT JOIN (SELECT event_id, min(us) AS a FROM responses GROUP BY event_id) r USING (event_id) WHERE event_id IN {HELD})
"""


@query(
    "w07_session_end",
    with_model("pevents", "responses", "decision_log", body=ENDED + "SELECT event_id, 'aborted' AS status, default_action, over_us AS taken_us FROM hd WHERE a IS NULL OR a > over_us"),
)
def w07_end(spark, sf):
    live = N.sessions(N.with_event_time(model(spark, sf, "pevents")), "30 minutes")
    return N.ended(held_events(spark, sf), live, model(spark, sf, "responses"), 1_800_000_000)


@query(
    "w05_w07_settled_events",
    with_model("pevents", "responses", "decision_log", body=ENDED + """, du AS (SELECT *, least(CASE WHEN waits THEN us + 60000000 END, over_us) AS taken_us FROM hd)
    SELECT session_id, event_id, CASE WHEN taken_us = over_us THEN 'aborted' ELSE 'defaulted' END AS status, default_action, taken_us FROM du WHERE a IS NULL OR a > taken_us"""),
)
def w07_settled(spark, sf):
    """What ``session_stream`` says of every held event that nobody answers."""
    live = N.sessions(N.with_event_time(model(spark, sf, "pevents")), "30 minutes")
    return N.settled(held_events(spark, sf), live, model(spark, sf, "responses"), 1_800_000_000)


@query(
    "w08_late_results",
    with_model("responses", body="SELECT event_id, seq, CASE WHEN event_id % 600 > 300 OR event_id % 7 = 3 THEN 'aborted' ELSE 'complete' END AS status FROM responses"),
)
def w08(spark, sf):
    r = model(spark, sf, "responses").withColumnRenamed("us", "result_us")
    # every seventh result came without the time it belongs to
    r = r.withColumn("us", F.when(F.col("event_id") % 7 != 3, F.col("result_us") - (F.col("event_id") % 600) * 1_000_000))
    kept, late = N.split_late(r, 300_000_000)
    return kept.withColumn("status", F.lit("complete")).unionByName(late).select("event_id", "seq", "status")


@query(
    "w09_one_analysis_per_digest",
    with_model("doc_cache", body="SELECT origin, sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM doc_cache GROUP BY ALL"),
)
def w09(spark, sf):
    return N.once_per_digest_batch(model(spark, sf, "doc_cache").select("origin", "doc_id", F.sha2("text", 256).alias("digest")))


@query(
    "w10_windowed_counts",
    with_model("pevents", body="SELECT us // 3600000000 * 3600000000 AS start_us, requester_key, count(*) AS n FROM pevents GROUP BY ALL"),
)
def w10(spark, sf):
    return N.windowed_counts(N.with_event_time(model(spark, sf, "pevents")))


# ---- report -------------------------------------------------------------------------------
DIM = values_sql([(c.name, c.title, "warn" if c.material else "info") for c in CLAUSES], "clause, summary, tone")
_labels = values_sql([(c, label) for c, label, _ in CATEGORIES], "category, label")
FOUND = CLAIMS + COLLECTED + "," + LABELLED.strip()[5:] + JUDGED + f""",
said AS (SELECT requester_key AS site, CASE WHEN n % 2 = 0 THEN 'policy' ELSE 'terms' END AS kind, unnest(clauses) AS clause FROM profiles),
excess AS (SELECT DISTINCT p.site, col.category FROM col JOIN policy_texts p USING (doc_id) JOIN dim_necessity n ON n.purpose = p.site_purpose AND n.category = col.category WHERE n.verdict IN ('unnecessary', 'red_flag')),
sent_files AS (SELECT DISTINCT requester_key AS site, category FROM (SELECT requester_key, unnest(categories) AS category FROM pevents WHERE event_type = 'file_upload') x),
fnd AS (SELECT DISTINCT requester_key AS site, 'tracking' AS kind, 'INFORM' AS severity, 'warn' AS tone, 'visits are followed across sites' AS summary FROM pevents WHERE event_type = 'tracking' AND (len(tracker_domains) > 0 OR fingerprinting)
  UNION ALL SELECT DISTINCT requester_key, 'consent', 'INTERVENE', 'warn', 'the cookie choice is not even-handed' FROM pevents WHERE len(dark_patterns) > 0
  UNION ALL SELECT site, min(kind), 'INFORM', tone, summary FROM said JOIN ({DIM}) d USING (clause) GROUP BY site, clause, tone, summary
  UNION ALL SELECT DISTINCT requester_key, 'policy', 'INFORM', 'warn', 'no policy was found' FROM profiles WHERE policy_missing
  UNION ALL SELECT DISTINCT requester_key, 'policy', 'INFORM', 'warn', 'data stays after an account is deleted' FROM profiles WHERE retention = 'after_deletion'
  UNION ALL SELECT site, 'policy', 'INFORM', 'warn', 'collected without a use: ' || label FROM excess JOIN ({_labels}) l USING (category)
  UNION ALL SELECT site, 'uploads', 'INFORM', 'info', 'sent in a file: ' || label FROM sent_files JOIN ({_labels}) l USING (category)
  UNION ALL SELECT DISTINCT e.requester_key, 'forms', 'INTERVENE', 'warn', 'a form asks for more than it needs' FROM jd JOIN pevents e ON e.event_id = jd.form_id WHERE flag)
"""
KNEED = ("pevents", "profiles", "form_fields", "policy_texts", "dim_necessity")


def _findings(spark, sf):
    ev = model(spark, sf, "pevents").withColumnRenamed("requester_key", "site")
    profiles = model(spark, sf, "profiles").withColumnRenamed("requester_key", "site")
    clauses = profiles.select("site", F.when(F.col("n") % 2 == 0, "policy").otherwise("terms").alias("kind"), F.explode("clauses").alias("clause"))
    texts = model(spark, sf, "policy_texts")
    excess = L.over_collected(L.collected(L.sentences(texts)), texts, D.default_necessity(spark)).join(texts.select("doc_id", "site"), "doc_id")
    uploads = ev.where("event_type = 'file_upload'").select("site", F.explode("categories").alias("category"))
    forms = O.assess_forms(model(spark, sf, "form_fields")).select(F.col("form_id").alias("event_id"), "flag").join(ev.select("event_id", "site"), "event_id")
    return R.site_findings(ev.where("event_type = 'tracking'"), ev, clauses, profiles, excess, uploads, forms)


@query("k01_site_findings", with_model(*KNEED, body=FOUND + "SELECT * FROM fnd"))
def k01(spark, sf):
    return _findings(spark, sf)


KASOF = 1704067200000000 + 20 * 86_400_000_000


@query(
    "k02_desktop_findings",
    with_model("pevents", "decision_log", body=f"""SELECT e.event_id, requester_key, event_type AS kind, d.o AS severity FROM pevents e JOIN (SELECT event_id, arg_max(outcome, seq) AS o FROM decision_log GROUP BY event_id) d USING (event_id)
    WHERE o <> 'IGNORE' AND event_type IN ('clipboard_read', 'screen_capture') AND us BETWEEN {KASOF} - 432000 * CAST(1000000 AS BIGINT) AND {KASOF}"""),
)
def k02(spark, sf):
    return R.desktop_findings(model(spark, sf, "pevents"), model(spark, sf, "decision_log"), KASOF, 432_000)


_kinds = values_sql([(k, x) for k, _, names, _, _ in SECTIONS for x in names], "section, kind")
_texts = values_sql([(i, k, t, c, a) for i, (k, t, _, c, a) in enumerate(SECTIONS)], "pos, section, title, clean, absent")


@query(
    "k03_report_sections",
    with_model(*KNEED, body=FOUND + f""", ran AS (SELECT DISTINCT site, section FROM (SELECT requester_key AS site, CASE event_type WHEN 'form_submit' THEN 'forms' WHEN 'consent_banner' THEN 'consent' ELSE event_type END AS kind FROM pevents) x JOIN ({_kinds}) k USING (kind)),
    g AS (SELECT s.site, t.* FROM (SELECT DISTINCT requester_key AS site FROM pevents) s, ({_texts}) t), f AS (SELECT site, section, count(*) AS n, bool_or(severity = 'INTERVENE') AS serious FROM fnd JOIN ({_kinds}) k USING (kind) GROUP BY ALL)
    SELECT g.site, g.pos, g.section, g.title, coalesce(f.n, 0) AS findings, coalesce(f.serious, FALSE) AS serious, r.site IS NOT NULL AS available,
      CASE WHEN f.n > 0 THEN '' WHEN r.site IS NOT NULL THEN clean ELSE absent END AS message FROM g LEFT JOIN f ON f.site = g.site AND f.section = g.section LEFT JOIN ran r ON r.site = g.site AND r.section = g.section"""),
)
def k03(spark, sf):
    ev = model(spark, sf, "pevents").withColumnRenamed("requester_key", "site")
    kind = F.when(F.col("event_type") == "form_submit", "forms").when(F.col("event_type") == "consent_banner", "consent").otherwise(F.col("event_type"))
    return R.sections(ev, _findings(spark, sf), ev.select("site", kind.alias("kind")).distinct())


@query(
    "k04_ordered_findings",
    with_model(*KNEED, body=FOUND + "SELECT site, kind, summary, row_number() OVER (PARTITION BY site ORDER BY severity <> 'INTERVENE', tone <> 'warn', kind, summary) AS rank FROM fnd"),
)
def k04(spark, sf):
    return R.ordered_findings(_findings(spark, sf)).select("site", "kind", "summary", "rank")
