from __future__ import annotations

from pyspark.sql import functions as F

from privatrail.dims.categories import CONSEQUENCES, VERDICT_WEIGHTS
from privatrail.dims.decisions import ACTIONS
from privatrail.dims.forms import UNREDACTABLE
from privatrail.operators import decisions as D
from privatrail.operators import forms as O
from privatrail.operators import learning as G
from privatrail.plans.forms import JUDGED, LABELLED
from privatrail.plans.history import PROTECTED, RULES
from privatrail.plans.registry import query
from privatrail.sources.model import model, with_model
from privatrail.sources.tables import materialised
from privatrail.streaming import decisions as DS

NEED = (
    "pevents", "responses", "profiles", "users", "pref_category", "pref_override", "pref_expected", "clip_allowlist",
    "dim_category", "dim_necessity",
)
WEIGHT = "CASE verdict " + " ".join(f"WHEN '{v}' THEN {w}e0" for v, w in VERDICT_WEIGHTS.items()) + " END"
SCORED = RULES + f""",
active AS (SELECT user_id, category, purpose FROM rules WHERE consecutive_continue >= 3 AND split_part(category, '.', 1) NOT IN {PROTECTED}),
prof AS (SELECT requester_key, clauses, policy_missing,
  CASE WHEN list_has_any(shares_with, ['advertising_partners', 'data_brokers']) THEN 1.25e0 ELSE 1e0 END * CASE WHEN retention = 'after_deletion' THEN 1.2e0 ELSE 1e0 END
  * CASE WHEN training_on_user_content OR list_contains(purposes, 'ai_training') THEN 1.15e0 ELSE 1e0 END * CASE WHEN international_transfer THEN 1.1e0 ELSE 1e0 END
  * CASE WHEN data_sale THEN 1.3e0 ELSE 1e0 END AS factor, least(0.3e0, tracking_confidence * 0.3e0) AS boost FROM profiles),
cv AS (SELECT e.event_id, e.c AS category, d.sensitivity, d.protected, coalesce(p.factor, 1e0) AS factor, coalesce(p.boost, 0e0) AS boost,
    CASE WHEN n.verdict IS NULL OR e.purpose_confidence < 0.35e0 THEN 'reasonable' ELSE n.verdict END AS verdict,
    CASE WHEN n.verdict IS NULL OR e.purpose_confidence < 0.35e0 THEN 0.2e0 ELSE e.purpose_confidence END AS v_confidence,
    coalesce(p1.preference, p2.preference, 'ask') AS preference, a.user_id IS NOT NULL AS ruled
  FROM (SELECT *, unnest(categories) AS c FROM pevents) e JOIN dim_category d ON d.category = e.c
  LEFT JOIN dim_necessity n ON n.purpose = e.purpose AND n.category = e.c LEFT JOIN prof p ON p.requester_key = e.requester_key
  LEFT JOIN pref_category p1 ON p1.user_id = e.user_id AND p1.category = e.c
  LEFT JOIN pref_category p2 ON p2.user_id = e.user_id AND p2.category = d.root AND d.root <> e.c
  LEFT JOIN active a ON a.user_id = e.user_id AND a.category = e.c AND a.purpose = e.purpose),
cr AS (SELECT *, least(1e0, sensitivity * ({WEIGHT}) * factor * (1 + boost)) AS crisk FROM cv),
ag AS (SELECT event_id, max(crisk) AS r, max(sensitivity) AS s, bool_and(preference = 'usually_allow') AS au, bool_and(ruled) AS ar, bool_or(protected) AS hi,
    bool_or(verdict IN ('unnecessary', 'red_flag')) AS un, list(category) FILTER (verdict = 'red_flag') AS rf, avg(CASE WHEN ruled THEN 0e0 ELSE 1e0 END) AS ux,
    max(CASE WHEN preference = 'always_warn' THEN CASE WHEN crisk >= 0.4e0 THEN 2 ELSE 1 END WHEN preference = 'reject' THEN 1 ELSE 0 END) AS mn FROM cr GROUP BY event_id),
base AS (SELECT e.*, len(e.categories) AS n_cats, coalesce(r, 0e0) AS scored_risk, coalesce(s, 0e0) AS severity_prior, coalesce(au, TRUE) AS all_usual, coalesce(ar, TRUE) AS all_ruled,
    coalesce(hi, FALSE) AS high_impact, coalesce(un, FALSE) AS any_unneeded, coalesce(rf, CAST([] AS VARCHAR[])) AS red_flags, coalesce(ux, 0e0) AS unexpectedness, coalesce(mn, 0) AS minimum,
    p.clauses, p.policy_missing, u.reject_optional_cookies, u.auto_reject, u.auto_block, o.action AS override, x.expected, c.user_id IS NOT NULL AS clip_allowed,
    CASE e.event_type WHEN 'consent_banner' THEN e.dark_patterns WHEN 'tracking' THEN e.signals WHEN 'policy_document' THEN coalesce(p.clauses, CAST([] AS VARCHAR[])) ELSE CAST([] AS VARCHAR[]) END AS sig
  FROM pevents e LEFT JOIN ag USING (event_id) LEFT JOIN prof p ON p.requester_key = e.requester_key LEFT JOIN users u ON u.user_id = e.user_id
  LEFT JOIN pref_override o ON o.user_id = e.user_id AND o.requester_key = e.requester_key
  LEFT JOIN (SELECT user_id, requester_key, list(category) AS expected FROM pref_expected GROUP BY ALL) x ON x.user_id = e.user_id AND x.requester_key = e.requester_key
  LEFT JOIN clip_allowlist c ON c.user_id = e.user_id AND c.requester_key = e.requester_key)
"""
LIMITED = """,
obs AS (SELECT b.*, r.answered_us FROM base b JOIN (SELECT event_id, min(us) AS answered_us FROM responses GROUP BY event_id) r USING (event_id) WHERE event_type <> 'form_observed'),
limited AS (SELECT DISTINCT e.event_id FROM base e JOIN obs o ON o.user_id = e.user_id AND o.requester_key = e.requester_key AND o.event_type = e.event_type
  AND list_sort(o.categories) = list_sort(e.categories) AND o.answered_us < e.us AND e.us - o.us < 86400000000 AND o.us <= e.us
  WHERE NOT e.high_impact AND list_has_all(o.sig, e.sig) AND list_has_all(o.red_flags, e.red_flags) AND (e.event_type <> 'tracking' OR e.confidence - o.confidence < 0.2e0 - 1e-9))
"""
_acts = {c: "[" + ", ".join(f"'{a}'" for a in acts if a not in ("clear_fields", "redact_fields")) + "]" for c, (acts, _) in ACTIONS.items()}
DECIDED = SCORED + LIMITED + f""",
s0 AS (SELECT b.*, l.event_id IS NOT NULL AS is_limited FROM base b LEFT JOIN limited l USING (event_id)),
s1 AS (SELECT *, (len(signals) > 0 OR len(tracker_domains) > 0 OR fingerprinting) AS shown,
    CASE WHEN n_cats > 0 AND all_usual THEN CASE WHEN scored_risk < 0.45e0 THEN 0 WHEN scored_risk < 0.75e0 THEN 1 ELSE 2 END WHEN scored_risk < 0.25e0 THEN 0 WHEN scored_risk < 0.55e0 THEN 1 ELSE 2 END AS level_05 FROM s0),
s2 AS (SELECT *, greatest(level_05, minimum) AS level_06,
    CASE WHEN event_type = 'tracking' THEN CASE WHEN shown THEN greatest(0.25e0, least(0.54e0, confidence * 0.54e0)) ELSE 0e0 END ELSE scored_risk END AS risk_08 FROM s1),
s3 AS (SELECT *, CASE WHEN event_type = 'tracking' THEN greatest(minimum, CASE WHEN shown THEN 1 ELSE 0 END) ELSE level_06 END AS level_08,
    CASE WHEN event_type = 'consent_banner' THEN greatest(risk_08, CASE WHEN len(dark_patterns) > 0 THEN 0.55e0 WHEN len(list_filter(consent_purposes, lambda p: p <> 'necessary')) > 0 THEN 0.3e0 ELSE 0e0 END) ELSE risk_08 END AS risk_09 FROM s2),
s4 AS (SELECT *, CASE WHEN event_type = 'consent_banner' THEN greatest(level_08, CASE WHEN len(dark_patterns) > 0 THEN 2 WHEN risk_09 >= 0.25e0 THEN 1 ELSE 0 END) ELSE level_08 END AS level_09,
    event_type = 'system_access' AND breadth >= 0.6e0 AND any_unneeded AS broad,
    event_type = 'system_access' AND breadth >= 0.6e0 AND requester_kind = 'extension' AND list_contains(categories, 'browser_history') AS hist FROM s3),
s5 AS (SELECT *, CASE WHEN hist THEN greatest(risk_09, 0.7e0) WHEN broad THEN greatest(risk_09, 0.65e0) ELSE risk_09 END AS risk_10,
    CASE WHEN broad OR hist THEN 2 ELSE level_09 END AS level_10,
    event_type = 'policy_document' AND coalesce(len(clauses), 0) > 0 AS clausal,
    event_type = 'policy_document' AND coalesce(len(clauses), 0) = 0 AND (missing OR coalesce(policy_missing, FALSE)) AS absent FROM s4),
s6 AS (SELECT *, CASE WHEN clausal THEN greatest(risk_10, 0.6e0) WHEN absent THEN greatest(risk_10, 0.3e0) ELSE risk_10 END AS risk_11,
    CASE WHEN clausal THEN 2 WHEN absent THEN greatest(level_10, 1) ELSE level_10 END AS level_11,
    event_type = 'clipboard_read' AND cloud_sync AND n_cats > 0 AS synced,
    event_type = 'permission_request' AND state IN ('denied', 'stopped') AS denied FROM s5),
s7 AS (SELECT *, CASE WHEN synced THEN greatest(risk_11, 0.3e0) ELSE risk_11 END AS risk_12,
    CASE WHEN event_type = 'screen_capture' AND active AND NOT first_grant THEN greatest(minimum, 1) WHEN denied THEN 0 WHEN event_type = 'form_observed' THEN least(level_11, 1) WHEN event_type = 'clipboard_read' AND NOT cloud_sync AND (writer_key = requester_key OR clip_allowed) THEN 0 WHEN synced THEN greatest(level_11, 1) ELSE level_11 END AS level_12 FROM s6),
s8 AS (SELECT *, CASE WHEN existing AND NOT any_unneeded AND NOT high_impact THEN minimum ELSE level_12 END AS level_12s FROM s7),
s9 AS (SELECT *, CASE WHEN n_cats > 0 AND list_has_all(coalesce(expected, []), categories) THEN CASE WHEN high_impact THEN least(level_12s, 1) ELSE 0 END ELSE level_12s END AS level_13 FROM s8),
s10 AS (SELECT *, CASE WHEN override = 'allow' AND NOT high_impact THEN 0 ELSE level_13 END AS level_13o FROM s9),
s11 AS (SELECT *, level_13o = 2 AND NOT high_impact AND n_cats > 0 AND all_ruled AS learned FROM s10),
s12 AS (SELECT *, CASE WHEN learned THEN 1 ELSE level_13o END AS level_14 FROM s11),
s13 AS (SELECT *, greatest(CASE WHEN is_limited THEN greatest(minimum, level_14 - 1) ELSE level_14 END, CASE WHEN learned THEN 1 ELSE 0 END) AS level_15,
    event_type = 'file_upload' AND partial AS part FROM s12),
s14 AS (SELECT *, CASE WHEN event_type = 'redacted_document' THEN 1 WHEN part THEN greatest(level_15, 1) ELSE level_15 END AS level_16,
    CASE WHEN part THEN greatest(risk_12, 0.25e0) ELSE risk_12 END AS risk_16,
    event_type = 'consent_banner' AND NOT coalesce(reject_optional_cookies, TRUE) AS ask FROM s13),
s15 AS (SELECT *, CASE WHEN ask THEN ['view_details', 'reject_optional', 'continue'] WHEN event_type = 'file_upload' AND list_contains(categories, 'location_precise') THEN CASE WHEN n_cats = 1 THEN ['strip_metadata', 'cancel', 'continue'] ELSE ['strip_metadata', 'cancel', 'continue', 'redact'] END ELSE CASE event_type {" ".join(f"WHEN '{c}' THEN {a}" for c, a in _acts.items())} END END AS actions,
    CASE WHEN ask THEN 'view_details' ELSE CASE event_type {" ".join(f"WHEN '{c}' THEN '{d}'" for c, (_, d) in ACTIONS.items())} END END AS default_action FROM s14),
s16 AS (SELECT *, CASE WHEN ((default_action = 'reject_optional' AND coalesce(auto_reject, FALSE)) OR (default_action = 'block' AND coalesce(auto_block, FALSE))) AND list_contains(actions, default_action) THEN default_action ELSE '' END AS auto_action FROM s15),
s17 AS (SELECT *, CASE WHEN denied THEN 0 WHEN auto_action <> '' THEN least(level_16, 1) ELSE level_16 END AS level_17 FROM s16),
s18 AS (SELECT *, (['IGNORE', 'INFORM', 'INTERVENE'])[level_17 + 1] AS outcome FROM s17),
dec AS (SELECT *, CASE WHEN outcome = 'INTERVENE' THEN CASE WHEN risk_16 >= 0.75e0 THEN 'act_now' ELSE 'attention' END WHEN auto_action <> '' THEN 'all_clear' WHEN any_unneeded THEN 'heads_up' WHEN risk_16 < 0.25e0 THEN 'all_clear' WHEN outcome = 'INFORM' THEN 'heads_up' ELSE 'note' END AS urgency FROM s18)
"""


def judged(spark, sf, forms=None):
    rules = G.active_rules(G.rule_state(model(spark, sf, "responses")))
    users = D.user_context(model(spark, sf, "users"), model(spark, sf, "pref_category"), rules)
    requesters = D.requester_context(model(spark, sf, "pref_expected"), model(spark, sf, "pref_override"), model(spark, sf, "clip_allowlist"))
    ctx = D.with_context(model(spark, sf, "pevents"), D.default_necessity(spark), model(spark, sf, "profiles"), users, requesters, forms)
    return D.judge_categories(ctx)


def kept(judged_events):
    """Judged events as a table: the rules and the rate limit read them. What only judging needed, among it maps of whole
    lists in every row, is not written."""
    return materialised(judged_events.drop("verdicts", "prefs", "rules", "factor", "boost", "form_verdicts", "judged"))


def decided(spark, sf):
    j = kept(judged(spark, sf))
    return D.with_urgency(D.decide_events(j, D.rate_limited(j, model(spark, sf, "responses"))))


def _scored(body: str) -> str:
    return with_model(*NEED, body=SCORED + body)


def _decided(body: str) -> str:
    return with_model(*NEED, body=DECIDED + body)


@query("r01_severity_prior", _scored("SELECT event_id, event_type, severity_prior FROM base"))
def r01(spark, sf):
    return judged(spark, sf).select("event_id", "event_type", "severity_prior")


@query("r02_necessity", _scored("SELECT event_id, category, verdict, round(v_confidence, 6) AS confidence FROM cv"))
def r02(spark, sf):
    out = judged(spark, sf).select("event_id", "purpose", "purpose_confidence", F.col("verdicts").isNotNull().alias("known"), F.explode("judged").alias("j"))
    sure = F.col("known") & (F.col("purpose_confidence") >= 0.35)
    return out.select("event_id", "j.category", "j.verdict", F.round(F.when(sure, F.col("purpose_confidence")).otherwise(0.2), 6).alias("confidence"))


@query("r03_consequence_factor", _scored("SELECT p.requester_key, round(factor, 6) AS factor, round(boost, 6) AS boost, count(*) AS events FROM prof p JOIN pevents e USING (requester_key) GROUP BY ALL"))
def r03(spark, sf):
    p = D.consequence_factor(model(spark, sf, "profiles")).select("requester_key", F.round("factor", 6).alias("factor"), F.round("boost", 6).alias("boost"))
    n = model(spark, sf, "pevents").groupBy("requester_key").agg(F.count("*").alias("events"))
    return p.join(n, "requester_key")


@query("r04_risk", _scored("SELECT event_id, round(scored_risk, 6) AS risk, round(unexpectedness, 6) AS unexpectedness FROM base"))
def r04(spark, sf):
    return judged(spark, sf).select("event_id", F.round("scored_risk", 6).alias("risk"), F.round("unexpectedness", 6).alias("unexpectedness"))


@query("r05_base_level", _decided("SELECT event_id, level_05 AS level FROM dec"))
def r05(spark, sf):
    return decided(spark, sf).select("event_id", F.col("level_05").alias("level"))


@query("r06_preference_minimum", _decided("SELECT event_id, minimum, level_06 AS level FROM dec"))
def r06(spark, sf):
    return decided(spark, sf).select("event_id", "minimum", F.col("level_06").alias("level"))


@query("r07_protected", _scored("SELECT event_id, high_impact FROM base"))
def r07(spark, sf):
    return judged(spark, sf).select("event_id", "high_impact")


def _step(name: str, step: str, classes: list[str], risk: str | None = None):
    risk = risk or f"risk_{step}"
    only = "(" + ", ".join(f"'{c}'" for c in classes) + ")"
    sql = _decided(f"SELECT event_id, round({risk}, 6) AS risk, level_{step} AS level FROM dec WHERE event_type IN {only}")

    def run(spark, sf):
        return decided(spark, sf).where(F.col("event_type").isin(classes)).select("event_id", F.round(risk, 6).alias("risk"), F.col(f"level_{step}").alias("level"))

    query(name, sql)(run)


_step("r08_tracking_override", "08", ["tracking"])
_step("r09_consent_override", "09", ["consent_banner"])
_step("r10_broad_access", "10", ["system_access"])
_step("r11_policy_override", "11", ["policy_document"])
_step("r12_state_rules", "12s", ["screen_capture", "permission_request", "form_observed", "clipboard_read", "system_access"], "risk_12")
_step("r13_expected_and_allowed", "13o", ["permission_request", "screen_capture", "startup_registration", "system_access", "clipboard_read", "form_submit", "file_upload"], "risk_12")


@query("r14_learned_downgrade", _decided("SELECT event_id, learned, level_14 AS level FROM dec"))
def r14(spark, sf):
    return decided(spark, sf).select("event_id", "learned", F.col("level_14").alias("level"))


@query("r15_rate_limit", with_model(*NEED, body=SCORED + LIMITED + "SELECT event_id FROM limited"))
def r15(spark, sf):
    return D.rate_limited(judged(spark, sf), model(spark, sf, "responses"))


_step("r16_partial_floor", "16", ["file_upload", "redacted_document"])


@query("r17_actions", _decided("SELECT event_id, array_to_string(actions, ',') AS actions, default_action, auto_action, level_17 AS level FROM dec"))
def r17(spark, sf):
    return decided(spark, sf).select("event_id", F.array_join("actions", ",").alias("actions"), "default_action", "auto_action", F.col("level_17").alias("level"))


_eff = "CASE category " + " ".join(f"WHEN '{c}' THEN '{e}'" for c, e in CONSEQUENCES.items()) + " END"


@query(
    "r18_finding_rows",
    _scored(f"""SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY rank, -sensitivity, label) - 1 AS INT) AS pos, category,
      CASE rank WHEN 0 THEN 'warn' WHEN 2 THEN 'ok' ELSE 'info' END AS severity, label FROM (SELECT c.event_id, c.category, c.sensitivity,
        CASE WHEN verdict IN ('unnecessary', 'red_flag') THEN 0 WHEN verdict = 'required' THEN 2 ELSE 1 END AS rank,
        CASE WHEN verdict IN ('unnecessary', 'red_flag') AND e.event_type IN ('system_access', 'permission_request', 'screen_capture') AND {_eff.replace("category", "c.category", 1)} IS NOT NULL
          THEN d.label || ' — ' || {_eff.replace("category", "c.category", 1)} WHEN verdict = 'required' THEN d.label || ' — needed for this' ELSE d.label END AS label
      FROM cv c JOIN pevents e USING (event_id) JOIN dim_category d ON d.category = c.category) x"""),
)
def r18(spark, sf):
    return D.finding_rows(judged(spark, sf))


@query("r19_urgency", _decided("SELECT event_id, outcome, urgency FROM dec"))
def r19(spark, sf):
    return decided(spark, sf).select("event_id", "outcome", "urgency")


@query(
    "w01_decision_stream",
    with_model(*NEED, body=DECIDED.replace("LEFT JOIN limited l USING (event_id)", "LEFT JOIN (SELECT event_id FROM limited WHERE FALSE) l USING (event_id)")
    + "SELECT event_id, round(risk_16, 6) AS risk, outcome, default_action, auto_action, urgency FROM dec"),
)
def w01(spark, sf):
    """Decisions without the rate limit: what the stream of ``decide`` gives (a test compares the two)."""
    rules = G.active_rules(G.rule_state(model(spark, sf, "responses")))
    users = D.user_context(model(spark, sf, "users"), model(spark, sf, "pref_category"), rules)
    requesters = D.requester_context(model(spark, sf, "pref_expected"), model(spark, sf, "pref_override"), model(spark, sf, "clip_allowlist"))
    out = DS.decide(model(spark, sf, "pevents"), D.default_necessity(spark), model(spark, sf, "profiles"), users, requesters)
    return out.select("event_id", F.round("risk", 6).alias("risk"), "outcome", "default_action", "auto_action", "urgency")


@query("r20_decisions", _decided("SELECT event_id, event_type, round(risk_16, 6) AS risk, outcome, array_to_string(actions, ',') AS actions, default_action, auto_action, urgency FROM dec"))
def r20(spark, sf):
    return decided(spark, sf).select(
        "event_id", "event_type", F.round("risk", 6).alias("risk"), "outcome", F.array_join("actions", ",").alias("actions"), "default_action", "auto_action", "urgency"
    )


_matrix = "CASE WHEN n.verdict IS NULL OR e.purpose_confidence < 0.35e0 THEN 'reasonable' ELSE n.verdict END AS verdict"
_rank = "['required', 'reasonable', 'unnecessary', 'red_flag']"
FORM_DECIDED = (
    LABELLED + JUDGED
    + f""",
fw AS (SELECT form_id, category, ({_rank})[max(list_position({_rank}, verdict))] AS verdict FROM jd WHERE category IS NOT NULL GROUP BY form_id, category),
fr AS (SELECT form_id, bool_or(NOT required AND NOT asserted_required) AS can_clear, bool_or(input_type NOT IN ({", ".join(f"'{x}'" for x in UNREDACTABLE)})) AS can_redact
    FROM jd j WHERE filled AND EXISTS (SELECT 1 FROM jd k WHERE k.form_id = j.form_id AND k.category = j.category AND k.flag) GROUP BY form_id),
fc AS (SELECT form_id, list(DISTINCT category) AS asked, list(DISTINCT category) FILTER (filled) AS given FROM lab WHERE category IS NOT NULL GROUP BY form_id),
fe AS (SELECT e.* REPLACE (CASE WHEN fc.form_id IS NULL THEN categories ELSE list_sort(list_distinct(list_concat(categories,
    CASE event_type WHEN 'form_observed' THEN asked ELSE coalesce(given, CAST([] AS VARCHAR[])) END))) END AS categories) FROM pevents e LEFT JOIN fc ON fc.form_id = e.event_id),
"""
    + DECIDED.strip()[5:].replace("FROM pevents", "FROM fe").replace(_matrix, "coalesce(fw.verdict, " + _matrix.replace(" AS verdict", ") AS verdict")).replace(
        "LEFT JOIN prof p ON p.requester_key = e.requester_key\n  LEFT JOIN pref_category p1",
        "LEFT JOIN prof p ON p.requester_key = e.requester_key LEFT JOIN fw ON fw.form_id = e.event_id AND fw.category = e.c\n  LEFT JOIN pref_category p1",
    )
)


@query(
    "r22_form_decisions",
    with_model(*NEED, "form_fields", body=FORM_DECIDED + """SELECT event_id, event_type, round(risk_16, 6) AS risk, outcome, array_to_string(CASE event_type
      WHEN 'form_submit' THEN list_filter(['cancel', 'continue', 'clear_fields', 'review_fields'], lambda a: a <> 'clear_fields' OR coalesce(can_clear, FALSE))
      ELSE list_filter(['redact_fields', 'review_fields', 'continue'], lambda a: a <> 'redact_fields' OR coalesce(can_redact, FALSE)) END, ',') AS actions, urgency
    FROM dec LEFT JOIN fr ON fr.form_id = dec.event_id WHERE event_type IN ('form_submit', 'form_observed')"""),
)
def r22(spark, sf):
    """Decisions on forms, with the form's own judgement of each category and what can be done about its fields."""
    forms = O.form_context(O.assess_forms(model(spark, sf, "form_fields"))).withColumnRenamed("form_id", "event_id")
    j = kept(judged(spark, sf, forms))
    out = D.with_urgency(D.decide_events(j, D.rate_limited(j, model(spark, sf, "responses")))).where("event_type IN ('form_submit', 'form_observed')")
    return out.select("event_id", "event_type", F.round("risk", 6).alias("risk"), "outcome", F.array_join("actions", ",").alias("actions"), "urgency")


@query("w06_limited_events", with_model(*NEED, body=SCORED + LIMITED + "SELECT event_id, l.event_id IS NOT NULL AS is_limited FROM base LEFT JOIN limited l USING (event_id) WHERE event_type <> 'form_observed'"))
def w06(spark, sf):
    """What the stateful stream says of every event it sees: the batch twin of ``rate_limited_stream``."""
    j = kept(judged(spark, sf))
    limited = D.rate_limited(j, model(spark, sf, "responses")).withColumn("hit", F.lit(True))
    return j.where("event_type <> 'form_observed'").select("event_id").join(limited, "event_id", "left").select("event_id", F.coalesce("hit", F.lit(False)).alias("is_limited"))


SCENARIO_PURPOSES = ["image_tool", "government", "recipe", "banking", "saas_b2b", "social", "wallpaper_utility", "backup"]
SCENARIO_CATEGORIES = [
    "government_id.passport", "medical.diagnosis", "financial.card_number", "credentials.password", "biometric_photo",
    "location_precise", "phone", "email",
]
_sp, _sc = (str(tuple(x)) for x in (SCENARIO_PURPOSES, SCENARIO_CATEGORIES))


@query(
    "r21_scenarios",
    with_model("pevents", "dim_category", "dim_necessity", body=f"""SELECT n.purpose, n.category, n.verdict, round(least(1e0, c.sensitivity * ({WEIGHT})), 6) AS risk,
      CASE WHEN least(1e0, c.sensitivity * ({WEIGHT})) < 0.25e0 THEN 'IGNORE' WHEN least(1e0, c.sensitivity * ({WEIGHT})) < 0.55e0 THEN 'INFORM' ELSE 'INTERVENE' END AS outcome,
      count(e.event_id) AS events
    FROM dim_necessity n JOIN dim_category c USING (category) LEFT JOIN (SELECT event_id, purpose, unnest(categories) AS category FROM pevents) e
      ON e.purpose = n.purpose AND e.category = n.category
    WHERE n.purpose IN {_sp} AND n.category IN {_sc} GROUP BY n.purpose, n.category, n.verdict, c.sensitivity"""),
)
def r21(spark, sf):
    """The 64 reference scenarios, each with the number of logged events it stands for."""
    seen = model(spark, sf, "pevents").select("purpose", F.explode("categories").alias("category")).groupBy("purpose", "category").agg(F.count("*").alias("events"))
    return scenario_outcomes(spark).join(seen, ["purpose", "category"], "left").withColumn("events", F.coalesce("events", F.lit(0)))


def scenario_outcomes(spark):
    cells = D.default_necessity(spark).where(F.col("purpose").isin(SCENARIO_PURPOSES) & F.col("category").isin(SCENARIO_CATEGORIES))
    weight = F.expr(f"element_at({D._WEIGHT}, verdict)")
    risk = F.least(F.lit(1.0), F.expr(f"element_at({D._SENSITIVITY}, category)") * weight)
    outcome = F.when(F.col("risk") < 0.25, "IGNORE").when(F.col("risk") < 0.55, "INFORM").otherwise("INTERVENE")
    return cells.withColumn("risk", risk).withColumn("outcome", outcome).withColumn("risk", F.round("risk", 6))
