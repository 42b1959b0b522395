"""From privacy events to decisions: necessity, risk, level, actions.

An event's categories are a short array, so everything per category happens inside the row;
what differs per user, requester or purpose is joined once as a small map or array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privatrail.dims import dimension
from privatrail.dims.categories import (
    CATEGORIES,
    CONSEQUENCES,
    PROTECTED_ROOTS,
    VERDICT_WEIGHTS,
    necessity_rows,
)
from privatrail.dims.decisions import (
    ACT_NOW_RISK,
    ACTIONS,
    ALWAYS_ASK,
    LEVELS,
    OTHER_ACTIONS,
    RATE_LIMIT_HOURS,
    SETTLED_RISK,
)
from privatrail.operators.coverage import covered

HOUR_US = 3_600_000_000
_SENSITIVITY = "map(" + ", ".join(f"'{c}', {s}D" for c, _, s in CATEGORIES) + ")"
_WEIGHT = "map(" + ", ".join(f"'{v}', {w}D" for v, w in VERDICT_WEIGHTS.items()) + ")"
_PROTECTED = "(" + ", ".join(f"'{r}'" for r in PROTECTED_ROOTS) + ")"
_NONE = "CAST(array() AS array<string>)"


def necessity_by_purpose(df: DataFrame) -> DataFrame:
    """(purpose, verdicts map) from a (purpose, category, verdict) table."""
    return df.groupBy("purpose").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "verdict"))).alias("verdicts")
    )


def default_necessity(spark) -> DataFrame:
    return dimension(spark, necessity_rows(), "purpose, category, verdict")


def consequence_factor(p: DataFrame) -> DataFrame:
    """Adds ``factor``: how much worse this requester's practices make any exposure."""
    bad = F.arrays_overlap("shares_with", F.array(F.lit("advertising_partners"), F.lit("data_brokers")))
    ai = F.col("training_on_user_content") | F.array_contains("purposes", "ai_training")

    def times(test: Column, by: float) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), by).otherwise(1.0)

    factor = (
        times(bad, 1.25) * times(F.col("retention") == "after_deletion", 1.2) * times(ai, 1.15)
        * times(F.col("international_transfer"), 1.1) * times(F.col("data_sale"), 1.3)
    )
    return p.withColumn("factor", factor).withColumn(
        "boost", F.least(F.lit(0.3), F.greatest(F.lit(0.0), F.col("tracking_confidence")) * 0.3)
    )


def user_context(users: DataFrame, prefs: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per user: settings, preference map, active rules as 'purpose|category' names.

    Both collections are bounded by the category and purpose lists, not by the data.
    """
    pref = prefs.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct("category", "preference"))).alias("prefs")
    )
    rule = rules.groupBy("user_id").agg(F.collect_set(F.concat_ws("|", "purpose", "category")).alias("rules"))
    return users.join(pref, "user_id", "left").join(rule, "user_id", "left")


def requester_context(expected: DataFrame, overrides: DataFrame, allowlist: DataFrame) -> DataFrame:
    """One row per (user, requester): expected categories, remembered answer, clipboard allowance."""
    key = ["user_id", "requester_key"]
    e = expected.groupBy(*key).agg(F.collect_set("category").alias("expected"))
    return (
        e.join(overrides.select(*key, F.col("action").alias("override")), key, "full_outer")
        .join(allowlist.select(*key, F.lit(True).alias("clip_allowed")), key, "full_outer")
    )


def with_context(
    events: DataFrame, necessity: DataFrame, profiles: DataFrame, users: DataFrame, requesters: DataFrame,
    form_verdicts: DataFrame | None = None,
) -> DataFrame:
    """Join what the rules need; no step multiplies rows. The matrix has a row per purpose; the planner sizes it.

    With ``form_verdicts`` (``forms.form_context``, by event_id) a form's event also carries the categories of its fields:
    of all fields where the form was only observed, of the filled ones where it was submitted.
    """
    p = consequence_factor(profiles).select("requester_key", "factor", "boost", "clauses", "policy_missing")
    out = (
        events.join(necessity_by_purpose(necessity), "purpose", "left")
        .join(p, "requester_key", "left")
        .join(users, "user_id", "left")
        .join(requesters, ["user_id", "requester_key"], "left")
    )
    if form_verdicts is None:
        return out.selectExpr("*", "CAST(NULL AS map<string,string>) AS form_verdicts", "false AS can_clear", "false AS can_redact")
    out = out.join(form_verdicts, "event_id", "left")
    asked = F.when(F.col("event_type") == "form_observed", F.map_keys("form_verdicts")).when(
        F.col("event_type") == "form_submit", F.col("filled_categories")
    )
    both = F.array_sort(F.array_union(F.coalesce("categories", F.expr(_NONE)), asked))
    return out.withColumn("categories", F.when(asked.isNotNull(), both).otherwise(F.col("categories"))).drop("filled_categories")


def judge_categories(ctx: DataFrame) -> DataFrame:
    """Adds ``judged``: array<struct<category, verdict, sensitivity, risk, preference, ruled, protected>>."""
    verdict = (
        "coalesce(try_element_at(form_verdicts, c), CASE WHEN verdicts IS NULL OR purpose_confidence < 0.35e0 "
        "THEN 'reasonable' ELSE element_at(verdicts, c) END)"
    )
    risk = (
        f"least(1e0, element_at({_SENSITIVITY}, c) * element_at({_WEIGHT}, {verdict}) * coalesce(factor, 1e0) * (1 + coalesce(boost, 0e0)))"
    )
    preference = "coalesce(try_element_at(prefs, c), try_element_at(prefs, substring_index(c, '.', 1)), 'ask')"
    judged = (
        f"transform(categories, c -> named_struct('category', c, 'verdict', {verdict}, "
        f"'sensitivity', element_at({_SENSITIVITY}, c), 'risk', {risk}, 'preference', {preference}, "
        f"'ruled', substring_index(c, '.', 1) NOT IN {_PROTECTED} AND coalesce(array_contains(rules, concat(purpose, '|', c)), false), "
        f"'protected', substring_index(c, '.', 1) IN {_PROTECTED}))"
    )
    unneeded = "j.verdict IN ('unnecessary', 'red_flag')"
    minimum = (
        "coalesce(array_max(transform(judged, j -> CASE WHEN j.preference = 'always_warn' THEN CASE WHEN j.risk >= 0.4e0 THEN 2 ELSE 1 END "
        "WHEN j.preference = 'reject' THEN 1 ELSE 0 END)), 0)"
    )
    return ctx.withColumn("judged", F.expr(judged)).selectExpr(
        "*",
        "size(categories) AS n_cats",
        "coalesce(array_max(transform(judged, j -> j.risk)), 0e0) AS scored_risk",
        "coalesce(array_max(transform(judged, j -> j.sensitivity)), 0e0) AS severity_prior",
        "CASE WHEN size(categories) > 0 THEN size(filter(judged, j -> NOT j.ruled)) / CAST(size(categories) AS DOUBLE) ELSE 0e0 END AS unexpectedness",
        "forall(judged, j -> j.preference = 'usually_allow') AS all_usual",
        "forall(judged, j -> j.ruled) AS all_ruled",
        "exists(judged, j -> j.protected) AS high_impact",
        f"exists(judged, j -> {unneeded}) AS any_unneeded",
        "transform(filter(judged, j -> j.verdict = 'red_flag'), j -> j.category) AS red_flags",
        f"{minimum} AS minimum",
    )


def rate_limited(events: DataFrame, responses: DataFrame, hours: int = RATE_LIMIT_HOURS) -> DataFrame:
    """Ids of events whose like was answered within the last day.

    An observation is an earlier event of the same user, requester, class and categories that
    was answered before this event; its signals cover this event's, its red flags too, and
    its confidence is not lower by 0.2 or more (see ``coverage.covered``). Events are read
    once and meet their first answers by id; all else is one shuffle by key and day.
    """
    cat_key = F.array_join(F.sort_array("categories"), ",")
    signals = F.when(F.col("event_type") == "consent_banner", F.col("dark_patterns")).when(
        F.col("event_type") == "tracking", F.col("signals")
    ).when(F.col("event_type") == "policy_document", F.coalesce("clauses", F.expr(_NONE))).otherwise(F.expr(_NONE))
    # only tracking weighs its confidence
    confidence = F.when(F.col("event_type") == "tracking", F.col("confidence")).otherwise(0.0)
    # the empty sign stands in every set, so that a set without signs is not the set of an empty string
    signs = F.concat(F.array(F.lit("")), F.transform(signals, lambda x: F.concat(F.lit("s"), x)), F.transform("red_flags", lambda x: F.concat(F.lit("f"), x)))
    first_answer = responses.groupBy("event_id").agg(F.min("us").alias("answered_us"))
    base = events.where("event_type <> 'form_observed'").select(
        "event_id", "user_id", "us", (~F.col("high_impact")).alias("asks"), confidence.alias("conf"), F.array_sort(signs).alias("signs"),
        F.concat_ws("\u001f", "requester_key", "event_type", cat_key).alias("like"),
    )
    return covered(base.join(first_answer, "event_id", "left"), hours * HOUR_US)


def decide_events(judged: DataFrame, limited: DataFrame) -> DataFrame:
    """The level rules in order; ``level_NN`` and ``risk_NN`` keep each step's result.

    All steps are one projection: each names the step before it, and the optimizer stacks them.
    """
    df = judged.join(limited.withColumn("is_limited", F.lit(True)), "event_id", "left")
    is_ = {c: f"event_type = '{c}'" for c in ACTIONS}
    columns: list[str] = []
    level, risk = "", "scored_risk"

    def name(column: str, sql: str) -> None:
        columns.append(f"{sql} AS {column}")

    def step(number: str, level_sql: str, risk_sql: str | None = None) -> None:
        nonlocal level, risk
        if risk_sql is not None:
            name(f"risk_{number}", risk_sql.replace("{risk}", risk))
            risk = f"risk_{number}"
        name(f"level_{number}", level_sql.replace("{level}", level).replace("{risk}", risk))
        level = f"level_{number}"

    step(
        "05",
        "CASE WHEN n_cats > 0 AND all_usual THEN CASE WHEN scored_risk < 0.45e0 THEN 0 WHEN scored_risk < 0.75e0 THEN 1 ELSE 2 END "
        "WHEN scored_risk < 0.25e0 THEN 0 WHEN scored_risk < 0.55e0 THEN 1 ELSE 2 END",
    )
    step("06", "greatest({level}, minimum)")
    name("shown", "size(signals) > 0 OR size(tracker_domains) > 0 OR fingerprinting")
    step(
        "08",
        f"CASE WHEN {is_['tracking']} THEN greatest(minimum, CASE WHEN shown THEN 1 ELSE 0 END) ELSE {{level}} END",
        f"CASE WHEN {is_['tracking']} THEN CASE WHEN shown THEN greatest(0.25e0, least(0.54e0, confidence * 0.54e0)) ELSE 0e0 END ELSE {{risk}} END",
    )
    step(
        "09",
        f"CASE WHEN {is_['consent_banner']} THEN greatest({{level}}, CASE WHEN size(dark_patterns) > 0 THEN 2 WHEN {{risk}} >= 0.25e0 THEN 1 ELSE 0 END) ELSE {{level}} END",
        f"CASE WHEN {is_['consent_banner']} THEN greatest({{risk}}, CASE WHEN size(dark_patterns) > 0 THEN 0.55e0 WHEN exists(consent_purposes, p -> p <> 'necessary') THEN 0.3e0 ELSE 0e0 END) ELSE {{risk}} END",
    )
    name("broad", f"{is_['system_access']} AND breadth >= 0.6e0 AND any_unneeded")
    name("reads_history", f"{is_['system_access']} AND breadth >= 0.6e0 AND requester_kind = 'extension' AND array_contains(categories, 'browser_history')")
    step(
        "10",
        "CASE WHEN broad OR reads_history THEN 2 ELSE {level} END",
        "CASE WHEN reads_history THEN greatest({risk}, 0.7e0) WHEN broad THEN greatest({risk}, 0.65e0) ELSE {risk} END",
    )
    name("has_clauses", f"{is_['policy_document']} AND coalesce(size(clauses), 0) > 0")
    name("no_policy", f"{is_['policy_document']} AND coalesce(size(clauses), 0) = 0 AND (missing OR coalesce(policy_missing, false))")
    step(
        "11",
        "CASE WHEN has_clauses THEN 2 WHEN no_policy THEN greatest({level}, 1) ELSE {level} END",
        "CASE WHEN has_clauses THEN greatest({risk}, 0.6e0) WHEN no_policy THEN greatest({risk}, 0.3e0) ELSE {risk} END",
    )
    name("denied", f"{is_['permission_request']} AND state IN ('denied', 'stopped')")
    name("own_clip", f"{is_['clipboard_read']} AND NOT cloud_sync AND (writer_key = requester_key OR coalesce(clip_allowed, false))")
    name("synced", f"{is_['clipboard_read']} AND cloud_sync AND n_cats > 0")
    step(
        "12",
        f"CASE WHEN {is_['screen_capture']} AND active AND NOT first_grant THEN greatest(minimum, 1) WHEN denied THEN 0 "
        f"WHEN {is_['form_observed']} THEN least({{level}}, 1) WHEN own_clip THEN 0 WHEN synced THEN greatest({{level}}, 1) ELSE {{level}} END",
        "CASE WHEN synced THEN greatest({risk}, 0.3e0) ELSE {risk} END",
    )
    step("12s", "CASE WHEN existing AND NOT any_unneeded AND NOT high_impact THEN minimum ELSE {level} END")
    step(
        "13",
        f"CASE WHEN n_cats > 0 AND size(array_except(categories, coalesce(expected, {_NONE}))) = 0 "
        "THEN CASE WHEN high_impact THEN least({level}, 1) ELSE 0 END ELSE {level} END",
    )
    step("13o", "CASE WHEN coalesce(override, '') = 'allow' AND NOT high_impact THEN 0 ELSE {level} END")
    name("learned", f"{level} = 2 AND NOT high_impact AND n_cats > 0 AND all_ruled")
    step("14", "CASE WHEN learned THEN 1 ELSE {level} END")
    step(
        "15",
        "greatest(CASE WHEN coalesce(is_limited, false) THEN greatest(minimum, {level} - 1) ELSE {level} END, CASE WHEN learned THEN 1 ELSE 0 END)",
    )
    name("part_read", f"{is_['file_upload']} AND partial")
    step(
        "16",
        f"CASE WHEN {is_['redacted_document']} THEN 1 WHEN part_read THEN greatest({{level}}, 1) ELSE {{level}} END",
        "CASE WHEN part_read THEN greatest({risk}, 0.25e0) ELSE {risk} END",
    )
    columns.extend(action_columns())
    step("17", "CASE WHEN denied THEN 0 WHEN auto_action <> '' THEN least({level}, 1) ELSE {level} END")
    name("risk", risk)
    name("level", level)
    name("outcome", "element_at(array(" + ", ".join(f"'{x}'" for x in LEVELS) + f"), {level} + 1)")
    return df.selectExpr("*", *columns)


def action_columns() -> list[str]:
    """SQL for the offered actions, the default one, and the one that runs unasked."""
    def array_sql(items: list[str]) -> str:
        return "array(" + ", ".join(f"'{i}'" for i in items) + ")"

    offered = (
        "CASE event_type "
        + " ".join(f"WHEN '{c}' THEN {array_sql(a)}" for c, (a, _) in ACTIONS.items())
        + f" ELSE {array_sql(OTHER_ACTIONS[0])} END"
    )
    default = (
        "CASE event_type "
        + " ".join(f"WHEN '{c}' THEN '{d}'" for c, (_, d) in ACTIONS.items())
        + f" ELSE '{OTHER_ACTIONS[1]}' END"
    )
    ask = "event_type = 'consent_banner' AND NOT coalesce(reject_optional_cookies, true)"
    located = "event_type = 'file_upload' AND array_contains(categories, 'location_precise')"
    actions = (
        f"CASE WHEN {ask} THEN array('view_details', 'reject_optional', 'continue') "
        f"WHEN {located} AND n_cats = 1 THEN array('strip_metadata', 'cancel', 'continue') "
        f"WHEN {located} THEN array('strip_metadata', 'cancel', 'continue', 'redact') "
        f"ELSE filter({offered}, a -> NOT (a = 'clear_fields' AND NOT coalesce(can_clear, false)) "
        "AND NOT (a = 'redact_fields' AND NOT coalesce(can_redact, false))) END"
    )
    authorised = "(default_action = 'reject_optional' AND coalesce(auto_reject, false)) OR (default_action = 'block' AND coalesce(auto_block, false))"
    return [
        f"{actions} AS actions",
        f"CASE WHEN {ask} THEN 'view_details' ELSE {default} END AS default_action",
        f"CASE WHEN ({authorised}) AND array_contains(actions, default_action) THEN default_action ELSE '' END AS auto_action",
    ]


def finding_rows(judged: DataFrame) -> DataFrame:
    """One row per event and category, worst first: (event_id, pos, category, severity, label).

    An event has few categories, so the order is made inside its row.
    """
    labels = "map(" + ", ".join(f"'{c}', '{label}'" for c, label, _ in CATEGORIES) + ")"
    effects = "map(" + ", ".join(f"'{c}', '{e}'" for c, e in CONSEQUENCES.items()) + ")"
    unneeded = "j.verdict IN ('unnecessary', 'red_flag')"
    broad = "event_type IN ('system_access', 'permission_request', 'screen_capture')"
    label = (
        f"CASE WHEN {unneeded} AND {broad} AND try_element_at({effects}, j.category) IS NOT NULL "
        f"THEN concat(element_at({labels}, j.category), ' — ', element_at({effects}, j.category)) "
        f"WHEN j.verdict = 'required' THEN concat(element_at({labels}, j.category), ' — needed for this') ELSE element_at({labels}, j.category) END"
    )
    rows = (
        f"array_sort(transform(judged, j -> named_struct('rank', CASE WHEN {unneeded} THEN 0 WHEN j.verdict = 'required' THEN 2 ELSE 1 END, "
        f"'weight', -j.sensitivity, 'label', {label}, 'category', j.category)))"
    )
    out = judged.select("event_id", F.posexplode(F.expr(rows)).alias("pos", "r"))
    severity = F.when(F.col("r.rank") == 0, "warn").when(F.col("r.rank") == 2, "ok").otherwise("info")
    return out.select("event_id", F.col("pos"), F.col("r.category").alias("category"), severity.alias("severity"), F.col("r.label").alias("label"))


def with_urgency(decided: DataFrame) -> DataFrame:
    """How loudly a decision is shown, from outcome, risk, automatic action and warnings."""
    warned = F.col("any_unneeded")
    urgency = (
        F.when(F.col("outcome") == "INTERVENE", F.when(F.col("risk") >= ACT_NOW_RISK, "act_now").otherwise("attention"))
        .when(F.col("auto_action") != "", "all_clear")
        .when(warned, "heads_up")
        .when(F.col("risk") < SETTLED_RISK, "all_clear")
        .when(F.col("outcome") == "INFORM", "heads_up")
        .otherwise("note")
    )
    return decided.withColumn("urgency", urgency)


def notice_signature(df: DataFrame) -> DataFrame:
    """Adds ``signature``: what makes a notice the same notice; null where it is always raised."""
    sep = "\u001f"
    parts = (
        F.when(F.col("event_type") == "tracking", F.array().cast("array<string>"))
        .when(
            F.col("event_type") == "consent_banner",
            F.concat(
                F.array("cmp"), F.sort_array(F.array_distinct("dark_patterns")), F.sort_array(F.array_distinct("consent_purposes"))
            ),
        )
        .when(F.col("event_type") == "permission_request", F.array("permission", "state"))
        .when(F.col("event_type") == "system_access", F.sort_array(F.array_distinct("accesses")))
        .when(F.col("event_type") == "screen_capture", F.array(F.when(F.col("active"), "active=True").otherwise("active=False")))
        .when(F.col("event_type") == "startup_registration", F.array("mechanism"))
        .when(F.col("event_type") == "redacted_document", F.array("file_path"))
        .otherwise(F.sort_array("categories"))
    )
    whole = F.concat_ws(sep, F.col("event_type"), F.col("requester_key"), parts)
    return df.withColumn("signature", F.when(~F.col("event_type").isin(ALWAYS_ASK), whole))
