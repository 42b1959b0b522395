"""Forms: what a field asks for, what a form is for, and what it has no business asking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privatrail.dims import forms as D
from privatrail.functions.text import FLAGS
from privatrail.functions.validators import bind, quoted
from privatrail.operators.decisions import _SENSITIVITY


def _list(words: list[str]) -> str:
    return "array(" + ", ".join(quoted(w) for w in words) + ")"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(quoted(w) for w in words) + ")"


def _map(table: dict[str, str]) -> str:
    return "map(" + ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in table.items()) + ")"


def _lists(table: dict[str, list[str]]) -> str:
    return "map(" + ", ".join(f"{quoted(k)}, {_list(v)}" for k, v in table.items()) + ")"


def lexicon_sql(text: str) -> str:
    """The category that accounts for the longest piece of the wording; earlier entries win ties."""
    votes = []
    for order, (name, pattern) in enumerate(D.LEXICON.items()):
        length = f"length(regexp_extract(t, {quoted(FLAGS + pattern)}, 0))"
        if name in D.NOT_THIS_FIELD:
            length = f"CASE WHEN t RLIKE {quoted(FLAGS + D.NOT_THIS_FIELD[name])} THEN 0 ELSE {length} END"
        votes.append(f"named_struct('n', {length}, 'o', -{order}, 'c', {quoted(name)})")
    best = bind(f"greatest({', '.join(votes)})", "g", "CASE WHEN g.n > 0 THEN g.c END")
    return bind(text, "t", best)


def label_fields(fields: DataFrame) -> DataFrame:
    """Adds ``category`` and ``confidence``: autocomplete, then input type, then the wording."""
    token = f"get(filter(transform(split(lower(autocomplete), ' +'), t -> try_element_at({_map(D.AUTOCOMPLETE)}, t)), t -> t IS NOT NULL), 0)"
    kind = f"try_element_at({_map(D.INPUT_TYPES)}, input_type)"
    out = fields.selectExpr(
        "*", f"{token} AS by_token", f"{kind} AS by_type", f"{lexicon_sql('concat_ws(chr(32), label, name, field_id)')} AS by_words"
    )
    return out.selectExpr(
        "* EXCEPT (by_token, by_type, by_words)",
        "coalesce(by_token, by_type, by_words) AS category",
        "CASE WHEN by_token IS NOT NULL THEN 0.99e0 WHEN by_type IS NOT NULL THEN 0.98e0 WHEN by_words IS NOT NULL THEN 0.9e0 ELSE 0e0 END AS confidence",
    )


def describe(labelled: DataFrame) -> DataFrame:
    """One row per form: its shape. A form has a handful of fields by nature."""
    words = "lower(concat_ws(' ', label, name, field_id))"
    code = f"max_length BETWEEN 1 AND 8 AND input_type IN ('tel', 'number', 'text') AND {words} RLIKE 'code|otp|passcode|verification|token|pin'"
    user = (
        f"category IS NULL AND (concat({words}, ' ', lower(autocomplete)) RLIKE 'username|user name' "
        f"OR trim(concat({words}, ' ', lower(autocomplete))) IN ('user', 'login', 'handle'))"
    )
    e = F.expr
    return labelled.groupBy("form_id").agg(
        F.first("site_purpose").alias("site_purpose"),
        F.count("*").alias("field_count"),
        F.sort_array(F.collect_set("category")).alias("categories"),
        e("array_distinct(flatten(collect_list(filter(split(lower(autocomplete), ' +'), t -> t <> ''))))").alias("tokens"),
        e("count_if(input_type = 'password')").alias("password_count"),
        e(f"bool_or({code})").alias("short_code"),
        e("bool_or(input_type IN ('textarea', 'contenteditable'))").alias("textarea"),
        e("bool_or(input_type = 'file')").alias("file_upload"),
        e("bool_or(input_type = 'search')").alias("search_box"),
        e(f"count_if(category IN ('email', 'phone')) + count_if({user})").alias("identifiers"),
        e("count_if(required OR asserted_required)").alias("required_count"),
    ).selectExpr(
        "*",
        "array_contains(tokens, 'current-password') AS current_password",
        "array_contains(tokens, 'new-password') AS new_password",
        "array_contains(tokens, 'one-time-code') OR short_code AS one_time_code",
        "arrays_overlap(tokens, array('cc-number', 'cc-csc', 'cc-exp', 'cc-exp-month', 'cc-exp-year')) OR array_contains(categories, 'financial.card_number') AS card",
        "array_contains(tokens, 'shipping') AS shipping_section",
        "array_contains(tokens, 'billing') AS billing_section",
    )


def _evidence() -> dict[str, list[tuple[str, float]]]:
    def has(c: str) -> str:
        return f"array_contains(categories, '{c}')"

    no_pw = "password_count = 0"
    fresh = "new_password AND NOT current_password"
    known = f"(identifiers > 0 OR {has('full_name')})"
    plain = f"{no_pw} AND NOT card AND {has('email')}"
    # fixed values: log-odds of each structural sign
    return {
        "account_signup": [(f"{fresh} AND {known}", 3.0), ("password_count >= 2 AND NOT current_password", 1.0)],
        "account_login": [("current_password AND NOT new_password", 3.8)],
        "password_reset": [(f"{fresh} AND NOT {known}", 3.0), ("password_count >= 2 AND NOT current_password", 1.0)],
        "two_factor": [(f"one_time_code AND {no_pw}", 4.0)],
        "checkout_payment": [("card", 4.0), ("billing_section", 1.5)],
        "shipping_address": [
            ("shipping_section", 3.0),
            (f"NOT shipping_section AND {has('postal_address')} AND {no_pw} AND NOT card AND NOT {has('dob')}", 1.6),
        ],
        "newsletter": [(f"{no_pw} AND field_count <= 2 AND {has('email')}", 2.2)],
        "lead_capture": [(f"{plain} AND field_count >= 4", 0.9), (f"{plain} AND field_count >= 6", 0.6)],
        "contact_support": [(f"textarea AND {has('email')}", 2.2)],
        "profile_edit": [("new_password AND current_password", 2.4)],
        "identity_verification": [("exists(categories, c -> startswith(c, 'government_id'))", 2.6)],
        "job_application": [(f"file_upload AND ({has('email')} OR {has('phone')})", 2.0)],
        "booking": [],
        "survey_feedback": [(f"{plain} AND field_count >= 6", 0.4)],
        "search_filter": [("search_box AND field_count <= 2", 3.5)],
    }


def structural_evidence(structure: DataFrame) -> DataFrame:
    """(form_id, intent, score): what a form's shape alone says for each intent."""
    rows = []
    for intent in D.INTENTS:
        parts = [f"CASE WHEN {test} THEN {value}e0 ELSE 0e0 END" for test, value in _evidence()[intent]] or ["0e0"]
        rows.append(f"named_struct('intent', {quoted(intent)}, 'score', {' + '.join(parts)})")
    return structure.selectExpr("form_id", f"inline(array({', '.join(rows)}))")


def classify_forms(structure: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """Adds ``intent``, ``intent_confidence`` and ``runner_up`` by softmax over all evidence.

    The intents are a fixed short list, so scores stay an array inside the form's row.
    ``semantic`` (form_id, semantic map<intent, score>) is optional sentence evidence.
    """
    prior = "map(" + ", ".join(
        f"{quoted(p)}, map(" + ", ".join(f"{quoted(intent)}, {weight}e0" for intent, weight in v.items()) + ")" for p, v in D.PRIOR.items()
    ) + ")"
    rows = []
    for order, intent in enumerate(D.INTENTS):
        parts = [f"CASE WHEN {test} THEN {value}e0 ELSE 0e0 END" for test, value in _evidence()[intent]] or ["0e0"]
        parts.append(f"coalesce(try_element_at(priors, {quoted(intent)}), 0e0)")
        parts.append(f"coalesce(try_element_at(semantic, {quoted(intent)}), 0e0)")
        rows.append(f"named_struct('score', {' + '.join(parts)}, 'o', -{order}, 'intent', {quoted(intent)})")
    if semantic is None:
        joined = structure.selectExpr("*", "CAST(NULL AS map<string,double>) AS semantic")
    else:
        joined = structure.join(semantic, "form_id", "left")
    scored = joined.selectExpr("*", f"try_element_at({prior}, site_purpose) AS priors").selectExpr(
        "* EXCEPT (priors, semantic)", f"sort_array(array({', '.join(rows)}), false) AS scores"
    )
    known = "scores[0].score > 0"
    return scored.selectExpr(
        "*",
        f"CASE WHEN {known} THEN scores[0].intent ELSE 'unknown' END AS intent",
        f"CASE WHEN {known} THEN 1e0 / aggregate(scores, 0e0, (a, s) -> a + exp(s.score - scores[0].score)) ELSE 0e0 END AS intent_confidence",
        f"CASE WHEN {known} THEN scores[1].intent ELSE 'unknown' END AS runner_up",
    )


def judge_fields(labelled: DataFrame, forms: DataFrame) -> DataFrame:
    """Verdict, role and flag of every field, judged against what its form is for."""
    cols = ["form_id", "intent", "intent_confidence", "password_count", "identifiers"]
    f = labelled.join(forms.select(*cols), "form_id").selectExpr(
        "*",
        "substring_index(category, '.', 1) AS root",
        f"coalesce(try_element_at({_lists(D.PLAUSIBLE)}, site_purpose), CAST(array() AS array<string>)) AS plausible",
        f"site_purpose IN {_in(D.IMPLAUSIBLE)} AS implausible",
    )
    verifies = "arrays_overlap(plausible, array('government_id', 'medical'))"
    f = f.selectExpr(
        "*",
        f"CASE WHEN intent_confidence < {D.MIN_INTENT_CONFIDENCE}e0 OR (intent = 'identity_verification' AND NOT {verifies}) THEN 'unknown' ELSE intent END AS goal",
    ).selectExpr(
        "*",
        f"goal IN {_in(D.AUTH_INTENTS)} OR (goal = 'unknown' AND input_type = 'password' AND password_count > 0) AS credential_expected",
        f"root IN {_in(D.SENSITIVE_ROOTS)} AS sensitive",
    )

    def member(table: dict[str, list[str]]) -> str:
        return f"coalesce(exists(try_element_at({_lists(table)}, goal), g -> g = category OR g = root), false)"

    watched = "sensitive AND (root <> 'credentials' OR NOT credential_expected)"
    unknown = (
        f"CASE WHEN {watched} AND implausible THEN 'red_flag' WHEN {watched} AND NOT array_contains(plausible, root) THEN 'unnecessary' ELSE 'reasonable' END"
    )
    table = (
        f"CASE WHEN {member(D.RED_FLAG)} THEN 'red_flag' WHEN {member(D.REQUIRED)} THEN 'required' WHEN {member(D.REASONABLE)} THEN 'reasonable' "
        "WHEN sensitive THEN 'red_flag' ELSE 'unnecessary' END"
    )
    f = f.selectExpr("*", f"{table} AS by_table").selectExpr(
        "*",
        f"CASE WHEN category IS NULL THEN 'reasonable' WHEN goal = 'unknown' OR intent_confidence < {D.MIN_INTENT_CONFIDENCE}e0 THEN {unknown} "
        "WHEN sensitive AND by_table IN ('unnecessary', 'red_flag') AND array_contains(plausible, root) THEN 'reasonable' "
        "WHEN sensitive AND by_table IN ('unnecessary', 'red_flag') AND implausible THEN 'red_flag' ELSE by_table END AS first_verdict",
    )
    low = "lower(label)"
    either = (
        f"(CAST({low} RLIKE 'e.?mail|correo|courriel' AS INT) + CAST({low} RLIKE 'phone|mobile|tel|handy|m[oó]vil' AS INT) + CAST({low} RLIKE 'user.?name' AS INT)) >= 2 "
        f"AND {low} RLIKE {quoted('(?U)' + chr(92) + 'b(?:or|ou|oder|o|of)' + chr(92) + 'b|/')}"
    )
    role = (
        "CASE WHEN category IS NULL THEN 'profile_detail' "
        "WHEN root = 'credentials' THEN CASE WHEN credential_expected THEN 'credential' ELSE 'unrelated_collection' END "
        f"WHEN root = 'financial' AND goal IN {_in(D.PAYMENT_INTENTS)} THEN 'payment_instrument' "
        "WHEN goal = 'identity_verification' AND (root = 'government_id' OR category IN ('dob', 'biometric_photo')) THEN 'verification_evidence' "
        f"WHEN goal IN ('account_signup', 'account_login', 'password_reset') AND category IN ('email', 'phone') THEN CASE WHEN ({either}) OR identifiers > 1 THEN 'alternate_identifier' ELSE 'primary_identifier' END "
        "WHEN goal IN ('shipping_address', 'checkout_payment') AND category IN ('postal_address', 'full_name') THEN 'delivery_target' "
        "WHEN category IN ('email', 'phone', 'postal_address') AND first_verdict IN ('required', 'reasonable') THEN 'contact_channel' "
        "WHEN first_verdict IN ('unnecessary', 'red_flag') THEN CASE WHEN required OR asserted_required THEN 'unrelated_collection' ELSE 'marketing_optional' END "
        "ELSE 'profile_detail' END"
    )
    never = "('primary_identifier', 'alternate_identifier', 'payment_instrument', 'delivery_target', 'verification_evidence')"
    worth = f"element_at({_SENSITIVITY}, category) >= {D.SENSITIVITY_FLOOR}e0"
    return f.selectExpr("*", f"{role} AS role").selectExpr(
        "*", "CASE WHEN role IN ('primary_identifier', 'alternate_identifier') THEN 'required' ELSE first_verdict END AS verdict"
    ).selectExpr(
        "*",
        f"CASE WHEN category IS NULL OR role = 'credential' THEN false WHEN verdict = 'red_flag' THEN true WHEN role IN {never} OR verdict IN ('required', 'reasonable') THEN false "
        f"WHEN intent_confidence < {D.MIN_INTENT_CONFIDENCE}e0 THEN false ELSE (required OR asserted_required OR filled) AND {worth} END AS flag",
    )


def assess_forms(fields: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    labelled = label_fields(fields)
    return judge_fields(labelled, classify_forms(describe(labelled), semantic))


_RANK = "element_at(map('required', 0, 'reasonable', 1, 'unnecessary', 2, 'red_flag', 3), verdict)"


def worst_verdicts(judged: DataFrame) -> DataFrame:
    """The worst verdict per form and category."""
    return judged.where("category IS NOT NULL").groupBy("form_id", "category").agg(F.max_by("verdict", F.expr(_RANK)).alias("verdict"))


def remedies(judged: DataFrame) -> DataFrame:
    """Flagged, filled fields: may they be blanked (not required), may they be overwritten."""
    hit = judged.where("filled AND category IS NOT NULL").join(
        judged.where("flag").select("form_id", "category").distinct(), ["form_id", "category"], "left_semi"
    )
    return hit.selectExpr("form_id", "field_id", "NOT required AND NOT asserted_required AS can_clear", f"input_type NOT IN {_in(D.UNREDACTABLE)} AS can_redact")


def form_context(judged: DataFrame) -> DataFrame:
    """(form_id, form_verdicts, filled_categories, can_clear, can_redact): what a form says to the decision on its event.
    The map has one entry per category that the form asks for, the list those of its filled fields."""
    asked = judged.where("category IS NOT NULL").groupBy("form_id", "category").agg(
        F.max_by("verdict", F.expr(_RANK)).alias("verdict"), F.bool_or("filled").alias("filled")
    )
    worst = asked.groupBy("form_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "verdict")))).alias("form_verdicts"),
        F.sort_array(F.collect_list(F.when(F.col("filled"), F.col("category")))).alias("filled_categories"),
    )
    means = remedies(judged).groupBy("form_id").agg(F.bool_or("can_clear").alias("can_clear"), F.bool_or("can_redact").alias("can_redact"))
    return worst.join(means, "form_id", "left")


def centroids(vectors: DataFrame, label: str = "label") -> DataFrame:
    """Mean vector per label, scaled to length one: (label, centroid)."""
    long = vectors.select(label, F.posexplode("embedding").alias("dim", "x"))
    mean = long.groupBy(label, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    whole = mean.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("v"))
    norm = "greatest(sqrt(aggregate(v, 0e0, (a, e) -> a + e.m * e.m)), 1e-9)"
    return whole.selectExpr(label, f"transform(v, e -> e.m / {norm}) AS centroid")


def semantic_evidence(vectors: DataFrame, centers: DataFrame, label: str = "label", max_labels: int = 64) -> DataFrame:
    """Adds ``evidence``: array<struct<score, label>> of centred, clipped similarities.

    One centroid per intent: their number is checked against ``max_labels`` and they become constants of the plan,
    so nothing is joined or broadcast. More labels than that are an error, never cut.
    """
    rows = centers.select(label, "centroid").limit(max_labels + 1).collect()
    if len(rows) > max_labels:
        raise ValueError(f"more than {max_labels} centroids")
    kind = centers.schema[label].dataType.simpleString()
    parts = []
    for row in sorted(rows, key=lambda r: r[0]):
        name = quoted(row[0]) if isinstance(row[0], str) else str(row[0])
        vector = "array(" + ", ".join(f"{x!r}D" for x in row[1]) + ")"
        parts.append(f"named_struct('s', aggregate(zip_with(embedding, {vector}, (a, b) -> a * b), 0e0, (a, x) -> a + x), 'l', CAST({name} AS {kind}))")
    out = vectors.selectExpr("*", f"array({', '.join(parts)}) AS sims")
    mean = "aggregate(sims, 0e0, (a, s) -> a + s.s) / size(sims)"
    score = f"{D.EMBED_WEIGHT}e0 * greatest(-{D.EMBED_CLIP}e0, least({D.EMBED_CLIP}e0, (s.s - {mean}) / {D.EMBED_TEMPERATURE}e0))"
    return out.selectExpr("* EXCEPT (sims)", f"transform(sims, s -> named_struct('score', {score}, 'label', s.l)) AS evidence")
