from __future__ import annotations

from pyspark.sql import functions as F

from privatrail.dims import forms as K
from privatrail.dims import values_sql
from privatrail.dims.categories import CATEGORIES
from privatrail.operators import forms as O
from privatrail.plans.registry import query
from privatrail.sources.model import model, with_model
from privatrail.sources.tables import read_table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_votes = ", ".join(
    "{'n': " + (f"CASE WHEN regexp_matches(t, {_q('(?i)' + K.NOT_THIS_FIELD[n])}) THEN 0 ELSE " if n in K.NOT_THIS_FIELD else "")
    + f"length(regexp_extract(t, {_q('(?i)' + p)}, 0))" + (" END" if n in K.NOT_THIS_FIELD else "") + f", 'o': -{i}, 'c': '{n}'}}"
    for i, (n, p) in enumerate(K.LEXICON.items())
)
_tok = "list_filter(list_transform(regexp_split_to_array(lower(autocomplete), ' +'), lambda t: CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.AUTOCOMPLETE.items()) + " END), lambda t: t IS NOT NULL)[1]"
LABELLED = f"""WITH lx AS (SELECT *, CASE WHEN g.n > 0 THEN g.c END AS by_words, {_tok} AS by_token, CASE input_type WHEN 'email' THEN 'email' WHEN 'tel' THEN 'phone' WHEN 'password' THEN 'credentials.password' END AS by_type
  FROM (SELECT *, list_max([{_votes}]) AS g FROM (SELECT *, label || ' ' || name || ' ' || field_id AS t FROM form_fields) x) y),
lab AS (SELECT *, coalesce(by_token, by_type, by_words) AS category FROM lx)
"""


def _sql(body: str) -> str:
    return with_model("form_fields", body=LABELLED + body)


def _labelled(spark, sf):
    return O.label_fields(model(spark, sf, "form_fields"))


def _forms(spark, sf):
    return O.classify_forms(O.describe(_labelled(spark, sf)))


def _judged(spark, sf):
    return O.assess_forms(model(spark, sf, "form_fields"))


@query("f01_field_labels", _sql("SELECT form_id, field_id, category, CASE WHEN by_token IS NOT NULL THEN 0.99 WHEN by_type IS NOT NULL THEN 0.98 WHEN by_words IS NOT NULL THEN 0.9 ELSE 0.0 END AS confidence FROM lab"))
def f01(spark, sf):
    return _labelled(spark, sf).select("form_id", "field_id", "category", "confidence")


@query("f02_lexicon", _sql("SELECT form_id, field_id, by_words AS category FROM lx"))
def f02(spark, sf):
    f = model(spark, sf, "form_fields")
    return f.select("form_id", "field_id", F.expr(O.lexicon_sql("concat_ws(' ', label, name, field_id)")).alias("category"))


@query(
    "f03_form_structure",
    _sql("""SELECT form_id, count(*) AS field_count, coalesce(array_to_string(list_sort(list_distinct(list(category) FILTER (category IS NOT NULL))), ','), '') AS categories, count(CASE WHEN input_type = 'password' THEN 1 END) AS password_count,
    bool_or(input_type = 'textarea') AS textarea, bool_or(input_type = 'file') AS file_upload, bool_or(input_type = 'search') AS search_box, bool_or(autocomplete LIKE '%current-password%') AS current_password,
    bool_or(autocomplete LIKE '%new-password%') AS new_password, bool_or(autocomplete LIKE '%shipping%') AS shipping_section, bool_or(autocomplete LIKE '%billing%') AS billing_section,
    bool_or(autocomplete = 'cc-number' OR coalesce(category, '') = 'financial.card_number') AS card, count(CASE WHEN required OR asserted_required THEN 1 END) AS required_count,
    count(CASE WHEN category IN ('email', 'phone') THEN 1 END) + count(CASE WHEN category IS NULL AND lower(label) LIKE '%username%' THEN 1 END) AS identifiers FROM lab GROUP BY form_id"""),
)
def f03(spark, sf):
    d = O.describe(_labelled(spark, sf))
    return d.select(
        "form_id", "field_count", F.array_join("categories", ",").alias("categories"), "password_count", "textarea", "file_upload", "search_box",
        "current_password", "new_password", "shipping_section", "billing_section", "card", "required_count", "identifiers",
    )


# the rules once more, in SQL: what each sign is worth, then softmax, then the verdicts
_HAS = "list_contains(cats, '{}')"
_PLAIN = "pw = 0 AND NOT card AND " + _HAS.format("email")
_KNOWN = "(identifiers > 0 OR " + _HAS.format("full_name") + ")"
_SIGNS = {
    "account_signup": [(f"fresh AND NOT cur AND {_KNOWN}", 3.0), ("pw >= 2 AND NOT cur", 1.0)],
    "account_login": [("cur AND NOT fresh", 3.8)],
    "password_reset": [(f"fresh AND NOT cur AND NOT {_KNOWN}", 3.0), ("pw >= 2 AND NOT cur", 1.0)],
    "two_factor": [("one_time AND pw = 0", 4.0)],
    "checkout_payment": [("card", 4.0), ("billing", 1.5)],
    "shipping_address": [("shipping", 3.0), ("NOT shipping AND pw = 0 AND NOT card AND " + _HAS.format("postal_address") + " AND NOT " + _HAS.format("dob"), 1.6)],
    "newsletter": [("pw = 0 AND n <= 2 AND " + _HAS.format("email"), 2.2)],
    "lead_capture": [(_PLAIN + " AND n >= 4", 0.9), (_PLAIN + " AND n >= 6", 0.6)],
    "contact_support": [("textarea AND " + _HAS.format("email"), 2.2)],
    "profile_edit": [("fresh AND cur", 2.4)],
    "identity_verification": [("len(list_filter(cats, lambda c: c LIKE 'government_id%')) > 0", 2.6)],
    "job_application": [("upload AND (" + _HAS.format("email") + " OR " + _HAS.format("phone") + ")", 2.0)],
    "booking": [],
    "survey_feedback": [(_PLAIN + " AND n >= 6", 0.4)],
    "search_filter": [("searches AND n <= 2", 3.5)],
}
_signs = ", ".join(
    f"{{'i': '{name}', 'o': {i}, 's': " + (" + ".join(f"CASE WHEN {t} THEN {v}e0 ELSE 0e0 END" for t, v in signs) or "0e0") + "}"
    for i, (name, signs) in enumerate(_SIGNS.items())
)
_prior = values_sql([(p, i, w) for p, weights in K.PRIOR.items() for i, w in weights.items()], "purpose, intent, w")
INTENT = f""",
st AS (SELECT form_id, any_value(site_purpose) AS site_purpose, count(*) AS n, coalesce(list_distinct(list(category) FILTER (category IS NOT NULL)), []) AS cats,
    count(CASE WHEN input_type = 'password' THEN 1 END) AS pw, bool_or(input_type = 'textarea') AS textarea, bool_or(input_type = 'file') AS upload, bool_or(input_type = 'search') AS searches,
    bool_or(autocomplete LIKE '%current-password%') AS cur, bool_or(autocomplete LIKE '%new-password%') AS fresh, bool_or(autocomplete LIKE '%shipping%') AS shipping, bool_or(autocomplete LIKE '%billing%') AS billing,
    bool_or(autocomplete = 'cc-number' OR coalesce(category, '') = 'financial.card_number') AS card,
    bool_or(autocomplete = 'one-time-code' OR (max_length BETWEEN 1 AND 8 AND input_type IN ('tel', 'number', 'text') AND regexp_matches(lower(label || ' ' || name || ' ' || field_id), 'code|otp|passcode|verification|token|pin'))) AS one_time,
    count(CASE WHEN category IN ('email', 'phone') THEN 1 END) + count(CASE WHEN category IS NULL AND lower(label) LIKE '%username%' THEN 1 END) AS identifiers FROM lab GROUP BY form_id),
sc AS (SELECT form_id, e.i AS intent, e.o, e.s AS structural, e.s + coalesce(w, 0e0) AS score FROM (SELECT form_id, site_purpose, unnest([{_signs}]) AS e FROM st) x
    LEFT JOIN ({_prior}) p ON p.purpose = site_purpose AND p.intent = e.i),
rk AS (SELECT *, row_number() OVER (PARTITION BY form_id ORDER BY score DESC, o) AS r, max(score) OVER (PARTITION BY form_id) AS top FROM sc),
fi AS (SELECT form_id, CASE WHEN max(top) > 0 THEN max(CASE WHEN r = 1 THEN intent END) ELSE 'unknown' END AS intent, CASE WHEN max(top) > 0 THEN 1e0 / sum(exp(score - top)) ELSE 0e0 END AS conf,
    CASE WHEN max(top) > 0 THEN max(CASE WHEN r = 2 THEN intent END) ELSE 'unknown' END AS runner_up FROM rk GROUP BY form_id)
"""


def _in_list(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _pairs(table: dict[str, list[str]], columns: str) -> str:
    return values_sql([(k, x) for k, names in table.items() for x in names], columns)


_listed = lambda table: f"EXISTS (SELECT 1 FROM ({_pairs(table, 'g, c')}) t WHERE t.g = goal AND t.c IN (category, root))"
_sens = values_sql([(c, s) for c, _, s in CATEGORIES], "category, sensitivity")
JUDGED = INTENT + f""",
f0 AS (SELECT l.*, fi.intent, conf, pw, identifiers, split_part(category, '.', 1) AS root, site_purpose IN {_in_list(K.IMPLAUSIBLE)} AS implausible,
    EXISTS (SELECT 1 FROM ({_pairs(K.PLAUSIBLE, 'p, r')}) t WHERE t.p = l.site_purpose AND t.r IN ('government_id', 'medical')) AS verifies,
    EXISTS (SELECT 1 FROM ({_pairs(K.PLAUSIBLE, 'p, r')}) t WHERE t.p = l.site_purpose AND t.r = split_part(l.category, '.', 1)) AS fits FROM lab l JOIN fi USING (form_id) JOIN (SELECT form_id, pw, identifiers FROM st) s USING (form_id)),
f1 AS (SELECT *, CASE WHEN conf < 0.45e0 OR (intent = 'identity_verification' AND NOT verifies) THEN 'unknown' ELSE intent END AS goal FROM f0),
f2 AS (SELECT *, goal IN {_in_list(K.AUTH_INTENTS)} OR (goal = 'unknown' AND input_type = 'password') AS cred, root IN {_in_list(K.SENSITIVE_ROOTS)} AS sensitive,
    CASE WHEN {_listed(K.RED_FLAG)} THEN 'red_flag' WHEN {_listed(K.REQUIRED)} THEN 'required' WHEN {_listed(K.REASONABLE)} THEN 'reasonable' WHEN root IN {_in_list(K.SENSITIVE_ROOTS)} THEN 'red_flag' ELSE 'unnecessary' END AS tab FROM f1),
f3 AS (SELECT *, CASE WHEN category IS NULL THEN 'reasonable'
    WHEN goal = 'unknown' THEN CASE WHEN sensitive AND NOT (root = 'credentials' AND cred) THEN CASE WHEN implausible THEN 'red_flag' WHEN NOT fits THEN 'unnecessary' ELSE 'reasonable' END ELSE 'reasonable' END
    WHEN sensitive AND tab IN ('unnecessary', 'red_flag') THEN CASE WHEN fits THEN 'reasonable' WHEN implausible THEN 'red_flag' ELSE tab END ELSE tab END AS v1,
    regexp_matches(lower(label), ' or ') AND regexp_matches(lower(label), 'e.?mail') AND regexp_matches(lower(label), 'tel') AS either FROM f2),
f4 AS (SELECT *, CASE WHEN category IS NULL THEN 'profile_detail' WHEN root = 'credentials' THEN CASE WHEN cred THEN 'credential' ELSE 'unrelated_collection' END
    WHEN root = 'financial' AND goal IN {_in_list(K.PAYMENT_INTENTS)} THEN 'payment_instrument'
    WHEN goal = 'identity_verification' AND (root = 'government_id' OR category IN ('dob', 'biometric_photo')) THEN 'verification_evidence'
    WHEN goal IN ('account_signup', 'account_login', 'password_reset') AND category IN ('email', 'phone') THEN CASE WHEN either OR identifiers > 1 THEN 'alternate_identifier' ELSE 'primary_identifier' END
    WHEN goal IN ('shipping_address', 'checkout_payment') AND category IN ('postal_address', 'full_name') THEN 'delivery_target'
    WHEN category IN ('email', 'phone', 'postal_address') AND v1 IN ('required', 'reasonable') THEN 'contact_channel'
    WHEN v1 IN ('unnecessary', 'red_flag') THEN CASE WHEN required OR asserted_required THEN 'unrelated_collection' ELSE 'marketing_optional' END ELSE 'profile_detail' END AS role FROM f3),
f5 AS (SELECT *, CASE WHEN role IN ('primary_identifier', 'alternate_identifier') THEN 'required' ELSE v1 END AS verdict FROM f4),
jd AS (SELECT f5.*, CASE WHEN f5.category IS NULL OR role = 'credential' THEN FALSE WHEN verdict = 'red_flag' THEN TRUE
    WHEN role IN ('primary_identifier', 'alternate_identifier', 'payment_instrument', 'delivery_target', 'verification_evidence') OR verdict IN ('required', 'reasonable') THEN FALSE
    WHEN conf < 0.45e0 THEN FALSE ELSE (required OR asserted_required OR filled) AND sensitivity >= 0.45e0 END AS flag FROM f5 LEFT JOIN ({_sens}) c ON c.category = f5.category)
"""


def _judged_sql(body: str) -> str:
    return with_model("form_fields", body=LABELLED + JUDGED + body)


@query("f04_structural_evidence", with_model("form_fields", body=LABELLED + INTENT + "SELECT form_id, intent, round(structural, 6) AS score FROM sc"))
def f04(spark, sf):
    return O.structural_evidence(O.describe(_labelled(spark, sf))).select("form_id", "intent", F.round("score", 6).alias("score"))


CENTERS = """WITH l AS (SELECT label, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
m AS (SELECT label, d, avg(x) AS m FROM l GROUP BY ALL), n AS (SELECT label, greatest(sqrt(sum(m * m)), 1e-9) AS n FROM m GROUP BY label),
c AS (SELECT m.label, d, m / n AS c FROM m JOIN n USING (label))
"""


@query(
    "f05_semantic_evidence",
    CENTERS + """, v AS (SELECT vec_id, generate_subscripts(embedding, 1) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
    s AS (SELECT vec_id, label, sum(x * c) AS s FROM v JOIN c USING (d) GROUP BY ALL)
    SELECT vec_id, label, round(2.2 * greatest(-4, least(4, (s - avg(s) OVER (PARTITION BY vec_id)) / 0.09)), 4) AS score FROM s""",
)
def f05(spark, sf):
    v = read_table(spark, sf, "embeddings")
    out = O.semantic_evidence(v.select("vec_id", "embedding"), O.centroids(v))
    return out.select("vec_id", F.inline("evidence")).select("vec_id", "label", F.round("score", 4).alias("score"))


@query("f06_intent_centroids", CENTERS + "SELECT label, CAST(d - 1 AS INT) AS dim, round(c, 5) AS c FROM c")
def f06(spark, sf):
    return O.centroids(read_table(spark, sf, "embeddings")).select("label", F.posexplode("centroid").alias("dim", "c")).withColumn("c", F.round("c", 5))


@query("f07_form_intent", with_model("form_fields", body=LABELLED + INTENT + "SELECT form_id, intent, round(conf, 6) AS intent_confidence, runner_up FROM fi"))
def f07(spark, sf):
    return _forms(spark, sf).select("form_id", "intent", F.round("intent_confidence", 6).alias("intent_confidence"), "runner_up")


def _field(name: str, *cols: str) -> None:
    sql = ", ".join({"goal": "goal", "first_verdict": "v1 AS first_verdict", "credential_expected": "cred AS credential_expected"}.get(c, c) for c in cols)
    query(name, _judged_sql(f"SELECT form_id, field_id, {sql} FROM jd"))(lambda spark, sf: _judged(spark, sf).select("form_id", "field_id", *cols))


_field("f08_field_verdicts", "category", "goal", "first_verdict")
_field("f09_credential_expected", "credential_expected")
_field("f10_field_roles", "role")
_field("f11_flagged_fields", "flag")
_field("f12_form_assessment", "category", "intent", "role", "verdict", "flag")


@query(
    "f13_worst_verdicts",
    _judged_sql("SELECT form_id, category, (['required', 'reasonable', 'unnecessary', 'red_flag'])[max(list_position(['required', 'reasonable', 'unnecessary', 'red_flag'], verdict))] AS verdict FROM jd WHERE category IS NOT NULL GROUP BY form_id, category"),
)
def f13(spark, sf):
    return O.worst_verdicts(_judged(spark, sf))


@query(
    "f14_field_remedies",
    _judged_sql(f"""SELECT form_id, field_id, NOT required AND NOT asserted_required AS can_clear, input_type NOT IN {_in_list(K.UNREDACTABLE)} AS can_redact
    FROM jd j WHERE filled AND EXISTS (SELECT 1 FROM jd k WHERE k.form_id = j.form_id AND k.category = j.category AND k.flag)"""),
)
def f14(spark, sf):
    return O.remedies(_judged(spark, sf))
