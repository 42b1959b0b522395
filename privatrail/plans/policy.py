from __future__ import annotations

from pyspark.sql import functions as F

from privatrail.dims import dimension, values_sql
from privatrail.dims import policy as K
from privatrail.operators import decisions as D
from privatrail.operators import policy as L
from privatrail.plans.registry import query
from privatrail.sources.model import model, with_model
from privatrail.sources.tables import read_table, spread


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _m(col: str, patterns: list[str]) -> str:
    return f"regexp_matches({col}, {_q('(?i)' + '|'.join(f'(?:{p})' for p in patterns))})"


SENT = r"""
WITH ln AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line, unnest(a) AS raw FROM (SELECT doc_id, regexp_split_to_array(text, '\n+') AS a FROM policy_texts) x),
lp AS (SELECT doc_id, line, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS p FROM ln WHERE regexp_replace(raw, '^\s+|\s+$', '', 'g') <> ''),
lh AS (SELECT *, coalesce(last_value(CASE WHEN length(p) < 90 AND NOT regexp_matches(p, '[.!?;]') AND (ends_with(p, ':') OR len(regexp_split_to_array(p, '\s+')) <= 5)
   THEN rtrim(p, ':') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line), '') AS heading FROM lp),
sp AS (SELECT doc_id, line, heading, list_filter(list_transform(string_split(regexp_replace(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), ';\s*|\s+(?:but|however|nevertheless)\s+', chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS parts FROM lh),
sent AS (SELECT doc_id, line * 4294967296 + generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS sentence, heading FROM sp)
"""
_conf = lambda r: "CASE WHEN " + " OR ".join(f"contains(lower(heading), '{w.lower()}')" for w in r.scope) + " THEN 0.96e0 ELSE 0.9e0 END"
CLAIMS = SENT + ",\nclaims AS (" + " UNION ALL ".join(
    f"SELECT doc_id, pos, '{r.name}' AS clause, {_conf(r)} AS confidence FROM sent WHERE {_m('sentence', [r.requires])} AND {_m('sentence', r.positive)}"
    + (f" AND NOT {_m('sentence', r.negative)}" if r.negative else "")
    for r in K.CLAUSES
) + "),\nbest AS (SELECT doc_id, clause, pos, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, clause ORDER BY confidence DESC, pos) rn FROM claims) x WHERE rn = 1)\n"


def _sql(body: str) -> str:
    return with_model("policy_texts", body=CLAIMS + body)


def _some_match(text: str, pattern: str, bad: str) -> str:
    """Is there a match for which ``bad`` does not hold? In ``bad``, {at} is where it begins and {end} where it ends."""
    rx = _q("(?i)" + pattern)
    pieces, found = f"regexp_split_to_array({text}, {rx})", f"regexp_extract_all({text}, {rx})"
    size = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)"
    at = f"({size.format(f'({pieces})[1:k]')} + CASE WHEN k > 1 THEN {size.format(f'({found})[1:k - 1]')} ELSE 0 END)"
    end = f"({at} + length(({found})[k]))"
    return f"len(list_filter(range(1, len({found}) + 1), lambda k: NOT ({bad.replace('{at}', at).replace('{end}', end)}))) > 0"


_NEGATED = f"regexp_matches(left(sentence, CAST({{at}} AS INT)), {_q('(?i)' + K.NEGATION)})"
_stated = lambda rules: " UNION ALL ".join(f"SELECT doc_id, '{n}' AS label FROM src WHERE {_some_match('sentence', p, _NEGATED)}" for n, p in rules.items())


def _collects() -> str:
    parts = []
    for name, pattern in K.COLLECTS.items():
        bad = _NEGATED.replace("{at}", "body_at + {at}")
        if name in K.NOT_ABOUT_YOU:
            around = "substr(sentence, CAST(greatest(body_at + {at} - 40, 0) + 1 AS INT), CAST(body_at + {end} + 40 - greatest(body_at + {at} - 40, 0) AS INT))"
            bad += f" OR regexp_matches({around}, {_q('(?i)' + K.NOT_ABOUT_YOU[name])})"
        parts.append(f"SELECT doc_id, '{name}' AS category FROM cb WHERE {_some_match('body', pattern, bad)}")
    return f""",
cv AS (SELECT *, regexp_matches(heading, {_q('(?i)' + K.COLLECTION_HEADING)}) AS headed, length(regexp_extract(sentence, {_q('(?is)^.*?(?:' + K.COLLECTION_VERB + ')')})) AS verb,
    length(regexp_extract(sentence, {_q('(?is)^.*?(?:' + K.HANDLING_VERB + ')')})) AS handling FROM sent),
ce AS (SELECT *, CASE WHEN verb > 0 THEN verb ELSE handling END AS after FROM cv),
cl AS (SELECT *, length(regexp_extract(substr(sentence, CAST(after + 1 AS INT)), {_q('(?is)^.*' + K.ENUMERATION)})) AS listed FROM ce WHERE headed OR after > 0),
cb AS (SELECT *, substr(sentence, CAST(body_at + 1 AS INT)) AS body FROM (SELECT *, CASE WHEN headed THEN 0 ELSE after + listed END AS body_at FROM cl WHERE headed OR verb > 0 OR listed > 0) x),
col AS (SELECT DISTINCT doc_id, category FROM ({" UNION ALL ".join(parts)}) y)
"""


COLLECTED = _collects()


def _docs(spark, sf):
    return spread(model(spark, sf, "policy_texts"))


def _sents(spark, sf):
    return L.sentences(_docs(spark, sf))


def _claims(spark, sf, clauses=None):
    return L.clause_claims(L.sentences(_docs(spark, sf), could=L.claim_guards(clauses)), clauses=clauses)


def _best(spark, sf):
    return L.best_clauses(_claims(spark, sf))


def _clauses(spark, sf):
    """The clauses of each text, whichever sentence says them best."""
    return _claims(spark, sf).select("doc_id", "clause").distinct()


@query("l01_sentences", _sql("SELECT doc_id, pos, sha256(sentence) AS sentence, heading FROM sent"))
def l01(spark, sf):
    return _sents(spark, sf).select("doc_id", "pos", F.sha2("sentence", 256).alias("sentence"), "heading")


@query("l02_clause_claims", _sql("SELECT doc_id, pos, clause, confidence FROM claims"))
def l02(spark, sf):
    return _claims(spark, sf).select("doc_id", "pos", "clause", "confidence")


@query("l03_best_clauses", _sql("SELECT doc_id, clause, pos, confidence FROM best"))
def l03(spark, sf):
    return L.best_clauses(_claims(spark, sf).select("doc_id", "clause", "pos", "confidence"))


@query("l03_citations")
def l03_citations(spark, sf):
    return L.with_citations(_best(spark, sf))


@query(
    "l04_terms_summary",
    _sql("""SELECT d.doc_id, sha256(text) AS digest, trim(text) = '' AS missing, coalesce(array_to_string(list_sort(b.c), ','), '') AS clauses, CASE WHEN trim(text) = '' THEN '' ELSE
    array_to_string(list_filter([CASE WHEN NOT list_has_any(coalesce(b.c, []), ['automatic_renewal', 'liability_cap']) THEN 'payment' END,
      CASE WHEN NOT list_has_any(coalesce(b.c, []), ['minimum_age', 'account_termination_without_notice']) THEN 'account_creation' END, 'basic_service_usage'], lambda x: x IS NOT NULL), ',') END AS ordinary
    FROM policy_texts d LEFT JOIN (SELECT doc_id, list(clause) AS c FROM best GROUP BY doc_id) b USING (doc_id)"""),
)
def l04(spark, sf):
    out = L.terms_summary(_docs(spark, sf), _clauses(spark, sf))
    return out.select("doc_id", "digest", "missing", F.array_join("clauses", ",").alias("clauses"), F.array_join("ordinary", ",").alias("ordinary"))


@query("l05_collected_categories", _sql(COLLECTED + "SELECT doc_id, category FROM col"))
def l05(spark, sf):
    return L.collected(_sents(spark, sf))


@query(
    "l06_purposes_and_recipients",
    _sql(f"""SELECT DISTINCT doc_id, label, 'purpose' AS kind FROM (WITH src AS (SELECT * FROM sent) {_stated(K.PURPOSES)} UNION ALL SELECT doc_id, 'ai_training' FROM claims WHERE clause = 'training_on_user_content') x
    UNION ALL SELECT DISTINCT doc_id, label, 'recipient' FROM (WITH src AS (SELECT * FROM sent WHERE regexp_matches(sentence, {_q('(?i)' + K.SHARING_SENTENCE)}) OR regexp_matches(heading, {_q('(?i)' + K.SHARING_HEADING)})) {_stated(K.RECIPIENTS)}) y"""),
)
def l06(spark, sf):
    return L.purposes_and_recipients(_sents(spark, sf))


_rights = ", ".join(f"CASE WHEN bool_or(regexp_matches(lower(sentence), {_q(p)})) THEN '{n}' END" for n, p in K.RIGHTS.items())


@query(
    "l07_rights_and_contacts",
    _sql(f"""SELECT doc_id, array_to_string(list_sort(list_filter([{_rights}], lambda x: x IS NOT NULL)), ',') AS rights,
    sha256(max_by(sentence, pos) FILTER (regexp_matches(lower(sentence), {_q(K.CHILDREN)}))) AS children, sha256(max_by(sentence, pos) FILTER (regexp_matches(lower(sentence), {_q(K.CONTACT)}))) AS contact FROM sent GROUP BY doc_id"""),
)
def l07(spark, sf):
    out = L.rights_and_contacts(_sents(spark, sf))
    return out.select("doc_id", F.array_join("rights", ",").alias("rights"), F.sha2("children", 256).alias("children"), F.sha2("contact", 256).alias("contact"))


@query(
    "l08_retention",
    _sql(f"""SELECT s.doc_id, CASE WHEN bool_or(b.doc_id IS NOT NULL) THEN 'after_deletion' ELSE coalesce(max_by(kind, pos) FILTER (kind IS NOT NULL), 'unspecified') END AS retention,
    max_by(period, pos) FILTER (period <> '') AS period FROM (SELECT doc_id, pos, regexp_extract(lower(sentence), {_q(K.PERIOD)}, 1) AS period,
      CASE WHEN regexp_matches(lower(sentence), {_q(K.UNTIL_DELETION)}) THEN 'until_deletion' WHEN regexp_extract(lower(sentence), {_q(K.PERIOD)}, 1) <> '' THEN 'stated_period' END AS kind FROM sent) s
    LEFT JOIN (SELECT doc_id FROM best WHERE clause = 'retention_after_deletion') b ON b.doc_id = s.doc_id GROUP BY s.doc_id"""),
)
def l08(spark, sf):
    return L.retention(L.sentences(_docs(spark, sf), could=L.retention_guards(), every_text=True))


@query(
    "l09_over_collection",
    with_model("policy_texts", "dim_necessity", body=CLAIMS + COLLECTED + """SELECT site_purpose, category, doc_id FROM col JOIN (SELECT doc_id, site_purpose FROM policy_texts) p USING (doc_id)
    WHERE EXISTS (SELECT 1 FROM dim_necessity n WHERE n.purpose = site_purpose AND n.category = col.category AND n.verdict IN ('unnecessary', 'red_flag'))"""),
)
def l09(spark, sf):
    return L.over_collected(L.collected(_sents(spark, sf)), _docs(spark, sf), D.default_necessity(spark))


@query(
    "l10_site_profiles",
    _sql("""SELECT site, array_to_string(list_sort(list_distinct(list(clause))), ',') AS clauses, bool_or(clause = 'training_on_user_content') AS training_on_user_content, bool_or(clause = 'data_sale') AS data_sale,
    bool_or(clause = 'cross_border_transfer') AS international_transfer, CASE WHEN bool_or(clause = 'retention_after_deletion') THEN 'after_deletion' ELSE 'unspecified' END AS retention
    FROM best JOIN policy_texts USING (doc_id) GROUP BY site"""),
)
def l10(spark, sf):
    by_site = _clauses(spark, sf).join(_docs(spark, sf).select("doc_id", "site"), "doc_id")
    return L.merge_site_profiles(by_site).withColumn("clauses", F.array_join("clauses", ","))


@query(
    "l11_reading_time",
    with_model("policy_texts", body=r"""SELECT doc_id, words, CAST(ceil(words / 230.0) AS BIGINT) AS minutes FROM (SELECT doc_id, CASE WHEN trim(text) = '' THEN 0
    ELSE len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) END AS words FROM policy_texts) x"""),
)
def l11(spark, sf):
    return L.reading_time(_docs(spark, sf)).select("doc_id", "words", "minutes")


MATERIAL = [(r.name, r.material) for r in K.CLAUSES]


@query(
    "l12_clause_materiality",
    _sql(f"SELECT d.source, m.material, count(*) AS clauses, count(DISTINCT doc_id) AS docs FROM best b JOIN policy_texts d USING (doc_id) JOIN ({values_sql(MATERIAL, 'clause, material')}) m USING (clause) GROUP BY ALL"),
)
def l12(spark, sf):
    dim = F.broadcast(dimension(spark, MATERIAL, "clause, material"))
    b = _clauses(spark, sf).join(_docs(spark, sf).select("doc_id", "source"), "doc_id").join(dim, "clause")
    return b.groupBy("source", "material").agg(F.count("*").alias("clauses"), F.count_distinct("doc_id").alias("docs"))


@query(
    "l13_micro_f1",
    _sql("SELECT *, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM (SELECT count(CASE WHEN e AND o THEN 1 END) AS tp, count(CASE WHEN NOT e AND o THEN 1 END) AS fp, count(CASE WHEN e AND NOT o THEN 1 END) AS fn FROM (SELECT l.quality = 1 AS e, b.doc_id IS NOT NULL AS o FROM labels l LEFT JOIN (SELECT DISTINCT doc_id FROM best WHERE clause = 'data_sale') b USING (doc_id)) x) y"),
)
def l13(spark, sf):
    seen = _claims(spark, sf, ["data_sale"]).select("doc_id").distinct().withColumn("hit", F.lit(True))
    gold = read_table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("expected"))
    return L.micro_f1(gold.join(seen, "doc_id", "left").withColumn("observed", F.col("hit").isNotNull()))


@query(
    "l14_unacknowledged",
    with_model("policy_texts", body="SELECT doc_id, site FROM policy_texts p WHERE NOT EXISTS (SELECT 1 FROM policy_texts a WHERE a.doc_id % 2 = 0 AND a.site = p.site AND sha256(a.text) = sha256(p.text))"),
)
def l14(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "site", F.sha2("text", 256).alias("digest"))
    known = docs.where("doc_id % 2 = 0").select("site", "digest")
    return docs.join(known, ["site", "digest"], "left_anti").select("doc_id", "site")
