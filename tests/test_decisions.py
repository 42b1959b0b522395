"""Scenario outcomes, form judgements and monotonicity of the level rules."""

from pyspark.sql import functions as F

from privatrail.dims.categories import CATEGORIES, necessity_rows, purposes
from privatrail.operators import forms as O
from privatrail.plans.decisions import judged, scenario_outcomes
from privatrail.sources.model import model


def test_scenarios(spark):
    got = {(r.purpose, r.category): (r.verdict, r.outcome) for r in scenario_outcomes(spark).collect()}
    assert len(got) == 64
    assert got["image_tool", "government_id.passport"] == ("red_flag", "INTERVENE")
    assert got["banking", "government_id.passport"] == ("required", "IGNORE")
    assert got["banking", "location_precise"] == ("unnecessary", "INFORM")
    assert got["recipe", "email"] == ("reasonable", "IGNORE")
    assert got["saas_b2b", "credentials.password"] == ("reasonable", "INFORM")
    assert got["backup", "phone"] == ("unnecessary", "INFORM")


def test_matrix_is_complete():
    rows = necessity_rows()
    assert len(purposes()) == 46 and len(CATEGORIES) == 48
    assert len({(p, c) for p, c, _ in rows}) == 46 * 48


FIELD = "form_id long, site_purpose string, field_id string, label string, name string, input_type string, autocomplete string, required boolean, asserted_required boolean, filled boolean, max_length int"


def fields(spark, forms):
    rows = []
    for form_id, (purpose, items) in enumerate(forms):
        for i, (label, kind, auto, required, filled) in enumerate(items):
            rows.append((form_id, purpose, f"f{i}", label, "", kind, auto, required, False, filled, 0))
    return spark.createDataFrame(rows, FIELD)


def test_form_cases(spark):
    forms = [
        ("social", [("Telephone or E-mail", "text", "", True, False), ("Full Name", "text", "", True, False), ("Username", "text", "", True, False), ("Password", "password", "new-password", True, False)]),
        ("image_tool", [("Passport number", "text", "", True, False)]),
        ("banking", [("Social Security Number", "text", "", True, False), ("Date of birth", "text", "bday", True, False), ("Home address", "text", "street-address", True, False)]),
        ("free_download", [("n", "text", "name", False, True), ("e", "email", "", False, True), ("p", "text", "tel", False, True), ("d", "text", "bday", False, True), ("a", "text", "street-address", False, True)]),
        ("ecommerce", [("Card number", "text", "cc-number", True, False), ("Billing address", "text", "billing street-address", True, False), ("Phone number", "text", "tel", True, False)]),
        ("unknown", [("Reference", "text", "", True, False), ("Code", "text", "", True, False)]),
    ]
    rows = O.assess_forms(fields(spark, forms)).collect()
    flagged = {i: {r.category for r in rows if r.form_id == i and r.flag} for i in range(len(forms))}
    intents = {r.form_id: r.intent for r in rows}
    assert intents[0] == "account_signup" and flagged[0] == set()
    assert {r.role for r in rows if r.form_id == 0 and r.field_id == "f0"} == {"alternate_identifier"}
    assert flagged[1] == {"government_id.passport"}
    assert flagged[2] == set()
    assert flagged[3] == {"phone", "dob", "postal_address"}
    assert intents[4] == "checkout_payment" and flagged[4] == set()
    assert intents[5] == "unknown" and flagged[5] == set()


def test_field_labels(spark):
    cases = [
        ("Date de naissance", "dob"), ("Reisepassnummer", "government_id.passport"), ("Email address", "email"),
        ("Home address", "postal_address"), ("Which animal did you keep as a child?", None), ("Dirección postal", "postal_address"),
    ]
    df = fields(spark, [("unknown", [(c, "text", "", False, False) for c, _ in cases])])
    got = {r.label: r.category for r in O.label_fields(df).collect()}
    assert got == dict(cases)


def test_evidence_sums_to_its_softmax(spark, sf):
    df = O.classify_forms(O.describe(O.label_fields(model(spark, sf, "form_fields"))))
    bad = df.where(~F.col("intent_confidence").between(0, 1) | (F.size("scores") != 15)).count()
    assert bad == 0


def test_worst_verdicts_and_remedies(spark):
    items = [
        ("Phone", "text", "tel", False, True), ("Date of birth", "date", "bday", False, True),
        ("Home address", "text", "street-address", True, True), ("Email", "email", "", True, True), ("Full name", "text", "name", False, True),
    ]
    judged = O.assess_forms(fields(spark, [("free_download", items)]))
    worst = {r.category: r.verdict for r in O.worst_verdicts(judged).collect()}
    assert worst["phone"] == "unnecessary" and worst["email"] == "required" and worst["full_name"] == "reasonable"
    got = {r.field_id: (r.can_clear, r.can_redact) for r in O.remedies(judged).collect()}
    assert got == {"f0": (True, True), "f1": (True, False), "f2": (False, True)}


def test_a_form_carries_the_categories_of_its_fields(spark, sf):
    asked = model(spark, sf, "form_fields")
    labels = {}
    for r in O.label_fields(asked).where("category IS NOT NULL").select("form_id", "category", "filled").collect():
        labels.setdefault(r.form_id, []).append((r.category, r.filled))
    own = {r.event_id: (r.event_type, r.categories) for r in model(spark, sf, "pevents").select("event_id", "event_type", "categories").collect()}
    got = {r.event_id: r.categories for r in judged(spark, sf, O.form_context(O.assess_forms(asked)).withColumnRenamed("form_id", "event_id")).select("event_id", "categories").collect()}
    more = 0
    for event, (kind, categories) in own.items():
        if event in labels and kind in ("form_submit", "form_observed"):
            added = {c for c, filled in labels[event] if filled or kind == "form_observed"}
            assert got[event] == sorted(added | set(categories))
            more += not added <= set(categories)
        else:
            assert got[event] == categories
    assert more > 20 and len(got) == len(own)


def test_kept_events_carry_no_lists_that_only_judging_needs(spark, sf):
    from privatrail.plans import decisions as plan

    j = plan.kept(plan.judged(spark, sf))
    assert not {"verdicts", "prefs", "rules", "judged"} & set(j.columns)
    assert {"n_cats", "scored_risk", "any_unneeded", "red_flags", "minimum"} <= set(j.columns)
