"""Policy reading, streams against their batch twins, and the overview figures."""

import uuid

import pytest
from pyspark.sql import functions as F

from privatrail.dims import policy as K
from privatrail.operators import decisions as D
from privatrail.operators import history as H
from privatrail.operators import policy as L
from privatrail.operators import store as S
from privatrail.sources.model import model
from privatrail.sources.tables import text_files
from privatrail.streaming import notices as N


def _docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_clauses(spark):
    docs = _docs(
        spark,
        "Your profile details can be disclosed to advertisers. What users post as content helps to train machine learning models. We can modify these terms at any time without notice.",
        "We never sell customer data. Plans do not renew automatically. We do not use uploaded content to train machine learning models.",
        "Sale\nWe may sell personal data. We may also sell information about you.",
    )
    got = {(r.doc_id, r.clause): r for r in L.best_clauses(L.clause_claims(L.sentences(docs))).collect()}
    assert {c for d, c in got if d == 0} >= {"third_party_sharing", "training_on_user_content"}
    assert {c for d, c in got if d == 1} == set()
    assert got[2, "data_sale"].confidence == 0.96 and got[2, "data_sale"].sentence == "We may sell personal data."


def test_guards_hold_whenever_their_patterns_match():
    import re

    def holds(guard, text):
        return all(any(w in text.lower() for w in group) for group in guard)

    said = [p for text in K.MODEL_PARAGRAPHS for p in (text, *text.split("; "))] + [
        "We may disclose details to a third-party.", "Data that is sold", "Licence to your work: royalty-free right", "uploads are used for training",
        "artificial intelligence may be developed from input by developing models", "after you close it we preserve your data",
        "closing an account does not remove backup data", "no right to a jury trial", "disputes go to arbitration",
        "we reserve the right to amend terms", "membership renews unless told", "we keep charging: continuing to be billed on a plan",
        "courts have exclusive jurisdiction under the laws", "a cap on liability", "damages shall not exceed the fee", "legal age by birth",
        "for any reason we suspend access", "international data transfers of content", "cross-border processes: we process data cross-border",
        "fulfilment of the order", "newsletters", "regulatory requirements", "analyse trends", "machine learning training", "advertising profiles",
    ]
    pairs = [(p, r.guard) for r in K.CLAUSES for p in r.positive]
    pairs += [(p, K.STATED_GUARDS[n]) for rules in (K.PURPOSES, K.RECIPIENTS) for n, p in rules.items()]
    pairs += [(K.PERIOD, K.PERIOD_GUARD), (K.UNTIL_DELETION, K.UNTIL_DELETION_GUARD), (K.SHARING_SENTENCE, K.SHARING_GUARD)]
    pairs += [(K.COLLECTION_VERB, K.COLLECTION_GUARD), (K.HANDLING_VERB, K.HANDLING_GUARD)]
    rules = {p: r.requires for r in K.CLAUSES for p in r.positive}
    met = {p for p, g in pairs for t in said if re.search(p, t, re.I) and re.search(rules.get(p, ""), t, re.I) and (holds(g, t) or pytest.fail(f"{p}: {t}"))}
    assert len(met) >= 30


def test_guards_fold_letters_as_the_patterns_do(spark):
    docs = _docs(spark, "We may ſell perſonal data.", "We may SELL PERSONAL DATA WİTH a thİrd party: we share dİsclosed data with affİliates.", "  ſhared with data broKers  ")
    sents = L.sentences(docs)
    assert {(r.doc_id, r.clause) for r in L.clause_claims(sents).collect()} >= {(0, "data_sale"), (1, "data_sale"), (1, "third_party_sharing")}
    one = {(r.doc_id, r.label, r.kind) for r in L.purposes_and_recipients(sents).collect()}
    apart = {(r.doc_id, r.label, "purpose") for r in L.used_purposes(sents, L.clause_claims(sents)).collect()}
    apart |= {(r.doc_id, r.label, "recipient") for r in L.stated_labels(L.sharing_sentences(sents), K.RECIPIENTS).collect()}
    assert one == apart and {(1, "affiliates", "recipient"), (2, "data_brokers", "recipient")} <= one


def test_lines_that_could_hold_no_clause_are_not_cut(spark, sf):
    docs = model(spark, sf, "policy_texts").select("doc_id", "text")
    odd = [";", "; but ;", ";;\nplain words", "We may ſell perſonal data. More. And more.\n;", "DATA İS SOLD; WE KEEP DATA 30 DAYS", "  ", None, "Sale\nData ıs sold.\nnothing here"]
    docs = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    whole, few = L.sentences(docs), L.sentences(docs, could=L.claim_guards())
    assert sorted(L.clause_claims(few).collect()) == sorted(L.clause_claims(whole).collect())
    assert few.count() < whole.count() / 4
    one = L.clause_claims(L.sentences(docs, could=L.claim_guards(["data_sale"])), clauses=["data_sale"])
    assert sorted(one.collect()) == sorted(L.clause_claims(whole).where("clause = 'data_sale'").collect())
    apart = {tuple(r) for r in L.retention(whole, L.clause_claims(whole)).collect()}
    kept = L.sentences(docs, could=L.retention_guards(), every_text=True)
    assert {tuple(r) for r in L.retention(kept).collect()} == apart and kept.count() < whole.count() / 4
    assert {r[0] for r in apart if r[0] < 0} == {-2, -3, -4, -5, -8}


def test_collection_and_labels(spark):
    docs = _docs(
        spark,
        "To plan a route we collect precise location.",
        "We never collect your passport. We record domain names.",
        "Information we collect\nYour date of birth and phone",
        "We use data such as the IP address.",
        "We do not share records with service providers. Usage is shared with analytics providers.",
    )
    s = L.sentences(docs)
    got = {}
    for r in L.collected(s).collect():
        got.setdefault(r.doc_id, set()).add(r.category)
    assert got[0] == {"location_precise"} and 1 not in got
    assert got[2] == {"dob", "phone"} and got[3] == {"device_identifiers"}
    shares = {(r.doc_id, r.label) for r in L.stated_labels(L.sharing_sentences(s), K.RECIPIENTS).collect()}
    assert shares == {(4, "analytics_providers")}


def test_stream_equals_batch(spark, sf, tmp_path):
    ev = D.notice_signature(model(spark, sf, "pevents")).withColumn("level", (F.col("k") + 1) % 3)
    ev = ev.withColumn("answered", F.col("event_id") % 3 != 0).select("event_id", "us", "session_id", "signature", "level", "answered", "requester_key")
    src = str(tmp_path / "events")
    ev.orderBy("us").coalesce(1).write.parquet(src)
    # one late marker event closes every open window of the stream
    end = ev.agg(F.max("us")).first()[0] + 30 * 86_400_000_000
    closing = ev.limit(1).withColumn("us", F.lit(end)).withColumn("session_id", F.lit("end")).withColumn("requester_key", F.lit("end"))
    schema = spark.read.parquet(src).schema

    def run(build, keep):
        name = "t" + uuid.uuid4().hex[:8]
        base = tmp_path / name
        spark.read.parquet(src).write.mode("append").parquet(str(base / "in"))
        for step in (None, closing):
            if step is not None:
                step.coalesce(1).write.mode("append").parquet(str(base / "in"))
            q = (
                build(N.read_events(spark, str(base / "in"), schema)).writeStream.format("parquet")
                .option("checkpointLocation", str(base / "cp")).outputMode("append").trigger(availableNow=True).start(str(base / "out"))
            )
            q.awaitTermination()
        return {tuple(r) for r in spark.read.parquet(str(base / "out")).where(keep).collect()}

    batch = N.with_event_time(spark.read.parquet(src))
    want = {tuple(r) for r in N.windowed_counts(batch).collect()}
    assert run(lambda s: N.windowed_counts(s, watermark="1 hour"), "requester_key <> 'end'") == want
    want = {tuple(r) for r in N.coalesced(batch).collect()}
    assert run(lambda s: N.coalesced(s, "1 hour"), "session_id <> 'end'") == want


def test_overview_counts_each_thing_once(spark):
    none = []
    ev = spark.createDataFrame(
        [(i, 10 + i, "tracking", "website", "news", ["ads", "pix"], True, None, "complete", None) for i in range(3)]
        + [(3, 20, "tracking", "website", "shop", ["ads"], False, None, "complete", None)]
        + [(4 + i, 30 + i, "permission_request", "application", "cam", none, False, "camera", "complete", None) for i in range(4)]
        + [(8, 40, "file_upload", "website", "shop", none, False, None, "complete", 2), (9, 41, "file_upload", "website", "shop", none, False, None, "aborted", 1)]
        + [(10, 50, "consent_banner", "website", "news", none, False, None, "complete", None), (11, 51, "consent_banner", "website", "news", none, False, None, "complete", None)],
        "event_id long, us long, event_type string, requester_kind string, requester_key string, tracker_domains array<string>, fingerprinting boolean, permission string, status string, file_count long",
    )
    dec = spark.createDataFrame([(8, 1, "INTERVENE", ""), (10, 1, "INFORM", "reject_optional")], "event_id long, seq int, outcome string, auto_action string")
    resp = spark.createDataFrame([(10, 1, "reject_optional"), (8, 1, "continue"), (8, 2, "cancel")], "event_id long, seq int, action string")
    cache = spark.createDataFrame([("policy", False, 2300, 0, 100), ("policy", True, 0, 0, 100), ("policy", False, 5, 0, 1)], "kind string, missing boolean, word_count long, created_us long, expires_us long")
    t = {r.metric: r.value for r in H.tally(ev, dec, cache, 50).collect()}
    want = dict(sites=2, apps=1, trackers=3, tracker_networks=2, tracked_sites=2, fingerprinting_sites=1, files=2, sensitive_files=1, policies=1, terms=0, document_words=2300, banners=2, banner_sites=1, grants=1, granted_apps=1)
    assert {k: t[k] for k in want} == want
    done = {r.action: (r.n, r.automatic) for r in H.decided_by_action(dec, resp).collect()}
    assert done == {"reject_optional": (1, 1), "cancel": (1, 0)}


def test_text_files_and_log(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo\nworld", encoding="utf-8")
    row = text_files(spark, str(tmp_path / "*.txt")).first()
    assert row.text == "héllo\nworld" and row.page == 1
    log = spark.createDataFrame([(1, 0), (2, 86_400_000_000)], "event_id long, us long")
    S.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).select("day").distinct().count() == 2


def _streamed(spark, tmp_path, parts, build, key):
    """Rows of a streaming query over Parquet parts that arrive one after the other."""
    base = tmp_path / ("t" + uuid.uuid4().hex[:8])
    rows = []
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(base / "in"))
        stream = spark.readStream.schema(part.schema).parquet(str(base / "in"))
        q = (
            build(stream).writeStream.format("parquet").option("checkpointLocation", str(base / "cp")).outputMode("append")
            .trigger(availableNow=True).start(str(base / "out"))
        )
        q.awaitTermination()
    rows = spark.read.parquet(str(base / "out")).collect()
    return {r[key]: tuple(r) for r in rows}


def test_decision_stream_equals_batch(spark, sf, tmp_path):
    from privatrail.operators import decisions as D
    from privatrail.operators import learning as G
    from privatrail.plans import QUERIES
    from privatrail.sources.model import model
    from privatrail.streaming import decisions as DS

    rules = G.active_rules(G.rule_state(model(spark, sf, "responses")))
    users = D.user_context(model(spark, sf, "users"), model(spark, sf, "pref_category"), rules)
    requesters = D.requester_context(model(spark, sf, "pref_expected"), model(spark, sf, "pref_override"), model(spark, sf, "clip_allowlist"))
    profiles, necessity = model(spark, sf, "profiles"), D.default_necessity(spark)
    events = model(spark, sf, "pevents")
    want = {r.event_id: tuple(r) for r in QUERIES["w01_decision_stream"](spark, sf).collect()}

    def build(stream):
        out = DS.decide(stream, necessity, profiles, users, requesters)
        return out.selectExpr("event_id", "round(risk, 6) AS risk", "outcome", "default_action", "auto_action", "urgency")

    assert _streamed(spark, tmp_path, [events], build, "event_id") == want


def test_session_end_takes_defaults(spark):
    pending = spark.createDataFrame([(1, 7, 100, "cancel"), (2, 7, 200, "block"), (3, 8, 50, "cancel")], "event_id long, session_id long, us long, default_action string")
    live = spark.createDataFrame([(7, 90, 300), (8, 40, 60)], "session_id long, opened_us long, last_us long")
    answers = spark.createDataFrame([(1, 150), (3, 999)], "event_id long, us long")
    got = {tuple(r) for r in N.ended(pending, live, answers, 100).collect()}
    assert got == {(2, "aborted", "block", 400), (3, "aborted", "cancel", 160)}
