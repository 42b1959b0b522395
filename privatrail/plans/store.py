from __future__ import annotations

from pyspark.sql import functions as F

from privatrail.operators import store as S
from privatrail.plans.history import ASOF
from privatrail.plans.registry import query
from privatrail.sources.model import model, with_model
from privatrail.sources.tables import documents, read_table

DAY = 86_400_000_000


@query(
    "s01_event_upsert",
    with_model("pevents", body="""SELECT event_id, us + CASE WHEN event_id % 6 = 0 THEN 5000000 ELSE 0 END AS us, event_type,
      requester_key, array_to_string(categories, ',') AS categories,
      CASE WHEN event_id % 6 = 0 AND event_id % 4 = 0 THEN k + 1 ELSE k END AS k, status FROM pevents"""),
)
def s01(spark, sf):
    first = model(spark, sf, "pevents").select(
        "event_id", "us", "event_type", "requester_key", "categories", "k", "status", F.lit(1).alias("seq")
    )
    again = first.where("event_id % 6 = 0").select(
        "event_id", (F.col("us") + 5_000_000).alias("us"), "event_type", "requester_key", "categories",
        F.when(F.col("event_id") % 4 == 0, F.col("k") + 1).otherwise(F.col("k")).alias("k"),
        F.lit("pending").alias("status"), F.lit(2).alias("seq"),
    )
    out = S.upsert_on_read(S.stored_events(first.unionByName(again)))
    return out.withColumn("categories", F.array_join("categories", ","))


@query(
    "s02_decisions_per_event",
    with_model("decision_log", body="""SELECT event_id, count(*) AS decisions, round(max(risk), 6) AS max_risk,
      max_by(outcome, seq) AS latest FROM decision_log GROUP BY event_id"""),
)
def s02(spark, sf):
    return model(spark, sf, "decision_log").groupBy("event_id").agg(
        F.count("*").alias("decisions"), F.round(F.max("risk"), 6).alias("max_risk"), F.max_by("outcome", "seq").alias("latest")
    )


@query(
    "s03_responses_per_event",
    with_model("responses", body="""SELECT event_id, count(*) AS responses, max_by(action, seq) AS latest,
      bool_or(remember) AS remembered FROM responses GROUP BY event_id"""),
)
def s03(spark, sf):
    return model(spark, sf, "responses").groupBy("event_id").agg(
        F.count("*").alias("responses"), F.max_by("action", "seq").alias("latest"), F.bool_or("remember").alias("remembered")
    )


@query(
    "s04_event_status",
    with_model("pevents", body="""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'aborted' WHEN event_id % 3 = 0 THEN 'pending'
      ELSE 'complete' END AS status FROM pevents"""),
)
def s04(spark, sf):
    """pending -> complete for two thirds; every fifth is aborted in between, where complete no longer counts."""
    ev = model(spark, sf, "pevents").select("event_id")
    steps = F.array_compact(
        F.array(
            F.struct(F.lit(1).alias("seq"), F.lit("pending").alias("transition")),
            F.when(F.col("event_id") % 5 == 0, F.struct(F.lit(2).alias("seq"), F.lit("aborted").alias("transition"))),
            F.when(F.col("event_id") % 3 != 0, F.struct(F.lit(3).alias("seq"), F.lit("complete").alias("transition"))),
        )
    )
    return S.fold_status(ev.select("event_id", F.inline(steps)))


@query(
    "s05_profile_lookup",
    with_model("pevents", body="""WITH p AS (SELECT requester_kind = 'website' AS site, requester_key, max_by(k, (us, event_id)) AS k,
      max(us) AS updated_us FROM pevents GROUP BY ALL)
      SELECT e.event_id, p.k AS profile_k, p.updated_us FROM pevents e LEFT JOIN p ON p.requester_key = e.requester_key AND p.site = (e.requester_kind = 'website')"""),
)
def s05(spark, sf):
    ev = model(spark, sf, "pevents").withColumn("kind", F.when(F.col("requester_kind") == "website", "site").otherwise("app"))
    puts = ev.groupBy("kind", "requester_key").agg(
        F.max_by("k", F.struct("us", "event_id")).alias("profile_k"), F.max("us").alias("updated_us")
    )
    return ev.select("event_id", "kind", "requester_key").join(puts, ["kind", "requester_key"], "left").select(
        "event_id", "profile_k", "updated_us"
    )


@query(
    "s06_uncached_documents",
    with_model("doc_cache", body=f"""WITH live AS (SELECT origin, sha256(text) AS digest FROM doc_cache WHERE doc_id % 2 = 0 AND expires_us > {ASOF})
      SELECT d.doc_id, d.origin, sha256(d.text) AS digest FROM doc_cache d
      WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.origin = d.origin AND l.digest = sha256(d.text))"""),
)
def s06(spark, sf):
    cache = model(spark, sf, "doc_cache")
    stored = cache.where("doc_id % 2 = 0").withColumn("digest", F.sha2("text", 256))
    return S.uncached(cache.select("doc_id", "origin", "text"), stored, ASOF).select("doc_id", "origin", "digest")


PURGE_ASOF = 1704067200000000 + 30 * DAY


@query(
    "s07_purge",
    with_model("pevents", "decision_log", "responses", body=f"""WITH kept AS (SELECT event_id FROM pevents WHERE us >= {PURGE_ASOF} - 10 * {DAY})
      SELECT 'events' AS log, count(*) AS n FROM kept
      UNION ALL SELECT 'decisions', count(*) FROM decision_log WHERE event_id IN (SELECT event_id FROM kept)
      UNION ALL SELECT 'responses', count(*) FROM responses WHERE event_id IN (SELECT event_id FROM kept)"""),
)
def s07(spark, sf):
    ev = model(spark, sf, "pevents")
    kept, decisions = S.purge(ev, model(spark, sf, "decision_log"), PURGE_ASOF, days=10)
    _, responses = S.purge(ev, model(spark, sf, "responses"), PURGE_ASOF, days=10)
    return S.diagnostics({"events": kept, "decisions": decisions, "responses": responses}).withColumnRenamed("table_name", "log")


@query(
    "s08_preferences_roundtrip",
    with_model("pref_category", body="SELECT user_id, category, preference FROM pref_category WHERE user_id % 5 <> 1"),
)
def s08(spark, sf):
    version = F.when(F.col("user_id") % 5 == 1, 2).otherwise(1)
    return S.import_preferences(S.export_preferences(model(spark, sf, "pref_category"), version))


@query(
    "s09_diagnostics",
    with_model("pevents", "decision_log", "responses", "doc_cache", "pref_category", body="""
      SELECT 'events' AS table_name, count(*) AS n FROM pevents UNION ALL SELECT 'decisions', count(*) FROM decision_log
      UNION ALL SELECT 'user_responses', count(*) FROM responses UNION ALL SELECT 'document_cache', count(*) FROM doc_cache
      UNION ALL SELECT 'preferences', count(*) FROM pref_category"""),
)
def s09(spark, sf):
    names = {"events": "pevents", "decisions": "decision_log", "user_responses": "responses", "document_cache": "doc_cache", "preferences": "pref_category"}
    return S.diagnostics({k: model(spark, sf, v) for k, v in names.items()})


@query(
    "s10_text_documents",
    "SELECT doc_id, 1 AS page, length(text) AS n, sha256(text) AS digest FROM documents",
)
def s10(spark, sf):
    return documents(spark, sf).select(
        "doc_id", F.lit(1).alias("page"), F.length("text").alias("n"), F.sha2("text", 256).alias("digest")
    )


@query(
    "s11_sampled_documents",
    """SELECT doc_id, length(text) > 2000 AS partial, sha256(CASE WHEN length(text) > 2000 THEN text[1:500] || chr(10) || right(text, 500) ELSE text END) AS digest
    FROM documents""",
)
def s11(spark, sf):
    out = S.sample_long(documents(spark, sf).select("doc_id", "text"), 2000, 500)
    return out.select("doc_id", "partial", F.sha2("text", 256).alias("digest"))


@query(
    "s12_validated_messages",
    with_model("pevents", body="""SELECT event_id, array_to_string(list_filter([
      CASE WHEN event_id % 17 = 0 THEN 'malformed' END,
      CASE WHEN event_id % 17 <> 0 AND event_id % 13 = 0 THEN 'unknown_key' END,
      CASE WHEN event_id % 17 <> 0 AND event_id % 11 = 0 THEN 'field_key' END,
      CASE WHEN event_id % 17 <> 0 AND event_id % 7 = 0 THEN 'event_type' END,
      CASE WHEN event_id % 17 <> 0 AND k > 90 THEN 'confidence' END,
      CASE WHEN event_id % 17 <> 0 AND k % 10 = 0 THEN 'file_count' END], lambda x: x IS NOT NULL), ',') AS reasons FROM pevents"""),
)
def s12(spark, sf):
    body = F.concat(
        F.lit('{"id":"'), F.col("event_id").cast("string"), F.lit('","event_type":"'),
        F.when(F.col("event_id") % 7 == 0, "guess").otherwise(F.col("event_type")),
        F.lit('","confidence":'), (F.col("k") / 90).cast("string"), F.lit(',"file_count":'), (F.col("k") % 10).cast("string"),
        F.when(F.col("event_id") % 13 == 0, ',"value":"4111"').otherwise(""),
        F.lit(',"field":{"label":"x"'), F.when(F.col("event_id") % 11 == 0, ',"default_value":"y"').otherwise(""), F.lit("}"),
        F.when(F.col("event_id") % 17 == 0, "").otherwise("}"),
    )
    raw = model(spark, sf, "pevents").select("event_id", body.alias("body"))
    return S.validate_messages(raw).select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "s13_tracker_list",
    """WITH h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS domain FROM pages),
    v AS (SELECT count(*) AS n, count(CASE WHEN NOT regexp_full_match(domain, '[a-z0-9.-]+') THEN 1 END) AS malformed FROM h)
    SELECT n, malformed, malformed = 0 AND n >= 10 AS ok, CASE WHEN malformed > 0 THEN 'malformed' WHEN n < 10 THEN 'too_short' ELSE '' END AS reason FROM v""",
)
def s13(spark, sf):
    from privatrail.functions.urls import host_of

    listed = read_table(spark, sf, "pages").select(host_of(F.col("url")).alias("domain"))
    return S.checked_trackers(listed, low=10)


@query(
    "s15_html_text",
    r"""SELECT page_id, length(t) AS n, sha256(t) AS digest FROM (
      SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
        '(?is)<script[\s\S]*?</script>', ' ', 'g'), '(?is)<style[\s\S]*?</style>', ' ', 'g'),
        '(?is)<noscript[\s\S]*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g') AS t FROM pages) x""",
)
def s15(spark, sf):
    out = S.public_text(read_table(spark, sf, "pages"))
    return out.select("page_id", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))


@query(
    "s16_extension_manifests",
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN ['history', 'tabs'] WHEN 1 THEN ['storage'] WHEN 2 THEN ['clipboardRead', 'webRequest', 'tabs', 'history']
        WHEN 3 THEN ['alarms', 'tabs'] ELSE ['history'] END AS p, CASE WHEN p_partkey % 3 = 0 THEN ['<all_urls>'] ELSE [] END AS h FROM part),
    a AS (SELECT p_partkey, list_sort(list_filter(list_concat(p, h), lambda x: x IN ('history', 'tabs', '<all_urls>', 'webRequest', 'clipboardRead'))) AS acc FROM p)
    SELECT 'ext' || p_partkey AS bundle_id, array_to_string(acc, ',') AS accesses, round(least(1.0, len(acc) / 3.0), 6) AS breadth,
      array_to_string(list_filter([CASE WHEN list_contains(acc, 'history') THEN 'browser_history' END, CASE WHEN list_contains(acc, 'clipboardRead') THEN 'clipboard' END,
       CASE WHEN list_has_any(acc, ['tabs', 'webRequest', '<all_urls>']) THEN 'browsing_activity' END], lambda x: x IS NOT NULL), ',') AS categories
    FROM a WHERE len(acc) > 0""",
)
def s16(spark, sf):
    from privatrail.operators.access import extension_access

    n = F.col("p_partkey")
    perms = (
        F.when(n % 5 == 0, '["history","tabs"]').when(n % 5 == 1, '["storage"]')
        .when(n % 5 == 2, '["clipboardRead","webRequest","tabs","history"]').when(n % 5 == 3, '["alarms","tabs"]').otherwise('["history"]')
    )
    hosts = F.when(n % 3 == 0, '["<all_urls>"]').otherwise("[]")
    doc = F.concat(F.lit('{"name":"x","permissions":'), perms, F.lit(',"host_permissions":'), hosts, F.lit("}"))
    raw = read_table(spark, sf, "part").select(F.concat(F.lit("ext"), n.cast("string")).alias("bundle_id"), doc.alias("manifest"))
    return extension_access(raw).select(
        "bundle_id", F.array_join("accesses", ",").alias("accesses"), F.round("breadth", 6).alias("breadth"), F.array_join("categories", ",").alias("categories")
    )


@query(
    "s17_reassembled_uploads",
    with_model("upload_chunks", body="""WITH s AS (SELECT upload_id, CAST(max(parts * 5 + size_error) AS BIGINT) AS nominal FROM upload_chunks GROUP BY upload_id),
    p AS (SELECT a.upload_id, max(b.us - a.us) AS pause FROM upload_chunks a JOIN upload_chunks b ON a.upload_id = b.upload_id AND b.seq = a.seq + 1 GROUP BY a.upload_id),
    g AS (SELECT upload_id, count(*) = max(seq) + 1 AS contiguous, sum(length(data)) AS received, coalesce((SELECT pause FROM p WHERE p.upload_id = c.upload_id), 0) <= 120000000 AS in_time,
      string_agg(data, '' ORDER BY seq) AS content, CAST(max(size_error) + sum(length(data)) AS BIGINT) AS size FROM upload_chunks c GROUP BY upload_id)
    SELECT upload_id, CASE WHEN contiguous AND received = size AND in_time THEN 'complete' ELSE 'aborted' END AS status,
      CASE WHEN contiguous AND received = size AND in_time THEN content END AS content FROM g"""),
)
def s17(spark, sf):
    chunks = model(spark, sf, "upload_chunks")
    sizes = chunks.groupBy("upload_id").agg((F.max("size_error") + F.sum(F.length("data"))).alias("size"))
    return S.reassemble_uploads(chunks.select("upload_id", "us", "seq", "data"), sizes)


@query(
    "p22_public_identity",
    r"""WITH u AS (SELECT page_id AS id, url AS value FROM pages UNION ALL
      SELECT 100000 + c_custkey, CASE c_custkey % 4 WHEN 0 THEN '/Users/U' || c_custkey || '/Tool' WHEN 1 THEN 'C:\Apps\T' || c_custkey
      WHEN 2 THEN 'https://user@Host' || c_custkey || '.example:8443/p?q=1' ELSE 'com.vendor.App' || c_custkey END FROM customer)
    SELECT id, CASE WHEN regexp_matches(value, '^(/|\\\\|[A-Za-z]:[\\/])') THEN 'app:' || left(sha256(lower(replace(value, '\', '/'))), 24)
      WHEN regexp_matches(value, '^https?://') THEN regexp_extract(value, '^(https?)://', 1) || '://' || lower(regexp_extract(value, '^https?://(?:[^/?#@]*@)?([^/?#:]*)', 1))
        || regexp_extract(value, '^https?://(?:[^/?#@]*@)?[^/?#:]*(:[0-9]+)', 1) ELSE value END AS identity FROM u""",
)
def p22(spark, sf):
    from privatrail.functions.urls import public_identity

    n = F.col("c_custkey")
    s = n.cast("string")
    value = (
        F.when(n % 4 == 0, F.concat(F.lit("/Users/U"), s, F.lit("/Tool"))).when(n % 4 == 1, F.concat(F.lit("C:\\Apps\\T"), s))
        .when(n % 4 == 2, F.concat(F.lit("https://user@Host"), s, F.lit(".example:8443/p?q=1"))).otherwise(F.concat(F.lit("com.vendor.App"), s))
    )
    other = read_table(spark, sf, "customer").select((n + 100000).alias("id"), value.alias("value"))
    both = read_table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("value")).unionByName(other)
    return both.select("id", public_identity(F.col("value"), S.redact_for_store(F.col("value"))).alias("identity"))


@query(
    "s05_history_profiles",
    with_model("pevents", "profiles", body="SELECT p.requester_key, p.retention, count(*) AS events FROM profiles p JOIN pevents e USING (requester_key) GROUP BY ALL"),
)
def s05_profiles(spark, sf):
    return model(spark, sf, "profiles").select("requester_key", "retention").join(
        model(spark, sf, "pevents").groupBy("requester_key").agg(F.count("*").alias("events")), "requester_key"
    )


