from __future__ import annotations

from pyspark.sql import functions as F

from privatrail.dims import dimension, values_sql
from privatrail.dims import web as W
from privatrail.dims.categories import purposes
from privatrail.operators import access as A
from privatrail.operators import consent as C
from privatrail.operators import domains as D
from privatrail.operators import tracking as T
from privatrail.plans.registry import query
from privatrail.sources.model import model, with_model
from privatrail.sources.tables import read_table


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(items) -> str:
    return "(" + ", ".join(_q(i) for i in items) + ")"


def _list(items) -> str:
    return "[" + ", ".join(_q(i) for i in items) + "]"


def _trackers(spark):
    return dimension(spark, [(d,) for d in W.MODEL_TRACKERS], "domain")


def _sites(spark):
    return dimension(spark, W.MODEL_SITES, "domain, purpose")


COMPOUND = _in(
    ["co.uk", "org.uk", "co.jp", "co.kr", "co.nz", "co.za", "co.in", "com.au", "net.au", "com.br", "com.mx", "com.sg", "com.tr"]
)
# hosts of the request log, and the owner of each by the longest listed suffix
HOSTS = f"""
WITH rh AS (SELECT DISTINCT site, host FROM (SELECT site, host FROM requests UNION ALL SELECT site, cname FROM requests
  UNION ALL SELECT site, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) FROM requests) x WHERE host IS NOT NULL AND host <> ''),
owned AS (SELECT host, max_by(domain, length(domain)) AS domain FROM (SELECT DISTINCT host FROM (SELECT host FROM rh UNION ALL SELECT ltrim(lower(domain), '.') FROM cookies) a) h
  JOIN dim_tracker d ON h.host = d.domain OR h.host LIKE '%.' || d.domain GROUP BY host),
owner AS (SELECT h.host, o.domain IS NOT NULL AS is_tracker, coalesce(o.domain, CASE WHEN list_aggregate(string_split(h.host, '.')[-2:], 'string_agg', '.') IN {COMPOUND}
    THEN list_aggregate(string_split(h.host, '.')[-3:], 'string_agg', '.') ELSE list_aggregate(string_split(h.host, '.')[-2:], 'string_agg', '.') END) AS owner
  FROM (SELECT DISTINCT host FROM (SELECT host FROM rh UNION ALL SELECT ltrim(lower(domain), '.') FROM cookies) a) h LEFT JOIN owned o USING (host)),
pix AS (SELECT site, lower(host) AS host FROM requests GROUP BY site, host HAVING bool_or(is_pixel) AND bool_or(
    lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) = lower(host) AND (contains(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), 'pixel')
    OR regexp_matches('&' || regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&(uid|id|cid|email_hash)=[^&]')))
  AND host <> substr(site, 9) AND NOT ends_with(host, '.' || substr(site, 9))),
lasting AS (SELECT DISTINCT site, ltrim(lower(domain), '.') AS host FROM cookies WHERE third_party AND lifetime_days >= 30),
lastingt AS (SELECT l.site, l.host, o.owner FROM lasting l JOIN owner o ON o.host = l.host AND o.is_tracker),
known AS (SELECT r.site, r.host, o.owner FROM rh r JOIN owner o ON o.host = r.host AND o.is_tracker),
urlsig AS (SELECT site, bool_or(regexp_matches('&' || regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&({"|".join(W.DECORATION_KEYS)})=[^&]')) AS url_decoration,
  bool_or(regexp_matches(url, '(?i)(?:match|sync|identify).{{0,30}}(?:hash|email|uid)|(?:email_hash|hashed_email)=')) AS identity_linking,
  count(CASE WHEN is_pixel THEN 1 END) AS pixel_beacons FROM requests GROUP BY site),
fp AS (SELECT site, bool_or(call IN {_in(W.CANVAS_READ)}) AND bool_or(call IN {_in(W.CANVAS_WRITE)}) AS canvas,
  bool_or(call IN {_in(W.AUDIO_CONTEXT)}) AND bool_or(call IN {_in(W.AUDIO_READ)}) AS audio,
  count(DISTINCT CASE WHEN call IN {_in(W.ENUMERATION)} THEN call END) >= 3 AS enumeration FROM api_calls GROUP BY site),
shared AS (SELECT origin, count(*) AS shared FROM (SELECT DISTINCT origin, hash FROM storage_ids) s
  WHERE hash IN (SELECT hash FROM storage_ids GROUP BY hash HAVING count(DISTINCT origin) > 1) GROUP BY origin),
cloak AS (SELECT DISTINCT site FROM requests r JOIN owner o ON o.host = lower(r.cname) AND o.is_tracker)
"""
NEED = ("requests", "cookies", "api_calls", "storage_ids", "dim_tracker")


def _sql(body: str) -> str:
    return with_model(*NEED, body=HOSTS + body)


def _req(spark, sf):
    return model(spark, sf, "requests")


@query("d01_tracker_membership", _sql("SELECT o.host, o.is_tracker FROM owner o JOIN (SELECT DISTINCT host FROM requests) r ON r.host = o.host"))
def d01(spark, sf):
    return D.tracker_hosts(_req(spark, sf), _trackers(spark)).select("host", "is_tracker")


@query("d02_owning_domain", _sql("SELECT o.host, o.owner FROM owner o JOIN (SELECT DISTINCT host FROM requests) r ON r.host = o.host"))
def d02(spark, sf):
    return D.tracker_hosts(_req(spark, sf), _trackers(spark)).select("host", "owner")


SITES = f"""WITH sites AS ({values_sql(W.MODEL_SITES, "domain, purpose")}),
hosts AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host FROM pages UNION SELECT DISTINCT host FROM requests),
best AS (SELECT host, max_by(domain, length(domain)) AS domain FROM hosts h JOIN sites s
  ON (h.host = s.domain OR h.host LIKE '%.' || s.domain) AND (contains(s.domain, '.') OR NOT contains(h.host, '.')) GROUP BY host)
"""


@query("d03_curated_purpose", with_model("requests", body=SITES + "SELECT b.host, b.domain, s.purpose FROM best b JOIN sites s USING (domain)"))
def d03(spark, sf):
    from privatrail.functions.urls import host_of

    hosts = read_table(spark, sf, "pages").select(host_of(F.col("url")).alias("host")).unionByName(_req(spark, sf).select("host"))
    return D.curated_purpose(hosts, _sites(spark)).select("host", "domain", "purpose")


VOTES = ", ".join(
    "{'n': len(regexp_extract_all(t, '(?i)" + p.replace("'", "''") + f"')), 'p': '{name}'}}" for name, p in W.PURPOSE_KEYWORDS.items()
)
WORDS = f"""
voted AS (SELECT *, list_max([{VOTES}]) AS best, list_filter({_list(purposes())}, lambda p: contains(t, replace(p, '_', ' ')))[1] AS named
  FROM (SELECT *, lower(signal_text || ' ' || host) AS t FROM site_signals) x),
words AS (SELECT *, CASE WHEN best.n > 0 THEN best.p ELSE coalesce(named, 'unknown') END AS w_purpose,
  CASE WHEN best.n > 0 THEN least(0.9, 0.65 + 0.08 * best.n) WHEN named IS NOT NULL THEN 0.65 ELSE 0.0 END AS w_conf,
  CASE WHEN best.n > 0 THEN 'local_signals' WHEN named IS NOT NULL THEN 'category_metadata' ELSE 'insufficient_signals' END AS w_source FROM voted)
"""


@query("d04_keyword_purpose", with_model("site_signals", body="WITH " + WORDS + "SELECT event_id, w_purpose AS purpose, round(w_conf, 6) AS confidence FROM words WHERE w_source = 'local_signals'"))
def d04(spark, sf):
    no_sites = _sites(spark).where("false")
    out = D.infer_purpose(model(spark, sf, "site_signals"), no_sites).withColumnRenamed("inferred", "p").where("p.source = 'local_signals'")
    return out.select("event_id", "p.purpose", F.round("p.confidence", 6).alias("confidence"))


PAGE_SIGNALS = r"""ps AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1) AS host, regexp_replace(
    regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || ' ' || regexp_extract(html, '(?is)<meta[^>]*name=.description.[^>]*content=.([^"''>]*)', 1) || ' '
    || array_to_string(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), ' '), '<[^>]*>', ' ', 'g') AS signal_text FROM pages),
"""


@query(
    "d04_page_purposes",
    "WITH " + PAGE_SIGNALS + WORDS.replace("FROM site_signals", "FROM ps").lstrip() + "SELECT page_id, w_purpose AS purpose, round(w_conf, 6) AS confidence, w_source AS source FROM words",
)
def d04_pages(spark, sf):
    """Purposes of the given pages by their titles and headings."""
    pages = D.page_signals(read_table(spark, sf, "pages"))
    out = D.infer_purpose(pages.select("page_id", "host", "signal_text"), _sites(spark).where("false")).withColumnRenamed("inferred", "p")
    return out.select("page_id", "p.purpose", F.round("p.confidence", 6).alias("confidence"), "p.source")


@query("d05_purpose_fallback", with_model("site_signals", body="WITH " + WORDS + "SELECT event_id, w_purpose AS purpose, round(w_conf, 6) AS confidence, w_source AS source FROM words WHERE w_source <> 'local_signals'"))
def d05(spark, sf):
    no_sites = _sites(spark).where("false")
    out = D.infer_purpose(model(spark, sf, "site_signals"), no_sites).withColumnRenamed("inferred", "p").where("p.source <> 'local_signals'")
    return out.select("event_id", "p.purpose", F.round("p.confidence", 6).alias("confidence"), "p.source")


@query(
    "d06_enriched_requesters",
    with_model("site_signals", body=f"""WITH sites AS ({values_sql(W.MODEL_SITES, "domain, purpose")}),
    cur AS (SELECT host, max_by(s.purpose, length(s.domain)) AS c_purpose FROM (SELECT DISTINCT host FROM site_signals) h JOIN sites s
      ON h.host = s.domain OR h.host LIKE '%.' || s.domain GROUP BY host), {WORDS}
    SELECT event_id, CASE WHEN purpose <> 'unknown' AND purpose_confidence > 0 THEN purpose ELSE coalesce(c_purpose, w_purpose) END AS purpose,
      round(CASE WHEN purpose <> 'unknown' AND purpose_confidence > 0 THEN purpose_confidence WHEN c_purpose IS NOT NULL THEN 0.95 ELSE w_conf END, 6) AS purpose_confidence
    FROM words LEFT JOIN cur USING (host)"""),
)
def d06(spark, sf):
    out = D.enrich_requesters(model(spark, sf, "site_signals"), _sites(spark))
    return out.select("event_id", "purpose", F.round("purpose_confidence", 6).alias("purpose_confidence"))


FACING = _in([W.SYSTEM_BUNDLE_PREFIX + n for n in W.USER_FACING_BUNDLES])


@query(
    "d07_system_components",
    f"""WITH c AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'com.apple.Safari' WHEN 1 THEN 'com.apple.agent' || c_custkey WHEN 2 THEN 'com.vendor.app'
        WHEN 3 THEN 'Microsoft.Windows.Shell' ELSE '' END AS b, CASE c_custkey % 5 WHEN 0 THEN '/usr/bin/tool' WHEN 1 THEN 'C:\\Windows\\x.exe' WHEN 2 THEN '/home/u/app' ELSE '' END AS p FROM customer)
    SELECT c_custkey AS id, CASE WHEN starts_with(lower(b), 'com.apple.') THEN lower(b) NOT IN {FACING}
      ELSE {" OR ".join(f"starts_with(lower(b), {_q(x)})" for x in W.SYSTEM_IDENTITIES)} OR {" OR ".join(f"starts_with(replace(lower(p), chr(92), '/'), {_q(x)})" for x in W.SYSTEM_PATHS)} END AS is_system FROM c""",
)
def d07(spark, sf):
    n = F.col("c_custkey")
    b = F.when(n % 7 == 0, "com.apple.Safari").when(n % 7 == 1, F.concat(F.lit("com.apple.agent"), n.cast("string"))).when(n % 7 == 2, "com.vendor.app").when(n % 7 == 3, "Microsoft.Windows.Shell").otherwise("")
    p = F.when(n % 5 == 0, "/usr/bin/tool").when(n % 5 == 1, "C:\\Windows\\x.exe").when(n % 5 == 2, "/home/u/app").otherwise("")
    return read_table(spark, sf, "customer").select(n.alias("id"), A.is_system_component(b, p).alias("is_system"))


# ---- tracking -----------------------------------------------------------------------------
@query(
    "t01_snapshots",
    _sql("""SELECT site, 'host' AS kind, host AS value, min(event_id) AS first_id FROM requests GROUP BY site, host
    UNION ALL SELECT site, 'url', url, min(event_id) FROM requests GROUP BY site, url"""),
)
def t01(spark, sf):
    r = _req(spark, sf)
    hosts = T.snapshot_hosts(r).select("site", F.lit("host").alias("kind"), F.col("host").alias("value"), "first_id")
    return hosts.unionByName(T.snapshot_urls(r).select("site", F.lit("url").alias("kind"), F.col("url").alias("value"), "first_id"))


@query("t02_known_trackers", _sql("SELECT site, host, owner FROM known"))
def t02(spark, sf):
    return T.known_trackers(_req(spark, sf), _trackers(spark))


@query("t03_tracking_pixels", _sql("SELECT site, host FROM pix"))
def t03(spark, sf):
    return T.tracking_pixels(_req(spark, sf))


@query("t04_persistent_cookies", _sql("SELECT site, host, owner FROM lastingt"))
def t04(spark, sf):
    return T.persistent_cookies(model(spark, sf, "cookies"), _trackers(spark))


@query("t05_url_decoration", _sql("SELECT site, url_decoration FROM urlsig"))
def t05(spark, sf):
    return T.url_signals(_req(spark, sf)).select("site", "url_decoration")


@query("t06_fingerprinting", _sql("SELECT site, canvas, audio, enumeration, canvas OR audio OR enumeration AS fingerprinting FROM fp"))
def t06(spark, sf):
    return T.fingerprinting(model(spark, sf, "api_calls"))


@query("t07_shared_storage", _sql("SELECT origin, shared FROM shared"))
def t07(spark, sf):
    return T.shared_storage(model(spark, sf, "storage_ids"))


@query("t08_cname_cloaking", _sql("SELECT site FROM cloak"))
def t08(spark, sf):
    return T.cname_cloaking(_req(spark, sf), _trackers(spark))


@query("t09_pixel_beacons", _sql("SELECT u.site, u.pixel_beacons, u.pixel_beacons > 0 AND k.site IS NOT NULL AS tracking_pixels FROM urlsig u LEFT JOIN (SELECT DISTINCT site FROM known) k USING (site)"))
def t09(spark, sf):
    r = _req(spark, sf)
    known = T.known_trackers(r, _trackers(spark)).select("site").distinct().withColumn("hit", F.lit(True))
    out = T.url_signals(r).join(known, "site", "left")
    return out.select("site", "pixel_beacons", ((F.col("pixel_beacons") > 0) & F.col("hit").isNotNull()).alias("tracking_pixels"))


@query("t10_identity_linking", _sql("SELECT site, identity_linking FROM urlsig"))
def t10(spark, sf):
    return T.url_signals(_req(spark, sf)).select("site", "identity_linking")


@query(
    "t11_tracking_analysis",
    _sql("""SELECT site, n > 0 AS detected, array_to_string(s, ',') AS signals, coalesce(td, '') AS tracker_domains, fingerprinting,
      round(CASE WHEN n > 0 THEN least(0.99, 0.35 + n * 0.12 + least(nh, 4) * 0.05) ELSE 0 END, 6) AS confidence FROM (
      SELECT *, len(s) AS n FROM (SELECT a.site, coalesce(h.n, 0) AS nh, h.td, coalesce(f.canvas OR f.audio OR f.enumeration, FALSE) AS fingerprinting,
        list_filter([CASE WHEN l.site IS NOT NULL THEN 'persistent_third_party_cookies' END, CASE WHEN h.n > 0 THEN 'known_tracker_requests' END,
          CASE WHEN u.url_decoration THEN 'url_decoration' END, CASE WHEN f.canvas OR f.audio OR f.enumeration THEN 'fingerprinting' END,
          CASE WHEN sh.shared > 0 THEN 'cross_origin_storage_identifier' END, CASE WHEN c.site IS NOT NULL THEN 'cname_cloaking' END,
          CASE WHEN u.pixel_beacons > 0 AND h.n > 0 THEN 'tracking_pixels' END, CASE WHEN u.identity_linking THEN 'identity_linking' END], lambda x: x IS NOT NULL) AS s
      FROM (SELECT site FROM requests UNION SELECT site FROM cookies UNION SELECT site FROM api_calls UNION SELECT origin FROM storage_ids) a
      LEFT JOIN (SELECT site, count(*) AS n, array_to_string(list_sort(list_distinct(list(owner))), ',') AS td FROM (
        SELECT * FROM known UNION SELECT p.site, p.host, o.owner FROM pix p JOIN owner o ON o.host = p.host UNION SELECT * FROM lastingt) x GROUP BY site) h ON h.site = a.site
      LEFT JOIN (SELECT DISTINCT site FROM lastingt) l ON l.site = a.site LEFT JOIN urlsig u ON u.site = a.site LEFT JOIN fp f ON f.site = a.site
      LEFT JOIN shared sh ON sh.origin = a.site LEFT JOIN cloak c ON c.site = a.site) y) z"""),
)
def t11(spark, sf):
    out = T.analyze_tracking(
        _req(spark, sf), model(spark, sf, "cookies"), model(spark, sf, "api_calls"), model(spark, sf, "storage_ids"), _trackers(spark)
    )
    return out.select(
        "site", "detected", F.array_join("signals", ",").alias("signals"), F.array_join("tracker_domains", ",").alias("tracker_domains"),
        "fingerprinting", F.round("confidence", 6).alias("confidence"),
    )


# ---- consent ------------------------------------------------------------------------------
CMP = "CASE " + " ".join(f"WHEN list_has_any(selectors, {_list(sel)}) THEN '{n}'" for n, sel in W.CMP_SELECTORS) + " ELSE lower(cmp) END"
FOLD = lambda x: "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({x}, '(?i){p}') THEN '{n}' END" for n, p in W.CONSENT_PURPOSES.items()) + "], lambda z: z IS NOT NULL)"
ACC = f"visible AND (role = 'accept' OR regexp_matches(text, '(?i){W.ACCEPT_WORDS}'))"
REJ = f"visible AND layer = 1 AND (role = 'reject' OR regexp_matches(text, '(?i){W.REJECT_WORDS}'))"
CONSENT = f"""
WITH bt AS (SELECT banner_id, count(*) AS nb, min_by(area, ord) FILTER ({ACC}) AS aa, min_by(contrast, ord) FILTER ({ACC}) AS ac,
    min_by(area, ord) FILTER ({REJ}) AS ra, min_by(contrast, ord) FILTER ({REJ}) AS rc FROM banner_buttons GROUP BY banner_id),
tg AS (SELECT banner_id, list_distinct(flatten(list(CASE WHEN len({FOLD("purpose")}) > 0 THEN {FOLD("purpose")} ELSE [purpose] END))) AS tp,
    bool_or(optional AND enabled AND NOT legitimate_interest) AS pre, bool_or(legitimate_interest AND enabled) AS leg FROM banner_toggles GROUP BY banner_id),
tc AS (SELECT banner_id, list_distinct(list(d.purpose)) AS cp, bool_or(enabled AND purpose_id <> '1') AS cpre FROM banner_tcf JOIN ({values_sql(W.TCF_PURPOSES, "purpose_id, purpose")}) d USING (purpose_id) GROUP BY banner_id),
j AS (SELECT b.*, {CMP} AS platform, bt.*, tg.tp, tg.pre, tg.leg, tc.cp, tc.cpre FROM banners b LEFT JOIN bt ON bt.banner_id = b.banner_id
   LEFT JOIN tg ON tg.banner_id = b.banner_id LEFT JOIN tc ON tc.banner_id = b.banner_id),
c AS (SELECT *, platform IN {_in([n for n, _ in W.CMP_SELECTORS])} OR tcf_present OR (fixed_or_sticky AND coalesce(nb, 0) > 0 AND regexp_matches(text, '(?i){W.COOKIE_WORDS}')) AS detected,
  list_sort(list_distinct(list_concat(list_concat(coalesce(cp, []), {FOLD("text")}), coalesce(tp, [])))) AS purposes,
  list_filter([CASE WHEN cpre OR pre THEN 'preticked_optional' END, CASE WHEN aa IS NOT NULL AND ra IS NULL THEN 'reject_absent_first_layer' END,
    CASE WHEN aa IS NOT NULL AND ra IS NOT NULL AND ((aa > 0 AND ra < aa * 0.5) OR (ac >= 4.5 AND rc < 3)) THEN 'reject_visually_deemphasised' END,
    CASE WHEN leg THEN 'legitimate_interest_default_on' END, CASE WHEN regexp_matches(text, '(?i){W.SHAMING}') THEN 'confirmshaming' END,
    CASE WHEN reject_clicks >= 2 THEN 'layered_rejection' END], lambda z: z IS NOT NULL) AS dark FROM j)
"""
BANNER = ("banners", "banner_buttons", "banner_toggles", "banner_tcf")


def _consent(spark, sf):
    return C.analyze_consent(*(model(spark, sf, n) for n in BANNER))


@query("c01_banner_detection", with_model(*BANNER, body=CONSENT + "SELECT banner_id, detected, platform AS cmp FROM c"))
def c01(spark, sf):
    return _consent(spark, sf).select("banner_id", "detected", "cmp")


@query("c02_consent_purposes", with_model(*BANNER, body=CONSENT + "SELECT banner_id, CASE WHEN detected THEN array_to_string(purposes, ',') ELSE '' END AS purposes FROM c"))
def c02(spark, sf):
    return _consent(spark, sf).select("banner_id", F.array_join("purposes", ",").alias("purposes"))


@query("c03_dark_patterns", with_model(*BANNER, body=CONSENT + "SELECT banner_id, CASE WHEN detected THEN array_to_string(list_sort(dark), ',') ELSE '' END AS dark_patterns FROM c"))
def c03(spark, sf):
    return _consent(spark, sf).select("banner_id", F.array_join(F.sort_array("dark_patterns"), ",").alias("dark_patterns"))


@query("c04_vendor_counts", with_model(*BANNER, body=CONSENT + r"SELECT banner_id, CASE WHEN detected THEN greatest(vendor_count, tcf_vendor_count) ELSE vendor_count END AS vendor_count, coalesce(try_cast(regexp_extract(text, '(?i)([0-9]+)\s+(?:vendors|partners)', 1) AS INT), 0) AS in_text FROM c"))
def c04(spark, sf):
    texts = model(spark, sf, "banners").select("banner_id", C.vendors_in_text(F.col("text")).alias("in_text"))
    return _consent(spark, sf).select("banner_id", "vendor_count").join(texts, "banner_id")


# ---- access -------------------------------------------------------------------------------
PERM = f"({values_sql(W.PERMISSION_CATEGORIES.items(), 'service, category')})"


@query(
    "a01_permission_categories",
    with_model("pevents", body=f"SELECT e.event_id, e.permission, p.category FROM pevents e JOIN ({values_sql(W.PERMISSION_CATEGORIES.items(), 'permission, category')}) p USING (permission) WHERE e.event_type = 'permission_request'"),
)
def a01(spark, sf):
    ev = model(spark, sf, "pevents").where("event_type = 'permission_request'")
    return ev.select("event_id", "permission", A.permission_category(F.col("permission")).alias("category"))


@query(
    "a02_grant_changes",
    with_model("grants", body=f"""WITH d AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS snap FROM (SELECT DISTINCT user_id, day FROM grants) x),
    g AS (SELECT g.*, d.snap FROM grants g JOIN d USING (user_id, day)), m AS (SELECT user_id, max(snap) AS last_snap FROM d GROUP BY user_id),
    j AS (SELECT coalesce(c.user_id, p.user_id) AS user_id, coalesce(c.client, p.client) AS client, coalesce(c.service, p.service) AS service, coalesce(c.snap, p.snap + 1) AS snap,
      c.auth_value AS auth, CASE WHEN c.user_id IS NULL THEN 'removed' WHEN c.snap = 1 THEN 'standing' WHEN p.user_id IS NULL THEN 'new'
      WHEN c.auth_value = p.auth_value AND c.last_modified = p.last_modified THEN 'same' ELSE 'changed' END AS change
      FROM g c FULL OUTER JOIN g p ON c.user_id = p.user_id AND c.client = p.client AND c.service = p.service AND c.snap = p.snap + 1)
    SELECT j.user_id, client, service, snap, change, CASE WHEN auth IN ('1', '2', '3') THEN 'granted' ELSE 'denied' END AS state, p.category
    FROM j JOIN m USING (user_id) JOIN {PERM} p USING (service) WHERE change <> 'same' AND snap <= last_snap"""),
)
def a02(spark, sf):
    return A.grant_changes(model(spark, sf, "grants"))


@query(
    "a03_access_breadth",
    with_model("grants", body=f"""SELECT user_id, day, client, count(DISTINCT category) AS categories, round(least(1.0, count(DISTINCT category) / 3.0), 6) AS breadth
    FROM grants JOIN {PERM} p USING (service) WHERE auth_value IN ('1', '2', '3') GROUP BY ALL"""),
)
def a03(spark, sf):
    return A.access_breadth(model(spark, sf, "grants")).withColumn("breadth", F.round("breadth", 6))


@query(
    "a04_clipboard_exposure",
    with_model("focus", "clip_copies", "clip_allowlist", body="""WITH f AS (SELECT *, lag(requester_key) OVER (PARTITION BY user_id ORDER BY us, event_id) AS prev FROM focus),
    j AS (SELECT f.*, c.event_id AS copy_id, c.writer_key, c.categories, c.cloud_sync FROM f ASOF JOIN clip_copies c ON f.user_id = c.user_id AND f.us >= c.us)
    SELECT user_id, event_id, us, requester_key, writer_key, copy_id, array_to_string(categories, ',') AS categories, cloud_sync FROM j
    WHERE requester_key IS DISTINCT FROM prev AND len(categories) > 0 AND requester_key <> writer_key
      AND NOT EXISTS (SELECT 1 FROM clip_allowlist a WHERE a.user_id = j.user_id AND a.requester_key = j.requester_key)"""),
)
def a04(spark, sf):
    out = A.clipboard_exposures(*(model(spark, sf, n) for n in ("clip_copies", "focus", "clip_allowlist")))
    return out.withColumn("categories", F.array_join("categories", ","))


STARTUP = "SELECT user_id, us // 86400000000 - 19723 AS day, mechanism AS client, 'startup' AS service, CAST(2 AS VARCHAR) AS auth_value, max(k) AS last_modified FROM pevents WHERE event_type = 'startup_registration' GROUP BY ALL"


@query(
    "a05_startup_changes",
    with_model("pevents", body=f"""WITH s AS ({STARTUP}), d AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS snap FROM (SELECT DISTINCT user_id, day FROM s) x),
    g AS (SELECT s.*, d.snap FROM s JOIN d USING (user_id, day))
    SELECT c.user_id, c.client, c.snap, CASE WHEN c.snap = 1 THEN 'standing' WHEN p.user_id IS NULL THEN 'new' ELSE 'changed' END AS change
    FROM g c LEFT JOIN g p ON c.user_id = p.user_id AND c.client = p.client AND c.snap = p.snap + 1
    WHERE c.snap = 1 OR p.user_id IS NULL OR c.last_modified <> p.last_modified"""),
)
def a05(spark, sf):
    day = (F.floor(F.col("us") / 86_400_000_000) - 19723).alias("day")
    items = (
        model(spark, sf, "pevents").where("event_type = 'startup_registration'")
        .groupBy("user_id", day, F.col("mechanism").alias("client"))
        .agg(F.lit("startup").alias("service"), F.lit("2").alias("auth_value"), F.max("k").alias("last_modified"))
    )
    return A.grant_changes(items).where("change <> 'removed'").select("user_id", "client", "snap", "change")
