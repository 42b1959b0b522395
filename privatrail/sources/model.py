"""The privacy model's tables, derived from the given tables by integer arithmetic on ids.

Each table is one SQL text over the given tables and other model tables. The same text is
rendered for Spark and for the engine that checks results, so both start from equal rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from privatrail.dims import values_sql
from privatrail.dims.categories import CATEGORIES, DEFAULT_PREFERENCES, category_rows, necessity_rows, purposes
from privatrail.dims.web import MODEL_TRACKERS, PERMISSION_CATEGORIES


class SparkText:
    """Spark spelling of the few constructs that differ between the engines."""

    def __init__(self, sf_dir: str) -> None:
        self.sf_dir = sf_dir

    def table(self, name: str) -> str:
        return f"parquet.`{self.sf_dir}/{name}.parquet`"

    def arr(self, *items: str) -> str:
        return f"array({', '.join(items)})" if items else "CAST(array() AS array<string>)"

    def pick(self, items: list[str], index: str) -> str:
        return f"element_at(array({', '.join(_q(i) for i in items)}), CAST({index} AS INT) + 1)"

    def us(self, ts: str) -> str:
        return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})"

    def k(self, props: str) -> str:
        return f"CAST(get_json_object({props}, '$.k') AS BIGINT)"

    def div(self, a: str, b: int) -> str:
        return f"(({a}) div {b})"

    def span(self, n: str) -> str:
        return f"explode(sequence(CAST(0 AS BIGINT), {n} - 1))"

    def unnest(self, a: str) -> str:
        return f"explode({a})"

    def lpad(self, a: str, n: int) -> str:
        return f"lpad(CAST({a} AS STRING), {n}, '0')"

    nl = "'\\n'"


class DuckText(SparkText):
    """The checking engine's spelling."""

    def __init__(self) -> None:
        super().__init__("")

    def table(self, name: str) -> str:
        return name

    def arr(self, *items: str) -> str:
        return f"[{', '.join(items)}]" if items else "CAST([] AS VARCHAR[])"

    def pick(self, items: list[str], index: str) -> str:
        return f"([{', '.join(_q(i) for i in items)}])[CAST({index} AS INT) + 1]"

    def us(self, ts: str) -> str:
        return f"epoch_us({ts})"

    def k(self, props: str) -> str:
        return f"CAST(regexp_extract({props}, '[0-9]+') AS BIGINT)"

    def div(self, a: str, b: int) -> str:
        return f"(({a}) // {b})"

    def span(self, n: str) -> str:
        return f"unnest(range(CAST({n} AS BIGINT)))"

    def unnest(self, a: str) -> str:
        return f"unnest({a})"

    nl = "chr(10)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


TABLES: dict[str, tuple[list[str], Callable[[SparkText], str]]] = {}


def table(*needs: str):
    def register(fn: Callable[[SparkText], str]) -> Callable[[SparkText], str]:
        TABLES[fn.__name__] = (list(needs), fn)
        return fn

    return register


def _closure(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for need in TABLES[name][0]:
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


_analysed: dict[tuple[int, str, str], DataFrame] = {}


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One model table as a DataFrame over the given tables; parsed once per session."""
    key = (id(spark), sf_dir, name)
    if key not in _analysed or _analysed[key].sparkSession is not spark:
        text = SparkText(sf_dir)
        ctes = ",\n".join(f"{n} AS ({TABLES[n][1](text)})" for n in _closure((name,)))
        _analysed[key] = spark.sql(f"WITH {ctes}\nSELECT * FROM {name}")
    return _analysed[key]


def with_model(*names: str, body: str) -> str:
    """The checking SQL: the named model tables as CTEs, then ``body`` (may start with more)."""
    text = DuckText()
    ctes = [f"{n} AS ({TABLES[n][1](text)})" for n in _closure(names)]
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


_CATS = [c for c, _, _ in CATEGORIES]


@table()
def dim_category(t: SparkText) -> str:
    return values_sql(category_rows(), "category, root, label, sensitivity, protected")


@table()
def dim_necessity(t: SparkText) -> str:
    return values_sql(necessity_rows(), "purpose, category, verdict")


@table()
def dim_tracker(t: SparkText) -> str:
    return values_sql([(d,) for d in MODEL_TRACKERS], "domain")


@table()
def pevents(t: SparkText) -> str:
    cls = """CASE src WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'form_observed' ELSE 'form_submit' END
      WHEN 'click' THEN 'consent_banner'
      WHEN 'view' THEN CASE WHEN k % 5 = 0 THEN 'clipboard_read' ELSE 'tracking' END
      WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'policy_document' ELSE 'file_upload' END
      ELSE CASE event_id % 6 WHEN 0 THEN 'system_access' WHEN 1 THEN 'screen_capture'
           WHEN 2 THEN 'startup_registration' WHEN 3 THEN 'redacted_document' ELSE 'permission_request' END END"""
    few = t.pick(["email", "phone", "full_name"], "k % 3")
    tr = MODEL_TRACKERS
    web = "('form_submit', 'form_observed', 'consent_banner', 'tracking', 'file_upload', 'policy_document')"
    return f"""
    SELECT event_id, us, user_id, k, event_type, requester_kind, requester_key, purpose, purpose_confidence,
      CASE WHEN event_type IN ('consent_banner', 'policy_document', 'redacted_document') THEN {t.arr()}
           WHEN event_type = 'tracking' THEN {t.arr("'device_identifiers'")}
           WHEN c1 = c2 THEN {t.arr("c1")} WHEN c1 < c2 THEN {t.arr("c1", "c2")} ELSE {t.arr("c2", "c1")} END AS categories,
      CASE WHEN event_type = 'tracking' THEN CAST(event_id % 100 AS DOUBLE) / 100 ELSE 0e0 END AS confidence,
      CASE WHEN event_type <> 'tracking' OR k % 4 = 0 THEN {t.arr()}
           WHEN k % 4 = 1 THEN {t.arr(t.pick(tr, "k % 12"))}
           ELSE {t.arr(t.pick(tr, "k % 12"), t.pick(tr, "(k + 5) % 12"))} END AS tracker_domains,
      event_type = 'tracking' AND k % 7 = 0 AS fingerprinting,
      CASE WHEN event_type <> 'tracking' THEN {t.arr()}
           WHEN k % 4 > 0 AND k % 3 = 0 THEN {t.arr("'known_tracker_requests'", "'url_decoration'")}
           WHEN k % 4 > 0 THEN {t.arr("'known_tracker_requests'")}
           WHEN k % 3 = 0 THEN {t.arr("'url_decoration'")} ELSE {t.arr()} END AS signals,
      CASE WHEN event_type <> 'consent_banner' OR k % 3 = 0 THEN {t.arr()}
           WHEN k % 3 = 1 THEN {t.arr("'preticked_optional'")}
           ELSE {t.arr("'confirmshaming'", "'preticked_optional'")} END AS dark_patterns,
      CASE WHEN event_type <> 'consent_banner' THEN {t.arr()}
           WHEN k % 4 = 0 THEN {t.arr("'necessary'")}
           ELSE {t.arr("'advertising'", "'necessary'")} END AS consent_purposes,
      CASE WHEN event_type = 'consent_banner' THEN k * 3 ELSE 0 END AS vendor_count,
      {t.pick(["onetrust", "cookiebot", "unknown"], "k % 3")} AS cmp,
      CASE WHEN event_type = 'file_upload' THEN 1 + k % 4 END AS file_count,
      event_type IN ('file_upload', 'policy_document') AND event_id % 9 = 0 AS partial,
      {t.pick(list(PERMISSION_CATEGORIES), "k % 17")} AS permission,
      {t.pick(["requested", "granted", "denied", "active", "stopped"], "event_id % 5")} AS state,
      CASE WHEN event_type <> 'system_access' THEN {t.arr()}
           WHEN k % 3 = 0 THEN {t.arr("'history'", "'tabs'")} WHEN k % 3 = 1 THEN {t.arr("'tabs'")}
           ELSE {t.arr("'clipboardRead'", "'history'", "'tabs'")} END AS accesses,
      CASE WHEN event_type = 'system_access' THEN CASE k % 3 WHEN 0 THEN 2e0 / 3e0 WHEN 1 THEN 1e0 / 3e0 ELSE 1e0 END ELSE 0e0 END AS breadth,
      event_type IN ('system_access', 'permission_request') AND event_id % 8 = 0 AS existing,
      CASE WHEN event_type = 'clipboard_read' THEN
        CASE WHEN k % 10 = 0 THEN requester_key ELSE 'com.vendor.app' || CAST(k % 13 AS STRING) END ELSE '' END AS writer_key,
      event_type = 'clipboard_read' AND k % 15 = 0 AS cloud_sync,
      event_type = 'screen_capture' AND k % 2 = 0 AS active,
      event_type = 'screen_capture' AND k % 3 = 0 AS first_grant,
      event_type = 'policy_document' AND k % 2 = 0 AS missing,
      CASE WHEN event_type = 'startup_registration' THEN 'agents' || CAST(k % 3 AS STRING) ELSE '' END AS mechanism,
      CASE WHEN event_type = 'redacted_document' THEN '/files/' || CAST(k % 5 AS STRING) ELSE '' END AS file_path,
      's' || CAST(user_id % 25 AS STRING) AS session_id,
      CASE WHEN event_type = 'file_upload' AND event_id % 13 = 0 THEN 'aborted' ELSE 'complete' END AS status
    FROM (
      SELECT y.*, CASE WHEN event_id % 4 = 0 THEN {t.pick(_CATS, "k % 48")} ELSE {few} END AS c1,
        CASE WHEN event_id % 5 = 0 THEN {t.pick(_CATS, "(k + 7) % 48")}
             WHEN event_id % 4 = 0 THEN {t.pick(_CATS, "k % 48")} ELSE {few} END AS c2,
        CASE WHEN event_type IN {web} THEN 'website'
             WHEN event_type = 'system_access' AND k % 2 = 0 THEN 'extension' ELSE 'application' END AS requester_kind,
        CASE WHEN event_type IN {web} THEN 'https://site' || CAST(user_id % 40 AS STRING) || '.example'
             ELSE 'com.vendor.app' || CAST(user_id % 13 AS STRING) END AS requester_key,
        CASE WHEN user_id % 12 = 0 THEN 'unknown' ELSE {t.pick(purposes(), "user_id % 46")} END AS purpose,
        CASE WHEN user_id % 12 = 0 THEN 0e0 WHEN user_id % 7 = 0 THEN 0.3e0 ELSE 0.95e0 END AS purpose_confidence
      FROM (SELECT x.*, {cls} AS event_type FROM (
        SELECT event_id, user_id, event_type AS src, {t.us("ts")} AS us, {t.k("props")} AS k FROM {t.table("events")}) x) y) z"""


@table()
def profiles(t: SparkText) -> str:
    return f"""
    SELECT requester_key, n,
      CASE WHEN n % 5 = 0 THEN {t.arr("'advertising_partners'")} WHEN n % 5 = 1 THEN {t.arr("'affiliates'", "'data_brokers'")}
           ELSE {t.arr("'affiliates'")} END AS shares_with,
      CASE WHEN n % 6 = 0 THEN {t.arr("'ai_training'")} ELSE {t.arr("'analytics'")} END AS purposes,
      CASE WHEN n % 4 = 0 THEN 'after_deletion' ELSE 'unspecified' END AS retention,
      n % 9 = 0 AS training_on_user_content, n % 3 = 0 AS international_transfer, n % 7 = 0 AS data_sale,
      CAST(n % 10 AS DOUBLE) / 10 AS tracking_confidence,
      CASE n % 4 WHEN 0 THEN {t.arr()} WHEN 1 THEN {t.arr("'data_sale'")}
        WHEN 2 THEN {t.arr("'automatic_renewal'", "'data_sale'")} ELSE {t.arr("'liability_cap'")} END AS clauses,
      n % 8 = 0 AS policy_missing
    FROM (SELECT DISTINCT 'https://site' || CAST(user_id % 40 AS STRING) || '.example' AS requester_key, user_id % 40 AS n
          FROM {t.table("events")}) x"""


@table()
def users(t: SparkText) -> str:
    return f"""
    SELECT user_id, user_id % 5 <> 4 AS reject_optional_cookies, user_id % 6 = 5 AS auto_reject, user_id % 8 = 7 AS auto_block
    FROM (SELECT DISTINCT user_id FROM {t.table("events")}) x"""


@table("users")
def pref_category(t: SparkText) -> str:
    usual = "CASE category " + " ".join(f"WHEN {_q(c)} THEN {_q(p)}" for c, p in DEFAULT_PREFERENCES.items()) + " END"
    names = t.arr(*[_q(c) for c in DEFAULT_PREFERENCES])
    return f"""
    SELECT user_id, category, CASE WHEN category = 'phone' AND user_id % 3 = 0 THEN 'usually_allow'
      WHEN category = 'location_precise' AND user_id % 4 = 0 THEN 'reject' ELSE {usual} END AS preference
    FROM (SELECT user_id, {t.unnest(names)} AS category FROM users) d
    UNION ALL SELECT user_id, 'full_name', 'usually_allow' FROM users WHERE user_id % 2 = 0
    UNION ALL SELECT user_id, 'financial.iban', 'reject' FROM users WHERE user_id % 5 = 0"""


@table("users")
def pref_override(t: SparkText) -> str:
    return """
    SELECT user_id, 'https://site' || CAST(user_id % 40 AS STRING) || '.example' AS requester_key, 'allow' AS action
    FROM users WHERE user_id % 10 = 1"""


@table("users")
def pref_expected(t: SparkText) -> str:
    names = t.arr("'email'", "'phone'", "'full_name'")
    return f"""
    SELECT user_id, 'com.vendor.app' || CAST(user_id % 13 AS STRING) AS requester_key, {t.unnest(names)} AS category
    FROM users WHERE user_id % 9 = 2"""


@table("users")
def clip_allowlist(t: SparkText) -> str:
    return "SELECT user_id, 'com.vendor.app' || CAST(user_id % 13 AS STRING) AS requester_key FROM users WHERE user_id % 14 = 3"


@table("pevents")
def responses(t: SparkText) -> str:
    default = """CASE event_type WHEN 'form_observed' THEN 'review_fields' WHEN 'consent_banner' THEN 'reject_optional'
      WHEN 'tracking' THEN 'block' WHEN 'clipboard_read' THEN 'clear_clipboard' WHEN 'redacted_document' THEN 'unredact'
      WHEN 'permission_request' THEN CASE WHEN k % 3 <> 0 THEN 'mark_expected' ELSE 'open_settings' END
      WHEN 'system_access' THEN 'open_settings' WHEN 'screen_capture' THEN 'open_settings'
      WHEN 'startup_registration' THEN 'open_settings' ELSE 'cancel' END"""
    cols = "event_id, user_id, event_type, requester_key, requester_kind, purpose, categories"
    return f"""
    SELECT {cols}, 1 AS seq, us + (event_id % 600) * 1000000 AS us,
      CASE WHEN k % 4 <> 0 AND event_type NOT IN ('tracking', 'consent_banner', 'permission_request') THEN 'continue' WHEN k % 2 = 0 THEN 'continue' ELSE {default} END AS action,
      event_id % 7 = 0 AS remember FROM pevents WHERE event_id % 3 <> 0
    UNION ALL
    SELECT {cols}, 2 AS seq, us + 900000000 AS us, 'continue' AS action, FALSE AS remember
    FROM pevents WHERE event_id % 11 = 0 AND event_id % 3 <> 0"""


@table("pevents")
def decision_log(t: SparkText) -> str:
    body = f"""event_id, user_id, us + {{n}} * 1000000 AS us, {{n}} AS seq,
      {t.pick(["IGNORE", "INFORM", "INTERVENE"], "(k + {n}) % 3")} AS outcome,
      CAST((k + {{n}}) % 100 AS DOUBLE) / 100 AS risk,
      CASE WHEN k % 9 = 0 THEN 'reject_optional' WHEN k % 9 = 1 THEN 'block' ELSE '' END AS auto_action"""
    return f"""
    SELECT {body.replace("{n}", "1")} FROM pevents WHERE event_id % 10 <> 0
    UNION ALL SELECT {body.replace("{n}", "2")} FROM pevents WHERE event_id % 4 = 0 AND event_id % 10 <> 0"""


@table()
def doc_cache(t: SparkText) -> str:
    day = "86400000000"
    return f"""
    SELECT 'https://' || source || '.example' AS origin, doc_id, text,
      CASE WHEN doc_id % 3 = 0 THEN 'terms' ELSE 'policy' END AS kind, doc_id % 11 = 0 AS missing,
      n_chars % 5000 AS word_count, 1704067200000000 + (doc_id % 60) * {day} AS created_us,
      1704067200000000 + (doc_id % 60 + 30) * {day} AS expires_us
    FROM {t.table("documents")}"""


@table("pevents")
def requests(t: SparkText) -> str:
    sub = t.pick(["", "ads.", "cm.g.", "stats.", "px.", "not", "www."], "event_id % 7")
    host = f"{sub} || {t.pick(MODEL_TRACKERS + ['plain.example', 'shop.co.uk', 'cdn.host.co.uk', 'self'], 'k % 16')}"
    path = t.pick(["/collect", "/pixel.gif", "/sync", "/PIXEL", "/a/b", "/match/user"], "event_id % 6")
    query = t.pick(
        ["", "?uid=9", "?gclid=abc", "?x=1&fbclid=77", "?cid=", "?email_hash=ff", "?q=2#gclid=1", "?ref=a&_ga=1.2"],
        "(event_id + k) % 8",
    )
    return f"""
    SELECT event_id, site, url, host, CASE WHEN k % 10 = 3 THEN {t.pick(MODEL_TRACKERS, "event_id % 12")} END AS cname,
      event_id % 6 IN (1, 3) AS is_pixel
    FROM (SELECT event_id, k, site, h AS host, 'https://' || h || {path} || {query} AS url FROM (
      SELECT event_id, k, requester_key AS site, CASE WHEN k % 16 = 15 THEN substr(requester_key, 9) ELSE {host} END AS h
      FROM pevents WHERE event_type IN ('tracking', 'consent_banner', 'form_submit')) a) b"""


@table("pevents")
def cookies(t: SparkText) -> str:
    return f"""
    SELECT event_id, requester_key AS site, {t.pick(["", "."], "event_id % 2")} || {t.pick(["", "ads.", "not"], "k % 3")} ||
      {t.pick(MODEL_TRACKERS + ["plain.example"], "k % 13")} AS domain, 'c' || CAST(k AS STRING) AS name,
      event_id % 3 <> 0 AS third_party, CAST(event_id % 90 AS DOUBLE) AS lifetime_days
    FROM pevents WHERE event_type = 'tracking'"""


@table("pevents")
def api_calls(t: SparkText) -> str:
    calls = [
        "canvas.toDataURL", "canvas.fillText", "AudioContext", "getFloatFrequencyData", "navigator.plugins",
        "navigator.hardwareConcurrency", "navigator.deviceMemory", "WebGL.renderer", "fetch", "addEventListener",
    ]
    return f"""
    SELECT event_id, requester_key AS site, {t.pick(calls, "(k + event_id) % 10")} AS call
    FROM pevents WHERE event_type = 'tracking' AND event_id % 2 = user_id % 2"""


@table("pevents")
def storage_ids(t: SparkText) -> str:
    return """
    SELECT event_id, requester_key AS origin, CASE WHEN k % 3 = 0 THEN 'id' || CAST(k AS STRING)
      ELSE 'id' || requester_key || CAST(k AS STRING) END AS hash
    FROM pevents WHERE event_type = 'tracking'"""


@table("pevents")
def banners(t: SparkText) -> str:
    texts = [
        "We use necessary and analytics cookies. 120 partners.",
        "Cookie consent for personalised advertising, shared with 87 vendors.",
        "No thanks, show me the wrong things. Cookies help.",
        "Privacy preferences: measurement and profiling",
        "Welcome to our site",
        "Essential cookies only; I don't want a good offer",
        "Reject and you may lose features. We set a cookie for statistics.",
        "Marketing cookie notice across cross-site networks",
    ]
    selectors = ["#onetrust-banner-sdk", ".truste_overlay", "#didomi-host", ".klaro", "#unknown-banner", "#shop-banner"]
    return f"""
    SELECT event_id AS banner_id, requester_key AS site, {t.pick(texts, "k % 8")} AS text,
      CASE WHEN k % 6 = 4 THEN 'cookiebot' ELSE 'unknown' END AS cmp,
      CASE WHEN k % 5 = 4 THEN {t.arr(t.pick(selectors, "k % 6"), "'.klaro'")} ELSE {t.arr(t.pick(selectors, "k % 6"))} END AS selectors,
      k % 7 = 0 AS tcf_present, k % 50 AS vendor_count, CASE WHEN k % 7 = 0 THEN k ELSE 0 END AS tcf_vendor_count,
      event_id % 3 <> 0 AS fixed_or_sticky, 1 + event_id % 3 AS reject_clicks, k
    FROM pevents WHERE event_type = 'consent_banner'"""


@table("banners")
def banner_buttons(t: SparkText) -> str:
    labels = ["Accept all", "Reject", "Alle akzeptieren", "Necessary only", "Settings", "Ablehnen", "I agree", "More"]
    return f"""
    SELECT banner_id, i AS ord, {t.pick(labels, "(banner_id + i * 3) % 8")} AS text,
      CASE WHEN (banner_id + i) % 9 = 0 THEN 'reject' WHEN (banner_id + i) % 9 = 4 THEN 'accept' ELSE '' END AS role,
      (banner_id + i) % 11 <> 0 AS visible, CAST(1000 + (banner_id * (i + 1)) % 4000 AS DOUBLE) AS area,
      2e0 + CAST((banner_id + i) % 6 AS DOUBLE) AS contrast, 1 + (banner_id + i) % 4 % 2 AS layer
    FROM (SELECT banner_id, {t.span("1 + k % 4")} AS i FROM banners) x"""


@table("banners")
def banner_toggles(t: SparkText) -> str:
    names = ["Targeted advertising", "Site analytics", "Partner surveys", "Essential", "Profiling"]
    return f"""
    SELECT banner_id, {t.pick(names, "(banner_id + i) % 5")} AS purpose, (banner_id + i) % 4 = 0 AS enabled,
      (banner_id + i) % 3 <> 0 AS optional, (banner_id + i) % 8 = 0 AS legitimate_interest
    FROM (SELECT banner_id, {t.span("1 + k % 3")} AS i FROM banners) x"""


@table("banners")
def banner_tcf(t: SparkText) -> str:
    return f"""
    SELECT banner_id, CAST(1 + (banner_id + i * 3) % 12 AS STRING) AS purpose_id, (banner_id + i) % 3 = 0 AS enabled
    FROM (SELECT banner_id, {t.span("1 + k % 3")} AS i FROM banners WHERE tcf_present) x"""


@table("pevents")
def form_fields(t: SparkText) -> str:
    labels = [
        "Email address", "Full name", "Phone number", "Home address", "Date of birth", "Password", "Passport number",
        "Credit card number", "IBAN", "Age", "Gender", "Job title", "Which animal did you keep as a child?",
        "Search", "Verification code", "Username", "Telephone or E-mail", "Religion", "Diagnosis", "Comments",
        "Bank account number", "Social Security Number", "Anschrift", "Average score",
    ]
    tokens = ["", "", "", "email", "tel", "billing street-address", "cc-number", "new-password", "current-password", "one-time-code", "shipping postal-code", "bday", "off name"]
    types = ["text", "text", "text", "email", "tel", "password", "number", "search", "textarea", "file", "checkbox"]
    return f"""
    SELECT event_id AS form_id, user_id, purpose AS site_purpose, event_type, i AS ord, 'f' || CAST(i AS STRING) AS field_id,
      {t.pick(labels, "(k + i * 5) % 24")} AS label, 'n' || CAST(i AS STRING) AS name,
      {t.pick(tokens, "(event_id + i * 7) % 13")} AS autocomplete, {t.pick(types, "(event_id + k + i * 3) % 11")} AS input_type,
      (event_id + i) % 2 = 0 AS required, (event_id + i) % 7 = 0 AS asserted_required, (event_id + i) % 3 = 0 AS filled,
      CASE WHEN (event_id + i) % 5 = 0 THEN 6 ELSE 0 END AS max_length
    FROM (SELECT event_id, user_id, k, purpose, event_type, {t.span("1 + k % 6")} AS i
          FROM pevents WHERE event_type IN ('form_submit', 'form_observed')) x"""


@table()
def policy_texts(t: SparkText) -> str:
    from privatrail.dims.policy import MODEL_PARAGRAPHS as paras

    n = len(paras)
    p = [t.pick(paras, f"(doc_id * {m} + {a}) % {n}") for m, a in ((1, 0), (3, 5), (7, 11), (5, 2))]
    heads = t.pick(["Information we collect", "Sharing:", "Your choices", "Retention", "Age", "Changes"], "doc_id % 6")
    return f"""
    SELECT doc_id, source, 'https://' || source || '.example' AS site, CASE WHEN doc_id % 3 = 0 THEN 'terms' ELSE 'policy' END AS kind,
      {t.pick(purposes(), "doc_id % 46")} AS site_purpose,
      CASE WHEN doc_id % 37 = 0 THEN '  ' ELSE
        {p[0]} || {t.nl} || {heads} || {t.nl} || {p[1]} || {t.nl} || {t.nl} || text || {t.nl} || {p[2]} || {t.nl} || 'Contact' || {t.nl} || {p[3]} END AS text
    FROM {t.table("documents")}"""


@table("pevents")
def grants(t: SparkText) -> str:
    return f"""
    SELECT user_id, day, 'com.vendor.app' || CAST((user_id + s) % 13 AS STRING) AS client,
      {t.pick(["camera", "files", "screen", "automation", "accessibility", "unlisted"], "s")} AS service,
      {t.pick(["0", "2", "2", "1"], "(user_id + " + t.div("day * (s + 1)", 9) + ") % 4")} AS auth_value, {t.div("day", 5)} AS last_modified
    FROM (SELECT user_id, day, {t.span("CAST(6 AS BIGINT)")} AS s
          FROM (SELECT DISTINCT user_id, {t.div("us", 86400000000)} - 19723 AS day FROM pevents) a) b
    WHERE (user_id + day + s) % 6 <> 0"""


@table("pevents")
def focus(t: SparkText) -> str:
    return """SELECT event_id, user_id, us, 'com.vendor.app' || CAST(k % 13 AS STRING) AS requester_key
    FROM pevents WHERE event_id % 2 = 0"""


@table("pevents")
def clip_copies(t: SparkText) -> str:
    return f"""
    SELECT event_id, user_id, us, 'com.vendor.app' || CAST((k + 1) % 13 AS STRING) AS writer_key,
      CASE WHEN k % 4 = 0 THEN {t.arr()} ELSE {t.arr(t.pick(_CATS, "k % 48"))} END AS categories, k % 20 = 7 AS cloud_sync
    FROM pevents WHERE event_id % 2 = 1"""


@table()
def notes(t: SparkText) -> str:
    """Short labelled records about customers, with numbers that may or may not check."""
    def pad(a: str, n: int) -> str:
        return t.lpad(a, n)

    key = "c_custkey"
    card = f"'4' || {pad(f'({key} * 7919) % 1000000', 6)} || '00' || {pad(f'({key} * 104729) % 10000000', 7)}"
    texts = [
        f"'Full name: Ann Lee' || {t.nl} || 'email: user' || CAST({key} AS STRING) || '@mail.example'",
        f"'DOB: 19' || {pad(f'{key} % 90 + 10', 2)} || '-02-1' || CAST({key} % 10 AS STRING) || ' card ' || {card}",
        f"'SSN ' || {pad(f'{key} % 1000', 3)} || '-' || {pad(f'{key} % 7', 2)} || '-' || {pad(f'{key} % 9000', 4)}",
        f"'Routing number: ' || {pad(f'{key} * 37 % 100', 2)} || {pad(f'{key} * 7919 % 10000000', 7)}",
        f"'Diagnosis: influenza' || {t.nl} || 'Medication: tablets ' || CAST({key} AS STRING)",
        f"'nhs number ' || {pad(f'({key} * 1234577) % 10000000000', 10)}",
        f"'Password: pw-' || CAST({key} AS STRING) || ' GPS: 12.' || {pad(f'{key} % 10000', 4)}",
        f"'call (555) ' || {pad(f'{key} % 900 + 100', 3)} || '-' || {pad(f'{key} % 9000 + 1000', 4)} || ' passport X' || {pad(f'{key}', 8)}",
        f"'account number: ' || {pad(f'{key} * 31', 10)} || ' tax id: AB-' || {pad(f'{key}', 7)}",
        f"'national id ' || {pad(f'(200000000000 + {key} * 99991) % 1000000000000', 12)} || '; name = Bo Ek'",
    ]
    body = " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(texts))
    return f"SELECT c_custkey AS doc_id, CASE c_custkey % 10 {body} END AS text, c_mktsegment AS source FROM {t.table('customer')}"


@table()
def numbers(t: SparkText) -> str:
    """Digit strings of several lengths made from order keys, for the checksum validators."""
    key = "o_orderkey"
    return f"""SELECT o_orderkey AS id,
      {t.lpad(f"({key} * 7919 + o_custkey) % 1000000000", 9)} AS nine,
      {t.lpad(f"({key} * 104729 + o_custkey * 31) % 10000000000", 10)} AS ten,
      {t.lpad(f"(200000000000 + {key} * 1299709 + o_custkey) % 1000000000000", 12)} AS twelve,
      '4' || {t.lpad(f"({key} * 15485863 + o_custkey) % 1000000000000000", 15)} AS sixteen,
      {t.pick(["GB", "DE", "NO", "XX"], f"{key} % 4")} || {t.lpad(f"{key} % 97 + 2", 2)} ||
        {t.pick(["WEST", "", "", "ABCD"], f"{key} % 4")} || {t.lpad(f"({key} * 7919) % 100000000000", 11)} ||
        {t.pick(["123", "1234567", "", "9"], f"{key} % 4")} AS iban
    FROM {t.table("orders")}"""


@table("pevents")
def upload_chunks(t: SparkText) -> str:
    return f"""
    SELECT 'u' || CAST(event_id AS STRING) AS upload_id, user_id, us + i * 1000000 * (1 + (event_id + i) % 140) AS us, i AS seq,
      {t.pick(["alpha ", "beta ", "gamma ", "delta "], "(k + i) % 4")} AS data,
      CASE WHEN event_id % 10 = 0 THEN 999 ELSE 0 END AS size_error, 1 + k % 4 AS parts
    FROM (SELECT event_id, user_id, us, k, {t.span("1 + k % 4")} AS i FROM pevents WHERE event_type = 'file_upload') x
    WHERE NOT (event_id % 8 = 0 AND i = 1)"""


@table("pevents")
def site_signals(t: SparkText) -> str:
    """Requesters with the wording around them."""
    titles = [
        "Free PDF download now", "Online bank KYC and banking", "Patient portal of the hospital clinic", "weather app",
        "Cooking recipe and meal ideas", "nothing in particular", "screen recorder and screen capture", "photo editor",
        "News headlines", "shop checkout, online shop", "legal services", "plain page",
    ]
    hosts = ["site1.example", "www.site2.example", "site3.example.evil.test", "a.site5.example", "tool.example", "m.shop.co.uk", "example", "other.test"]
    return f"""
    SELECT event_id, {t.pick(hosts, "(k + user_id) % 8")} AS host, {t.pick(titles, "k % 12")} AS signal_text, purpose, purpose_confidence
    FROM pevents"""


@table("notes")
def texts(t: SparkText) -> str:
    """Documents and notes as one corpus."""
    return f"""SELECT doc_id, text, source FROM {t.table("documents")}
    UNION ALL SELECT doc_id + 100000000 AS doc_id, text, source FROM notes"""


@table("numbers")
def cards(t: SparkText) -> str:
    """Texts with a bare twelve-digit number, on a card or on an invoice, and an IBAN in prose."""
    return """SELECT id AS doc_id, twelve, iban, CASE WHEN id % 3 = 0 THEN 'Aadhaar' WHEN id % 3 = 1 THEN 'Government of India' ELSE 'Invoice' END
      || ' ref ' || substr(twelve, 1, 4) || ' ' || substr(twelve, 5, 4) || ' ' || substr(twelve, 9, 4) || ' end' AS text,
      'Transfer to ' || iban || ' today please' AS iban_text FROM numbers"""
