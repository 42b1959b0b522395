from __future__ import annotations

from pyspark.sql import functions as F

from privatrail.dims import dimension
from privatrail.operators import history as H
from privatrail.operators import learning as G
from privatrail.operators import sketches as K
from privatrail.plans.registry import query
from privatrail.sources.model import model, with_model
from privatrail.sources.tables import append_bucketed, materialised, scratch

ASOF = 1704067200000000 + 45 * 86_400_000_000
LATEST = """
WITH ld AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) rn FROM decision_log) x WHERE rn = 1),
lr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY seq DESC) rn FROM responses) x WHERE rn = 1)
"""


def _logs(spark, sf):
    return (model(spark, sf, n) for n in ("pevents", "decision_log", "responses"))


@query(
    "h01_history_latest",
    with_model("pevents", "decision_log", "responses", body=LATEST + """
    SELECT e.event_id, e.us, e.event_type, e.requester_key, e.status, d.outcome, round(d.risk, 6) AS risk, coalesce(r.action, '') AS action
    FROM pevents e LEFT JOIN ld d USING (event_id) LEFT JOIN lr r USING (event_id)
    ORDER BY e.us DESC, e.event_id DESC LIMIT 500"""),
)
def h01(spark, sf):
    return H.history(*_logs(spark, sf), limit=500).select(
        "event_id", "us", "event_type", "requester_key", "status", "outcome", F.round("risk", 6).alias("risk"), "action"
    )


@query(
    "h01_history_filtered",
    with_model("pevents", "decision_log", "responses", body=LATEST + """
    SELECT e.event_id, e.us, e.event_type, d.outcome, coalesce(r.action, '') AS action
    FROM pevents e JOIN ld d USING (event_id) LEFT JOIN lr r USING (event_id)
    WHERE e.requester_key = 'https://site3.example' AND d.outcome = 'INTERVENE' ORDER BY e.us DESC, e.event_id DESC LIMIT 100"""),
)
def h01_filtered(spark, sf):
    out = H.history(*_logs(spark, sf), limit=100, requester="https://site3.example", outcome="INTERVENE")
    return out.select("event_id", "us", "event_type", "outcome", "action")


@query(
    "h01_bucketed_history",
    with_model("pevents", "decision_log", "responses", body=LATEST + """
    SELECT e.event_id, e.us, e.event_type, d.outcome, round(d.risk, 6) AS risk, coalesce(r.action, '') AS action
    FROM pevents e LEFT JOIN ld d USING (event_id) LEFT JOIN lr r USING (event_id)"""),
)
def h01_bucketed(spark, sf):
    """All events with their latest decision and answer, from logs bucketed by event: reading them shuffles nothing."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    logs = []
    for df in _logs(spark, sf):
        path = scratch(spark)
        logs.append(append_bucketed(df, path.rsplit("/", 1)[1].replace("-", "_"), "event_id", buckets, path))
    return H.event_history(*logs).select("event_id", "us", "event_type", "outcome", F.round("risk", 6).alias("risk"), "action")


@query(
    "h01_latest_line_per_order",
    """SELECT o.o_orderkey, o.o_orderstatus, l.l_linenumber, l.max_suppkey, l.n_lines FROM orders o LEFT JOIN (
         SELECT l_orderkey, max(l_linenumber) AS l_linenumber, max(l_suppkey) AS max_suppkey, count(*) AS n_lines
         FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey""",
)
def h01_orders(spark, sf):
    """The same latest-per-key shape on the large tables: order = event, line = log entry."""
    from privatrail.sources.tables import read_table

    lines = read_table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.max("l_linenumber").alias("l_linenumber"), F.max("l_suppkey").alias("max_suppkey"), F.count("*").alias("n_lines")
    )
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left").drop("l_orderkey")


@query(
    "h02_outcome_counts",
    with_model("decision_log", "responses", body=LATEST + "SELECT outcome, count(*) AS n FROM ld GROUP BY outcome"),
)
def h02(spark, sf):
    return H.outcome_counts(model(spark, sf, "decision_log"))


@query(
    "h03_since",
    with_model("pevents", "doc_cache", body="SELECT least((SELECT min(us) FROM pevents), (SELECT min(created_us) FROM doc_cache)) AS since_us"),
)
def h03(spark, sf):
    return H.since(model(spark, sf, "pevents"), model(spark, sf, "doc_cache"))


@query(
    "h04_requesters_by_kind",
    with_model("pevents", body="SELECT requester_kind, count(DISTINCT requester_key) AS requesters FROM pevents GROUP BY requester_kind"),
)
def h04(spark, sf):
    return H.requesters_by_kind(model(spark, sf, "pevents"))


@query(
    "h05_tracker_counts",
    with_model("pevents", body="""WITH p AS (SELECT DISTINCT requester_key, unnest(tracker_domains) AS domain FROM pevents WHERE event_type = 'tracking')
    SELECT count(*) AS trackers, count(DISTINCT domain) AS networks FROM p"""),
)
def h05(spark, sf):
    return H.tracker_counts(model(spark, sf, "pevents"))


@query(
    "h06_tracked_sites",
    with_model("pevents", body="""SELECT count(DISTINCT requester_key) AS tracked_sites,
    count(DISTINCT CASE WHEN fingerprinting THEN requester_key END) AS fingerprinting_sites FROM pevents WHERE event_type = 'tracking'"""),
)
def h06(spark, sf):
    return H.tracked_sites(model(spark, sf, "pevents"))


FILES = """SELECT CAST(coalesce(sum(coalesce(file_count, 1)), 0) AS BIGINT) AS files,
    count(CASE WHEN d.outcome IN ('INFORM', 'INTERVENE') THEN 1 END) AS sensitive_files
    FROM pevents e LEFT JOIN ld d USING (event_id) WHERE e.event_type = 'file_upload' AND e.status = 'complete'"""


@query("h07_files_checked", with_model("pevents", "decision_log", "responses", body=LATEST + FILES))
def h07(spark, sf):
    return H.files_checked(model(spark, sf, "pevents"), model(spark, sf, "decision_log"))


BANNERS = """SELECT count(CASE WHEN event_type = 'consent_banner' THEN 1 END) AS banners,
    count(DISTINCT CASE WHEN event_type = 'consent_banner' THEN requester_key END) AS banner_sites,
    count(DISTINCT CASE WHEN event_type = 'permission_request' THEN requester_key || '|' || permission END) AS grants,
    count(DISTINCT CASE WHEN event_type = 'permission_request' THEN requester_key END) AS granted_apps FROM pevents"""


@query("h08_banners_and_grants", with_model("pevents", body=BANNERS))
def h08(spark, sf):
    return H.banner_and_grant_counts(model(spark, sf, "pevents"))


@query(
    "h09_live_documents",
    with_model("doc_cache", body=f"""SELECT kind, count(*) AS documents, CAST(sum(word_count) AS BIGINT) AS words
    FROM doc_cache WHERE expires_us > {ASOF} AND NOT missing GROUP BY kind"""),
)
def h09(spark, sf):
    return H.live_documents(model(spark, sf, "doc_cache"), ASOF)


@query(
    "h10_decided_by_action",
    with_model("decision_log", "responses", body=LATEST + """SELECT r.action, count(*) AS n,
    count(CASE WHEN d.auto_action = r.action THEN 1 END) AS automatic FROM lr r LEFT JOIN ld d USING (event_id) GROUP BY r.action"""),
)
def h10(spark, sf):
    return H.decided_by_action(model(spark, sf, "decision_log"), model(spark, sf, "responses"))


@query(
    "h11_tally",
    with_model("pevents", "decision_log", "responses", "doc_cache", body=LATEST + f""",
    pairs AS (SELECT DISTINCT requester_key, unnest(tracker_domains) AS domain FROM pevents WHERE event_type = 'tracking'),
    one AS (SELECT (SELECT min(us) FROM pevents) AS first_event_us,
      (SELECT count(DISTINCT requester_key) FROM pevents WHERE requester_kind = 'website') AS sites,
      (SELECT count(DISTINCT requester_key) FROM pevents WHERE requester_kind <> 'website') AS apps,
      (SELECT count(*) FROM pairs) AS trackers, (SELECT count(DISTINCT domain) FROM pairs) AS tracker_networks,
      (SELECT count(DISTINCT requester_key) FROM pevents WHERE event_type = 'tracking') AS tracked_sites,
      (SELECT count(DISTINCT requester_key) FROM pevents WHERE fingerprinting) AS fingerprinting_sites,
      f.*, b.*, (SELECT count(*) FROM doc_cache WHERE expires_us > {ASOF} AND NOT missing AND kind = 'policy') AS policies,
      (SELECT count(*) FROM doc_cache WHERE expires_us > {ASOF} AND NOT missing AND kind = 'terms') AS terms,
      (SELECT CAST(sum(word_count) AS BIGINT) FROM doc_cache WHERE expires_us > {ASOF} AND NOT missing) AS document_words
      FROM ({FILES}) f, ({BANNERS}) b)
    UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE value"""),
)
def h11(spark, sf):
    return H.tally(
        model(spark, sf, "pevents"), model(spark, sf, "decision_log"), model(spark, sf, "doc_cache"), ASOF
    )


@query(
    "h12_activity_cube",
    with_model("pevents", "decision_log", "responses", body=LATEST + """SELECT event_type, outcome, day,
    CAST(grouping_id(event_type, outcome, day) AS BIGINT) AS level, count(*) AS n
    FROM (SELECT e.event_type, d.outcome, e.us // 86400000000 AS day FROM pevents e LEFT JOIN ld d USING (event_id)) x
    GROUP BY CUBE (event_type, outcome, day)"""),
)
def h12(spark, sf):
    return H.activity_cube(model(spark, sf, "pevents"), model(spark, sf, "decision_log"))


WEEK = "CAST(floor(us / 604800000000) AS BIGINT)"


@query(
    "h04_weeks_from_day_states",
    with_model("pevents", body=f"""SELECT {WEEK} AS week, requester_kind, count(DISTINCT requester_key) AS requesters,
    count(DISTINCT CASE WHEN event_type = 'tracking' THEN requester_key END) AS tracked_sites,
    count(DISTINCT CASE WHEN fingerprinting AND event_type = 'tracking' THEN requester_key END) AS fingerprinting_sites
    FROM pevents GROUP BY ALL"""),
)
def h04_weeks(spark, sf):
    """Weekly figures from daily states. The counts of the given tables are small enough for the states to be exact."""
    track = F.col("event_type") == "tracking"
    values = {
        "requesters": F.col("requester_key"), "tracked_sites": F.when(track, F.col("requester_key")),
        "fingerprinting_sites": F.when(track & F.col("fingerprinting"), F.col("requester_key")),
    }
    days = materialised(K.day_sketches(model(spark, sf, "pevents"), ["requester_kind"], values))
    return K.merged(days, [F.floor(F.col("day") / 7).alias("week"), "requester_kind"], list(values))


# ---- learning -----------------------------------------------------------------------------
RULES = """
WITH flat AS (SELECT user_id, purpose, unnest(categories) AS category, action, us, event_id, seq FROM responses),
marked AS (SELECT *, max(CASE WHEN action <> 'continue' THEN rn END) OVER (PARTITION BY user_id, category, purpose) AS last_other FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, category, purpose ORDER BY us, event_id, seq) AS rn FROM flat) x),
rules AS (SELECT user_id, category, purpose, count(*) AS total_decisions, max(rn) - coalesce(max(last_other), 0) AS consecutive_continue
  FROM marked GROUP BY user_id, category, purpose)
"""
PROTECTED = "('government_id', 'medical', 'financial', 'credentials', 'biometric_photo', 'minors_data')"


@query("g01_rule_state", with_model("responses", body=RULES + "SELECT * FROM rules"))
def g01(spark, sf):
    return G.rule_state(model(spark, sf, "responses"))


@query(
    "g02_active_rules",
    with_model("responses", body=RULES + f"""SELECT user_id, category, purpose FROM rules
    WHERE consecutive_continue >= 3 AND split_part(category, '.', 1) NOT IN {PROTECTED}"""),
)
def g02(spark, sf):
    return G.active_rules(G.rule_state(model(spark, sf, "responses")))


SITES = """WITH s AS (SELECT user_id, action, requester_key, min((us, event_id, seq)) AS f FROM responses
  WHERE action IN ('reject_optional', 'block') AND requester_key <> '' GROUP BY ALL)"""


# one user visits one model site, so the suggestion query folds users to their visible session
FOLDED = SITES.replace("SELECT user_id, action", "SELECT user_id % 4 AS user_id, action")


def _folded(spark, sf):
    return model(spark, sf, "responses").withColumn("user_id", F.col("user_id") % 4)


@query(
    "g03_suggestions",
    with_model("responses", body=FOLDED + """SELECT user_id, action, count(*) AS sites FROM s
    WHERE NOT (user_id = 1 AND action = 'block') GROUP BY user_id, action HAVING count(*) >= 5"""),
)
def g03(spark, sf):
    closed = dimension(spark, [(1, "block")], "user_id, action")
    return G.suggestions(_folded(spark, sf), closed)


@query(
    "g03_remembered_sites",
    with_model("responses", body=FOLDED + """SELECT user_id, action, requester_key, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, action ORDER BY f DESC) AS rank FROM s) x WHERE rank <= 50"""),
)
def g03_sites(spark, sf):
    return G.remembered_sites(_folded(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "g04_overrides",
    with_model("responses", body="""SELECT user_id, requester_key, CASE WHEN max_by(action, (us, event_id, seq)) = 'continue' THEN 'allow' ELSE 'ask' END AS override
    FROM responses WHERE remember GROUP BY user_id, requester_key"""),
)
def g04(spark, sf):
    return G.overrides(model(spark, sf, "responses"))


@query(
    "g04_expected_permissions",
    with_model("responses", body="SELECT DISTINCT user_id, requester_key, unnest(categories) AS category FROM responses WHERE action = 'mark_expected'"),
)
def g04_expected(spark, sf):
    return G.expected_permissions(model(spark, sf, "responses"))


@query(
    "g05_valid_responses",
    with_model("responses", body="""SELECT event_id, min_by(action, (us, seq)) AS action FROM responses
    WHERE (event_type = 'consent_banner' AND action IN ('reject_optional', 'continue', 'view_details'))
       OR (event_type = 'tracking' AND action IN ('block', 'learn_more', 'continue'))
       OR (event_type = 'file_upload' AND action IN ('cancel', 'redact')) GROUP BY event_id"""),
)
def g05(spark, sf):
    offered = model(spark, sf, "pevents").select(
        "event_id",
        F.when(F.col("event_type") == "consent_banner", F.array(*map(F.lit, ["reject_optional", "continue", "view_details"])))
        .when(F.col("event_type") == "tracking", F.array(*map(F.lit, ["block", "learn_more", "continue"])))
        .when(F.col("event_type") == "file_upload", F.array(*map(F.lit, ["cancel", "redact"])))
        .alias("actions"),
    )
    return G.valid_responses(model(spark, sf, "responses"), offered)
