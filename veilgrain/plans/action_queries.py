"""Origin rules, action logs, tokens, captures and grounding."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain import constants as K
from veilgrain.functions import text as X
from veilgrain.operators import actions as A
from veilgrain.plans import views as V
from veilgrain.plans.screen_queries import GOAL_HIT_SQL, any_sql, ascii_norm_sql, hit_sql

Q = {}
SQL = {}
SECRET = "example-key"

# Host decorations of page urls by page_id % 8.
_URLS = ("{u}", "ftp://{h}/x", "https://ann:pw@{h}/", "{h}:8443/p", "HTTPS://{h}:443", "http://{h}:80/a?b", "https://{h}:99999", "  {u} ")


def _urls(spark, d):
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    arms = []
    for form in _URLS:
        parts = F.lit(form)
        parts = F.replace(F.replace(parts, F.lit("{u}"), F.col("url")), F.lit("{h}"), host)
        arms.append(parts)
    return V.table(spark, d, "pages").select(
        "page_id", "url", F.element_at(F.array(*arms), (F.col("page_id") % 8 + 1).cast("int")).alias("raw")
    )


def normalise_origin(spark, d):
    return _urls(spark, d).select("page_id", X.normalise_origin(F.col("raw")).alias("origin"))


Q["normalise_origin"] = normalise_origin
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
_SCHEME = "regexp_extract(url, '^([a-z]+)://', 1)"
_ORIGIN = f"""CASE page_id % 8 WHEN 0 THEN {_SCHEME} || '://' || {_HOST} WHEN 3 THEN 'https://' || {_HOST} || ':8443'
  WHEN 4 THEN 'https://' || {_HOST} WHEN 5 THEN 'http://' || {_HOST} WHEN 7 THEN {_SCHEME} || '://' || {_HOST} END"""
SQL["normalise_origin"] = f"SELECT page_id, {_ORIGIN} AS origin FROM pages"


def origin_match(spark, d):
    expected = F.concat(F.lit("https://"), F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1))
    return _urls(spark, d).select(
        "page_id",
        A.origin_match(F.col("raw"), expected).alias("strict"),
        A.origin_match(F.concat(expected, F.lit(".evil.com")), expected, "lenient").alias("lenient_suffix"),
    )


Q["origin_match"] = origin_match
SQL["origin_match"] = f"""SELECT page_id, coalesce(o = 'https://' || {_HOST}, false) AS strict, true AS lenient_suffix
  FROM (SELECT *, {_ORIGIN} AS o FROM pages)"""

Q["domain_allowed"] = lambda spark, d: A.domain_allowed(V.actions(spark, d), V.anchors(spark, d)).select(
    "action_id", "domain_allowed"
)
SQL["domain_allowed"] = V.with_views(
    ["actions", "anchors"],
    "SELECT action_id, action <> 'NAVIGATE' OR contains(lower(value), lower(nav_domain)) AS domain_allowed FROM actions JOIN anchors USING (task_id)",
)


def domain_allowed_strict(spark, d):
    anchors = V.anchors(spark, d).withColumn("hosts", F.array("origin", F.lit("https://help.example.com")))
    out = A.domain_allowed(V.actions(spark, d), anchors, mode="strict", domain="hosts")
    return out.groupBy("task_id").agg(F.count_if("domain_allowed").alias("ok"), F.count("*").alias("n"))


Q["domain_allowed_strict"] = domain_allowed_strict
SQL["domain_allowed_strict"] = V.with_views(
    ["actions", "anchors"],
    """SELECT task_id, count(*) FILTER (action <> 'NAVIGATE' OR value = origin || '/next') AS ok, count(*) AS n
      FROM actions JOIN anchors USING (task_id) GROUP BY task_id""",
)

RISK_SQL = """CASE WHEN action IN ('SCROLL', 'HOVER', 'WAIT') THEN 'LOW'
  WHEN tag IS NOT NULL AND (input_type = 'password' OR contains(id_attr, 'card') OR contains(name_attr, 'card') OR contains(id_attr, 'pay')
    OR contains(id_attr, 'delete') OR contains(id_attr, 'reset')) THEN 'CRITICAL'
  WHEN tag = 'button' AND (input_type = 'submit' OR contains(id_attr, 'book') OR contains(id_attr, 'pay')) THEN 'HIGH' ELSE 'MEDIUM' END"""
Q["risk_level"] = lambda spark, d: A.with_risk(V.actions(spark, d), V.live_nodes(spark, d)).select("action_id", "risk")
SQL["risk_level"] = V.with_views(
    ["actions", "live_nodes"], f"SELECT action_id, {RISK_SQL} AS risk FROM actions LEFT JOIN live_nodes USING (task_id, node_id)"
)

CONFLICT_SQL = """coalesce((contains(id_attr, 'delete') OR contains(id_attr, 'reset') OR contains(id_attr, 'transfer') OR input_type = 'password')
  AND goal = 'flight_booking' AND action <> 'TYPE', false)"""
Q["target_conflict"] = lambda spark, d: A.target_conflict(
    V.actions(spark, d), V.anchors(spark, d), V.live_nodes(spark, d)
).select("action_id", "target_conflict")
SQL["target_conflict"] = V.with_views(
    ["actions", "anchors", "live_nodes"],
    f"SELECT action_id, {CONFLICT_SQL} AS target_conflict FROM actions JOIN anchors USING (task_id) LEFT JOIN live_nodes USING (task_id, node_id)",
)

_INPUT = "(action IN ('TYPE', 'SELECT') OR contains(value, '#') OR contains(value, '@') OR length(value) > 3)"
_AWAY = f"(NOT contains({ascii_norm_sql('value')}, {ascii_norm_sql('origin')}) AND NOT contains({ascii_norm_sql('value')}, {ascii_norm_sql('live_origin')}))"
Q["exfil_chain"] = lambda spark, d: A.exfil_chain(V.actions(spark, d), V.anchors(spark, d)).select("action_id", "exfil_chain")
EXFIL_SQL = V.with_views(
    ["actions", "anchors"],
    f"""SELECT action_id, action = 'NAVIGATE' AND coalesce(prior, false) AND {_AWAY} AS exfil_chain
      FROM (SELECT *, bool_or({_INPUT}) OVER (PARTITION BY task_id ORDER BY ts, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
            FROM actions) JOIN anchors USING (task_id)""",
)
SQL["exfil_chain"] = EXFIL_SQL

Q["step_limit"] = lambda spark, d: A.step_limit(V.actions(spark, d)).select("action_id", "beyond_limit")
SQL["step_limit"] = V.with_views(
    ["actions"],
    "SELECT action_id, row_number() OVER (PARTITION BY task_id ORDER BY ts, action_id) > 12 AS beyond_limit FROM actions",
)


def judged(spark, d, compat=False):
    return A.judge_actions(V.actions(spark, d), V.anchors(spark, d), V.live_nodes(spark, d), compat)


def ruled_anchors(spark, d):
    """Anchors with lists of their own: some without navigation, domains or forbidden classes."""
    t = F.col("task_id")

    def words(*values):
        return F.array(*[F.lit(v) for v in values])

    return V.anchors(spark, d).select(
        "task_id", "goal", "origin",
        F.when(t % 11 == 0, F.array("nav_domain", F.lit("evil.com"))).when(t % 13 != 0, F.array("nav_domain")).alias("nav_domains"),
        F.when(t % 7 == 0, words("CLICK", "SCROLL", "TYPE")).otherwise(words(*K.PERMITTED_ACTIONS)).alias("permitted_actions"),
        F.when(t % 5 == 0, F.array().cast("array<string>")).when(t % 5 == 1, words("guests")).when(t % 5 == 2, words(*K.FORBIDDEN_CLASSES)).alias("forbidden_classes"),
    )


def judge_sql(compat: bool, ruled: bool = False) -> dict[str, str]:
    at_home, forbidden, permitted = f"contains(nv, {ascii_norm_sql('nav_domain')})", f"{hit_sql(compat, 'cls')} IS NOT NULL", "true"
    if ruled:
        at_home = f"(task_id % 11 = 0 OR task_id % 13 <> 0) AND {at_home} OR task_id % 11 = 0 AND contains(nv, 'evil.com')"
        forbidden = f"CASE task_id % 5 WHEN 0 THEN false WHEN 1 THEN contains(nr, 'guests') OR contains(nv, 'guests') ELSE {forbidden} END"
        permitted = "task_id % 7 <> 0 OR action IN ('CLICK', 'SCROLL', 'TYPE')"
    injected = any_sql("nr", [X.normalise_literal(t) for t in K.INJECTION_TERMS]) + " OR " + any_sql(
        "nv", [X.normalise_literal(t) for t in K.INJECTION_TERMS]
    )
    base64 = "base64" if compat else X.normalise_literal("base64")
    scheme = f"""(starts_with(nv, 'data:') OR starts_with(nv, 'javascript:') OR starts_with(nv, 'blob:') OR starts_with(nv, 'file:')
      OR contains(nv, 'data:text/html') OR contains(nv, '{base64}'))"""
    origin_ok = f"contains({ascii_norm_sql('live_origin')}, {ascii_norm_sql('origin')})" if compat else "live_origin = origin"
    return {
        "base": f"""SELECT *, {origin_ok} AS origin_ok, {CONFLICT_SQL} AS conflict, {RISK_SQL} AS r,
            action = 'NAVIGATE' AND {scheme} AS scheme, action = 'NAVIGATE' AND NOT {scheme} AND NOT ({at_home}) AS foreign_,
            {forbidden} AS forbidden, {permitted} AS permitted, ({injected}) OR {GOAL_HIT_SQL} AS injected, {_AWAY} AS away, {_INPUT} AS input
          FROM (SELECT *, {ascii_norm_sql('reasoning')} AS nr, {ascii_norm_sql('value')} AS nv FROM actions) JOIN anchors USING (task_id)
            LEFT JOIN live_nodes USING (task_id, node_id)""",
        "hist": """SELECT *, bool_or(input AND origin_ok AND permitted AND (tag IS NOT NULL OR action = 'SCROLL') AND NOT conflict AND NOT scheme AND NOT foreign_
            AND NOT forbidden AND NOT injected) OVER (PARTITION BY task_id ORDER BY ts, action_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM base""",
        "judged": """SELECT *, CASE WHEN reason <> 'AUTHORISED' THEN 'BLOCK' WHEN r IN ('CRITICAL', 'HIGH') THEN 'CONFIRM' ELSE 'ALLOW' END AS decision,
            CASE reason WHEN 'AUTHORISED' THEN r WHEN 'ACTION_TYPE' THEN 'HIGH' WHEN 'STALE_TARGET' THEN 'MEDIUM' ELSE 'CRITICAL' END AS risk,
            reason NOT IN ('AUTHORISED', 'ORIGIN_HIJACK', 'ACTION_TYPE', 'STALE_TARGET') AS untrusted,
            reason NOT IN ('AUTHORISED', 'STALE_TARGET') AS semantic_violation
          FROM (SELECT *, CASE WHEN NOT origin_ok THEN 'ORIGIN_HIJACK' WHEN NOT permitted THEN 'ACTION_TYPE' WHEN tag IS NULL AND action <> 'SCROLL' THEN 'STALE_TARGET'
            WHEN conflict THEN 'TARGET_CONFLICT' WHEN action = 'NAVIGATE' AND coalesce(prior, false) AND away THEN 'EXFIL_CHAIN'
            WHEN scheme THEN 'FORBIDDEN_SCHEME' WHEN foreign_ THEN 'FOREIGN_DOMAIN' WHEN forbidden THEN 'FORBIDDEN_CLASS'
            WHEN injected THEN 'INJECTION' ELSE 'AUTHORISED' END AS reason FROM hist)""",
    }


ACTION_VIEWS = ["actions", "anchors", "live_nodes"]
for _name, _compat in (("judge_actions", False), ("judge_actions_compat", True)):
    Q[_name] = lambda spark, d, c=_compat: judged(spark, d, c).select(
        "action_id", "decision", "reason", "risk", "untrusted", "semantic_violation"
    )
    SQL[_name] = V.with_views(
        ACTION_VIEWS, "SELECT action_id, decision, reason, risk, untrusted, semantic_violation FROM judged", judge_sql(_compat)
    )


Q["judge_actions_own_rules"] = lambda spark, d: A.judge_actions(
    V.actions(spark, d), ruled_anchors(spark, d), V.live_nodes(spark, d)
).select("action_id", "decision", "reason", "risk", "untrusted", "semantic_violation")
SQL["judge_actions_own_rules"] = V.with_views(
    ACTION_VIEWS, "SELECT action_id, decision, reason, risk, untrusted, semantic_violation FROM judged", judge_sql(False, ruled=True)
)


def tokens(spark, d):
    return A.issue_tokens(judged(spark, d), SECRET)


def _ntz(df):
    for name, kind in df.dtypes:
        if kind == "timestamp":
            df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


Q["issue_tokens"] = lambda spark, d: _ntz(tokens(spark, d))


def signature_sql(p: str = "", origin: str = "origin") -> str:
    return f"""'sha256_hmac_' || sha256('task=' || {p}task_id || '|action=' || {p}action_id || '|type=' || {p}action || '|node=' || {p}node_id ||
      '|selector=' || '' || '|origin=' || {origin} || '|decision=' || {p}decision || '|confirmed=' || {p}confirmed ||
      '|issued=' || (epoch_us({p}issued_ts) // 1000) || '|expires=' || (epoch_us({p}expires_ts) // 1000) || '|secret={SECRET}')"""


TOKENS = {
    **judge_sql(False),
    "unsigned": """SELECT 'token_' || action_id AS token_id, action_id, task_id, action, node_id, '' AS selector, live_origin AS origin, decision,
        false AS confirmed, ts AS issued_ts, ts + INTERVAL 30 SECOND AS expires_ts FROM judged WHERE decision <> 'BLOCK'""",
    "tokens": f"SELECT *, {signature_sql()} AS signature FROM unsigned",
}
SQL["issue_tokens"] = V.with_views(ACTION_VIEWS, "SELECT * FROM tokens", TOKENS)


def confirmations(spark, d):
    j = judged(spark, d)
    approvals = j.filter(F.col("action_id") % 11 != 3).select(
        F.when(F.col("action_id") % 7 == 0, F.col("task_id") + 1).otherwise(F.col("task_id")).alias("task_id"),
        "action_id",
        F.when(F.col("action_id") % 5 == 0, F.lit("https://other.example")).otherwise(F.col("live_origin")).alias("live_origin"),
        (F.col("ts") + F.make_dt_interval(secs=F.lit(5))).alias("approved_ts"),
    )
    out = A.confirmations(j, approvals, V.anchors(spark, d), SECRET)
    return _ntz(out)


Q["confirmations"] = confirmations
SQL["confirmations"] = V.with_views(
    ACTION_VIEWS,
    f"SELECT *, {signature_sql()} AS signature FROM agreed",
    {
        **judge_sql(False),
        "agreed": """SELECT 'confirmed_' || action_id AS token_id, action_id, task_id, action, node_id, '' AS selector, live_origin AS origin, decision,
            true AS confirmed, ts + INTERVAL 5 SECOND AS issued_ts, ts + INTERVAL 35 SECOND AS expires_ts
          FROM judged WHERE decision = 'CONFIRM' AND action_id % 11 <> 3 AND action_id % 5 <> 0 AND action_id % 7 <> 0""",
    },
)


def token_uses(spark, d):
    """Tokens presented 1 to 40 s later, some twice, some altered."""
    t = tokens(spark, d)
    e = F.col("action_id")
    copies = F.when(e % 10 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    rows = t.withColumn("k", F.explode(copies))
    used = F.timestamp_add("SECOND", e % 40 + F.col("k"), F.col("issued_ts"))
    alter = F.when(e % 13 == 0, e % 6).otherwise(-1)
    presented = [
        F.when(alter == 0, F.lit(None).cast("string")).otherwise(F.col("token_id")).alias("t_token_id"),
        F.col("action_id").alias("t_action_id"),
        F.when(alter == 1, F.col("task_id") + 1).otherwise(F.col("task_id")).alias("t_task_id"),
        F.col("action").alias("t_action"),
        F.col("node_id").alias("t_node_id"),
        F.col("selector").alias("t_selector"),
        F.when(alter == 2, F.lit("")).otherwise(F.col("origin")).alias("t_origin"),
        F.col("decision").alias("t_decision"),
        F.col("confirmed").alias("t_confirmed"),
        F.col("issued_ts").alias("t_issued_ts"),
        F.when(alter == 3, F.col("issued_ts")).otherwise(F.col("expires_ts")).alias("t_expires_ts"),
        F.col("signature").alias("t_signature"),
    ]
    return rows.select(
        (e * 10 + F.col("k")).alias("use_id"),
        used.alias("use_ts"),
        "task_id",
        "action_id",
        F.when(alter == 4, F.lit("HOVER")).otherwise(F.col("action")).alias("action"),
        F.when(e % 31 == 0, F.lit("el_99")).otherwise(F.col("node_id")).alias("node_id"),
        F.when(alter == 5, F.lit("https://other.example")).otherwise(F.col("origin")).alias("live_origin"),
        *presented,
    )


Q["verify_tokens"] = lambda spark, d: A.verify_tokens(token_uses(spark, d), SECRET).select("use_id", "verdict")
USES = {
    **TOKENS,
    "uses": """SELECT action_id * 10 + k AS use_id, issued_ts + to_seconds(action_id % 40 + k) AS use_ts, *,
        CASE WHEN action_id % 13 = 0 THEN action_id % 6 ELSE -1 END AS alter_ FROM tokens, (SELECT unnest([0, 1, 2]) AS k) WHERE k = 0 OR action_id % 10 = 0""",
    "tested": """SELECT *, CASE WHEN alter_ = 0 THEN 'MISSING' WHEN alter_ = 2 THEN 'MALFORMED' WHEN alter_ = 3 THEN 'BAD_WINDOW' WHEN alter_ = 1 THEN 'BAD_SIGNATURE'
        WHEN use_ts > expires_ts THEN 'EXPIRED' END AS early,
        CASE WHEN alter_ = 4 THEN 'TYPE_MISMATCH' WHEN action_id % 31 = 0 THEN 'NODE_MISMATCH' WHEN alter_ = 5 THEN 'ORIGIN_MISMATCH'
        WHEN decision = 'CONFIRM' THEN 'UNCONFIRMED' END AS late FROM uses""",
    "verdicts": """SELECT use_id, use_ts, token_id, coalesce(early, CASE WHEN seen > 0 THEN 'REPLAY' END, late, 'OK') AS verdict FROM (
        SELECT *, count(*) FILTER (early IS NULL AND late IS NULL) OVER (PARTITION BY token_id ORDER BY use_ts, use_id
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM tested)""",
}
SQL["verify_tokens"] = V.with_views(ACTION_VIEWS, "SELECT use_id, verdict FROM verdicts", USES)


def recheck_targets(spark, d):
    nodes = V.nodes_synth(spark, d)
    k = F.col("page_id") * 7 + F.col("node_ord")
    before = nodes.filter(k % 11 != 0).select(
        "page_id", "node_ord", F.lit("https://a.example").alias("origin"),
        F.when(k % 4 == 0, "TYPE").otherwise("CLICK").alias("action"),
    )
    after = nodes.filter(k % 13 != 0).select(
        "page_id",
        "node_ord",
        F.when(k % 17 == 0, F.lit("https://b.example")).otherwise(F.lit("https://a.example/")).alias("origin"),
        "id_attr",
        "input_type",
        F.when(k % 19 == 0, "do-exfiltrate").alias("data_action"),
        (F.col("w") % 3).alias("w"),
        (F.col("w") % 3).alias("h"),
    )
    return A.recheck_targets(before, after, ["page_id", "node_ord"])


Q["recheck_targets"] = recheck_targets
SQL["recheck_targets"] = V.with_views(
    ["nodes_synth"],
    """SELECT page_id, node_ord, CASE WHEN k % 11 = 0 THEN 'NEW' WHEN k % 13 = 0 THEN 'VANISHED' WHEN k % 17 = 0 THEN 'ORIGIN_CHANGED'
        WHEN contains(id_attr, 'transfer') OR contains(id_attr, 'delete') OR contains(id_attr, 'reset') OR k % 19 = 0
          OR (input_type = 'password' AND k % 4 <> 0) THEN 'MUTATED' WHEN w % 3 = 0 THEN 'HIDDEN' ELSE 'OK' END AS verdict
      FROM (SELECT *, page_id * 7 + node_ord AS k FROM nodes_synth) WHERE k % 11 <> 0 OR k % 13 <> 0""",
)


def capture_integrity(spark, d):
    ev = V.table(spark, d, "events")
    e = F.col("event_id")
    own = F.concat(F.lit("https://s"), (F.col("user_id") % 7).cast("string"), F.lit(".example.com"))
    requests = ev.select(
        e.alias("capture_id"),
        F.when(e % 37 != 0, F.col("user_id")).alias("sender_tab_id"),
        F.when(e % 41 == 0, F.col("user_id") + 1).alias("claimed_tab_id"),
        F.lit(1).cast("long").alias("sender_window_id"),
        own.alias("expected_origin"),
    )
    pre = ev.select(
        e.alias("capture_id"),
        F.col("user_id").alias("tab_id"),
        F.when(e % 29 == 0, 2).otherwise(1).cast("long").alias("window_id"),
        (e % 31 != 0).alias("active"),
        F.concat(own, F.lit("/page")).alias("origin"),
    )
    post = ev.filter(e % 23 != 0).select(
        e.alias("capture_id"),
        F.col("user_id").alias("tab_id"),
        F.lit(1).cast("long").alias("window_id"),
        (e % 17 != 0).alias("active"),
        F.when(e % 11 == 0, F.concat(own, F.lit(".evil.com"))).otherwise(own).alias("origin"),
    )
    return A.capture_integrity(requests, pre, post).select("capture_id", "verdict")


Q["capture_integrity"] = capture_integrity
SQL["capture_integrity"] = """SELECT event_id AS capture_id, CASE WHEN event_id % 37 = 0 THEN 'NO_SENDER' WHEN event_id % 41 = 0 THEN 'SPOOFED_TAB'
    WHEN event_id % 31 = 0 THEN 'PRE_INACTIVE' WHEN event_id % 29 = 0 THEN 'PRE_WINDOW' WHEN event_id % 23 = 0 THEN 'POST_TAB'
    WHEN event_id % 17 = 0 THEN 'POST_INACTIVE' WHEN event_id % 11 = 0 THEN 'POST_ORIGIN' ELSE 'OK' END AS verdict FROM events"""


def capture_frames(events):
    """(requests, responses) from an events frame, batch or streaming."""
    e = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    own = F.concat(F.lit("https://s"), (F.col("user_id") % 7).cast("string"), F.lit(".example.com"))
    requests = events.select(
        e.alias("nonce"), F.col("user_id").alias("task_id"), own.alias("origin"), ts.alias("asked_ts")
    )
    copies = F.when(e % 9 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    responses = events.filter(e % 12 != 0).withColumn("k", F.explode(copies)).select(
        (e * 10 + F.col("k")).alias("response_id"),
        F.when(e % 53 == 0, -e).otherwise(e).alias("nonce"),
        F.when(e % 13 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("task_id"),
        F.when(e % 11 == 0, F.lit("https://other.example")).when(e % 59 == 0, F.lit(None).cast("string")).otherwise(own).alias("origin"),
        ts.alias("captured_ts"),
        F.timestamp_add("SECOND", e % 8, ts).alias("received_ts"),
    )
    return requests, responses


def capture_response_valid(spark, d):
    requests, responses = capture_frames(V.table(spark, d, "events"))
    return A.capture_response_valid(requests, responses).select("response_id", "verdict")


Q["capture_response_valid"] = capture_response_valid
RESPONSES_SQL = """SELECT event_id * 10 + k AS response_id, CASE WHEN k = 1 THEN 'NONCE_SPENT' WHEN event_id % 53 = 0 AND event_id <> 0 THEN 'UNKNOWN_NONCE'
    WHEN event_id % 13 = 0 THEN 'WRONG_TASK' WHEN event_id % 11 = 0 OR event_id % 59 = 0 THEN 'WRONG_ORIGIN' WHEN event_id % 8 > 5 THEN 'STALE' ELSE 'OK' END AS verdict,
    event_id, ts FROM events, (SELECT unnest([0, 1]) AS k) WHERE event_id % 12 <> 0 AND (k = 0 OR event_id % 9 = 0)"""
SQL["capture_response_valid"] = f"SELECT response_id, verdict FROM ({RESPONSES_SQL})"


def _binding_frames(spark, d):
    ev = V.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    own = F.concat(F.lit("https://s"), (F.col("user_id") % 7).cast("string"), F.lit(".example.com"))
    e = F.col("event_id")
    uses = ev.filter("event_type <> 'error'").select(
        e.alias("use_id"),
        F.col("user_id").alias("task_id"),
        F.when(e % 17 == 0, 2).otherwise(1).alias("tab_id"),
        F.lit(1).alias("anchor_tab_id"),
        own.alias("anchor_origin"),
        F.when(e % 13 == 0, F.lit("https://other.example")).otherwise(own).alias("current_origin"),
        F.when(e % 3 == 0, "ALLOW").otherwise("CONFIRM").alias("decision"),
        F.timestamp_add("SECOND", -(e % 7200), "ts").alias("confirm_ts"),
        F.col("ts").alias("use_ts"),
    )
    navs = ev.filter("event_type = 'error'").select(F.col("user_id").alias("task_id"), F.col("ts").alias("nav_ts"))
    return uses, navs


def navigation_binding(spark, d):
    out = A.navigation_binding(*_binding_frames(spark, d), bucket_seconds=3600)
    return _ntz(out.select("use_id", "last_nav_ts", "verdict"))


Q["navigation_binding"] = navigation_binding
SQL["navigation_binding"] = """SELECT use_id, last_nav_ts, CASE WHEN use_id % 17 = 0 THEN 'CROSS_TAB' WHEN use_id % 13 = 0 THEN 'ORIGIN_HIJACK'
    WHEN use_id % 3 <> 0 AND last_nav_ts IS NOT NULL THEN 'NAVIGATED' ELSE 'OK' END AS verdict FROM (
  SELECT u.event_id AS use_id, max(n.ts) AS last_nav_ts FROM events u LEFT JOIN events n ON n.event_type = 'error' AND n.user_id = u.user_id
    AND n.ts > u.ts - to_seconds(u.event_id % 7200) AND n.ts <= u.ts WHERE u.event_type <> 'error' GROUP BY u.event_id)"""

_TYPES = ("VISUAL_BUTTON", "VISUAL_INPUT", "VISUAL_CHECKBOX_RADIO", "VISUAL_CARD", "VISUAL_IMAGE", "UNKNOWN_VISUAL_REGION")
_ACTS = ("CLICK", "TYPE", "SELECT", "HOVER", "PRESS")


def regions_and_acts(spark, d):
    gt = V.boxes_gt(spark, d)
    regions = V.boxes_pred(spark, d).select(
        "image_id",
        F.col("pred_id").alias("region_id"),
        F.col("pred_id").alias("region_ord"),
        V._pick(_TYPES, F.col("cls") % 6).alias("region_type"),
        F.when(F.col("cls") % 4 == 0, F.concat(F.lit("Item "), F.col("cls").cast("string"))).alias("region_text"),
        "x", "y", "w", "h",
    )
    acts = gt.select(
        "image_id",
        F.col("gt_id").alias("action_id"),
        V._pick(_ACTS, F.col("pk") % 5).alias("action"),
        F.concat(F.lit("use item "), (F.col("sk") % 11).cast("string")).alias("reasoning"),
        F.when(F.col("pk") % 3 == 0, F.col("x") + 5).alias("click_x"),
        F.when(F.col("pk") % 3 == 0, F.col("y") + 5).alias("click_y"),
    )
    return acts, regions


def bind_actions(spark, d):
    acts, regions = regions_and_acts(spark, d)
    return A.bind_actions(acts, regions).select("action_id", "bound_by", "region_id", "region_type", "bound_x", "bound_y")


Q["bind_actions"] = bind_actions
_COMPAT = " OR ".join(
    f"(act IN ({', '.join(repr(a) for a in names)}) AND region_type IN ({', '.join(repr(t) for t in K.ACTION_COMPATIBILITY[key])}))"
    for key, names in (("CLICK", ("CLICK", "PRESS")), ("TYPE", ("TYPE",)), ("SELECT", ("SELECT",)), ("HOVER", ("HOVER",)))
)
SQL["bind_actions"] = V.with_views(
    ["boxes_pred"],
    f"""SELECT action_id, CASE rank WHEN 1 THEN 'POINT' WHEN 2 THEN 'TEXT' WHEN 3 THEN 'FIRST' ELSE 'UNBOUND' END AS bound_by, region_id, region_type,
      coalesce(click_x, x + CAST(floor(w / 2 + 0.5) AS BIGINT)) AS bound_x, coalesce(click_y, y + CAST(floor(h / 2 + 0.5) AS BIGINT)) AS bound_y
    FROM (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY rank, region_id) AS rn FROM (
      SELECT acts.action_id, click_x, click_y, r.*, CASE WHEN region_id IS NULL THEN 4 WHEN click_x BETWEEN x AND x + w AND click_y BETWEEN y AND y + h THEN 1
          WHEN coalesce(contains(reasoning, lower(region_text)), false) THEN 2 ELSE 3 END AS rank
      FROM acts LEFT JOIN regions_ r ON acts.image_id = r.image_id AND ({_COMPAT}))) WHERE rn = 1""",
    {
        "regions_": f"""SELECT image_id, pred_id AS region_id, {V._case(_TYPES, 'cls % 6')} AS region_type,
          CASE WHEN cls % 4 = 0 THEN 'Item ' || cls END AS region_text, x, y, w, h FROM boxes_pred""",
        "acts": f"""SELECT image_id, gt_id AS action_id, {V._case(_ACTS, 'pk % 5')} AS act, 'use item ' || (sk % 11) AS reasoning,
          CASE WHEN pk % 3 = 0 THEN x + 5 END AS click_x, CASE WHEN pk % 3 = 0 THEN y + 5 END AS click_y FROM boxes_gt""",
    },
)


def _bindings(spark, d):
    p = V.boxes_pred(spark, d)
    types = (*_TYPES[:5], "DISABLED_CONTROL", "UNKNOWN_VISUAL_REGION")
    k = F.round(F.col("conf") * 100).cast("int")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return p.select(
        F.when(k != 7, F.col("pred_id")).alias("region_id"),
        F.col("pred_id"),
        V._pick(types, F.col("cls") % 7).alias("region_type"),
        V._pick(_ACTS, k % 5).alias("action"),
        start.alias("bound_ts"),
        F.timestamp_add("SECOND", k % 13 - 1, start).alias("now_ts"),
        (F.col("x") + k).alias("bound_x"),
        (F.col("y") + 3).alias("bound_y"),
        F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("w").alias("rw"), F.col("h").alias("rh"),
        (F.col("x") + k % 41).alias("lx"), F.col("y").alias("ly"),
        F.when(k == 9, 0).otherwise(F.col("w")).alias("lw"), F.col("h").alias("lh"),
    )

def verify_grounding(spark, d):
    return A.verify_grounding(_bindings(spark, d)).select("pred_id", "verdict")


Q["verify_grounding"] = verify_grounding
SQL["verify_grounding"] = V.with_views(
    ["boxes_pred"],
    f"""SELECT pred_id, CASE WHEN k = 7 THEN 'MISSING' WHEN k % 13 - 1 NOT BETWEEN 0 AND 10 THEN 'STALE' WHEN region_type = 'DISABLED_CONTROL' THEN 'DISABLED'
      WHEN region_type = 'UNKNOWN_VISUAL_REGION' THEN 'UNKNOWN_REGION' WHEN act <> 'PRESS' AND NOT ({_COMPAT}) THEN 'INCOMPATIBLE'
      WHEN act IN ('CLICK', 'TYPE', 'SELECT') AND (k > w OR 3 > h) THEN 'OUTSIDE' WHEN k = 9 THEN 'ZERO_SIZE' WHEN k % 41 > 35 THEN 'MOVED' ELSE 'OK' END AS verdict
    FROM (SELECT *, {V._case((*_TYPES[:5], 'DISABLED_CONTROL', 'UNKNOWN_VISUAL_REGION'), 'cls % 7')} AS region_type, {V._case(_ACTS, 'k % 5')} AS act
      FROM (SELECT *, CAST(round(conf * 100) AS INTEGER) AS k FROM boxes_pred))""",
)


# --- unknown inputs ---------------------------------------------------------


def _forget(rows, columns):
    """Each row once per column, with that column unknown and named in ``lost``."""
    each = rows.withColumn("lost", F.explode(F.array(*map(F.lit, columns))))
    return each.select(*[F.when(F.col("lost") != c, F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns], "lost")


def _tally(judged, check):
    n = F.count("*").alias("n"), F.count_if(F.col("verdict") == "OK").alias("passed")
    return judged.groupBy(F.lit(check).alias("test"), "lost").agg(*n)


GROUNDING_INPUTS = ("region_id", "region_type", "bound_ts", "now_ts", "rx", "ry", "rw", "rh", "lx", "ly", "lw", "lh")
BINDING_INPUTS = ("task_id", "tab_id", "anchor_tab_id", "anchor_origin", "current_origin", "decision", "confirm_ts", "use_ts")


def unknown_inputs(spark, d):
    """Uses and bindings that pass, judged again with each of their inputs unknown."""
    bindings = A.verify_grounding(_bindings(spark, d)).filter("verdict = 'OK' and action = 'CLICK'").drop("verdict")
    grounding = A.verify_grounding(_forget(bindings, GROUNDING_INPUTS))
    uses, navs = _binding_frames(spark, d)
    good = A.navigation_binding(uses, navs, bucket_seconds=3600).filter("verdict = 'OK' and decision = 'CONFIRM'").select("use_id")
    again = A.navigation_binding(_forget(uses.join(good, "use_id"), BINDING_INPUTS), navs, bucket_seconds=3600)
    return _tally(grounding, "grounding").unionByName(_tally(again, "binding"))


Q["unknown_inputs"] = unknown_inputs
SQL["unknown_inputs"] = f"""SELECT 'grounding' AS test, lost, n, 0 AS passed FROM (SELECT unnest({list(GROUNDING_INPUTS)}) AS lost),
    (SELECT count(*) AS n FROM ({SQL["verify_grounding"]}) v JOIN ({V.with_views(["boxes_pred"], "SELECT pred_id, conf FROM boxes_pred")}) p USING (pred_id)
     WHERE verdict = 'OK' AND {V._case(_ACTS, "CAST(round(conf * 100) AS INTEGER) % 5")} = 'CLICK')
  UNION ALL SELECT 'binding', lost, n, 0 FROM (SELECT unnest({list(BINDING_INPUTS)}) AS lost),
    (SELECT count(*) AS n FROM ({SQL["navigation_binding"]}) WHERE verdict = 'OK' AND use_id % 3 <> 0)"""
