"""Origin rules, judgement of action logs, authorisation tokens, captures, grounding."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain import constants as K
from veilgrain.functions import boxes as B
from veilgrain.functions import text as X
from veilgrain.operators import screen
from veilgrain.operators.geometry import met_in_image, split_crowded


# --- origins ----------------------------------------------------------------


def origin_match(a: Column, b: Column, mode: str = "strict") -> Column:
    """Equality of normalised origins; an invalid one never matches.

    ``lenient`` is the looser test of the decision path: the live origin may
    merely contain the expected one after text normalisation.
    """
    if mode == "lenient":
        na, nb = X.normalise_text(a), X.normalise_text(b)
        return (na == nb) | F.contains(na, nb)
    return F.coalesce(X.normalise_origin(a) == X.normalise_origin(b), F.lit(False))


def domain_allowed(actions: DataFrame, anchors: DataFrame, mode: str = "lenient", domain: str = "nav_domain") -> DataFrame:
    """NAVIGATE values must contain (or, strictly, be of) an allowed domain.

    ``domain`` is a string or array column of the anchors.
    """
    allow = F.col(domain)
    if dict(anchors.dtypes)[domain] == "string":
        allow = F.array(allow)
    if mode == "strict":
        allowed = F.transform(allow, X.normalise_origin)
        value = X.normalise_origin(F.col("value"))
        test = F.coalesce(F.array_contains(F.col("_allow"), value), F.lit(False))
    else:
        # Python is not allowed inside a lambda; domain names are folded without NFKD.
        allowed = F.transform(allow, X.fold_lookalikes)
        value = X.normalise_text(F.col("value"))
        test = F.exists("_allow", lambda a: F.contains(F.col("_nav"), a))
    rules = anchors.select("task_id", allowed.alias("_allow"))
    joined = actions.withColumn("_nav", value).join(rules, "task_id", "left")
    ok = F.when(F.col("action") == "NAVIGATE", F.coalesce(test, F.lit(False))).otherwise(F.lit(True))
    return joined.withColumn("domain_allowed", ok).drop("_allow", "_nav")


# --- risk and targets -------------------------------------------------------


def _low(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit("")))


def risk_level(has_target: Column) -> Column:
    kind, ident, name = _low("input_type"), _low("id_attr"), _low("name_attr")
    critical = (
        (kind == "password")
        | ident.contains("card")
        | name.contains("card")
        | ident.contains("pay")
        | ident.contains("delete")
        | ident.contains("reset")
    )
    high = (_low("tag") == "button") & ((kind == "submit") | ident.contains("book"))
    return (
        F.when(F.col("action").isin("SCROLL", "HOVER", "WAIT"), "LOW")
        .when(has_target & critical, "CRITICAL")
        .when(has_target & high, "HIGH")
        .otherwise("MEDIUM")
    )


def with_risk(actions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Risk of each action given its target node."""
    known = nodes.withColumn("_hit", F.lit(True))
    joined = actions.join(known, ["task_id", "node_id"], "left")
    return joined.withColumn("risk", risk_level(F.coalesce("_hit", F.lit(False)))).select(
        *actions.columns, "risk"
    )


def _conflict(goal: Column, action: Column, ident: Column, kind: Column) -> Column:
    sensitive = (
        ident.contains("delete") | ident.contains("reset") | ident.contains("transfer") | (kind == "password")
    )
    return sensitive & (goal == "flight_booking") & (action != "TYPE")


def target_conflict(actions: DataFrame, anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """Destructive or password targets under a booking goal, unless typed into."""
    joined = actions.join(anchors.select("task_id", "goal"), "task_id", "left").join(
        nodes.select("task_id", "node_id", "id_attr", "input_type"), ["task_id", "node_id"], "left"
    )
    hit = _conflict(
        F.col("goal"),
        F.col("action"),
        X.normalise_text(F.col("id_attr")),
        X.normalise_text(F.col("input_type")),
    )
    return joined.withColumn("target_conflict", F.coalesce(hit, F.lit(False))).select(
        *actions.columns, "target_conflict"
    )


# --- chains and limits ------------------------------------------------------


def carries_input(action: Column, value: Column) -> Column:
    """An action that puts data into a page, or names a token, address or longer value."""
    return action.isin("TYPE", "SELECT") | (
        (value != "") & (value.contains("#") | value.contains("@") | (F.length(value) > 3))
    )


def exfil_chain(actions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Navigation away from the task's origin after any earlier input of the task.

    "Any earlier input" is the same as "later than the first one", so a
    map-side combined ``min`` per task replaces a window over whole tasks.
    """
    tagged = actions.withColumn("_at", F.struct("ts", "action_id"))
    first = (
        tagged.filter(carries_input(F.col("action"), F.col("value")))
        .groupBy("task_id")
        .agg(F.min("_at").alias("_first"))
    )
    rules = anchors.select("task_id", X.normalise_text(F.col("origin")).alias("_origin"))
    joined = (
        tagged.withColumn("_nav", X.normalise_text(F.col("value")))
        .withColumn("_live", X.normalise_text(F.col("live_origin")))
        .join(first, "task_id", "left")
        .join(rules, "task_id", "left")
    )
    away = ~F.contains(F.col("_nav"), F.col("_origin")) & ~F.contains(F.col("_nav"), F.col("_live"))
    hit = (F.col("action") == "NAVIGATE") & (F.col("_at") > F.col("_first")) & away
    return joined.withColumn("exfil_chain", F.coalesce(hit, F.lit(False))).select(
        *actions.columns, "exfil_chain"
    )


def step_limit(actions: DataFrame, limit: int = K.MAX_STEPS) -> DataFrame:
    """Actions beyond the allowed number of steps of their task.

    Only the last allowed step of each task is needed. Filtering on the rank
    lets Spark cut every partition to ``limit`` rows per task before the
    shuffle, and the comparison itself is an ordinary join.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("task_id").orderBy("ts", "action_id")
    ranked = actions.select("task_id", "ts", "action_id", F.row_number().over(order).alias("_n"))
    last = ranked.filter(F.col("_n") <= limit).groupBy("task_id").agg(
        F.max(F.struct("ts", "action_id")).alias("_last"), F.count("*").alias("_kept")
    )
    joined = actions.join(last, "task_id")
    beyond = (F.col("_kept") == limit) & (F.struct("ts", "action_id") > F.col("_last"))
    return joined.withColumn("beyond_limit", beyond).select(*actions.columns, "beyond_limit")


# --- the verdict ------------------------------------------------------------


def judge_actions(actions: DataFrame, anchors: DataFrame, nodes: DataFrame, compat: bool = False) -> DataFrame:
    """BLOCK / CONFIRM / ALLOW with reason code and risk for each proposed action.

    The tests run in order and the first failing one names the reason; among the
    semantic ones the most specific (last) wins. Only approved actions count as
    history of a task: everything but the chain test is decided first, the
    earliest approved input per task is a map-side combined ``min``, and the
    chain test is a comparison with it.

    A task's own rules apply where the anchors carry them, as arrays:
    ``permitted_actions`` and ``nav_domains`` (NULL allows nothing) and
    ``forbidden_classes`` (NULL forbids all known ones). Anchors without these
    columns get the general lists and the one ``nav_domain``.
    """
    domains = F.col("nav_domains") if "nav_domains" in anchors.columns else F.array("nav_domain")
    permitted = F.array(*[F.lit(a) for a in K.PERMITTED_ACTIONS])
    general = F.array(*[F.lit(c) for c in K.FORBIDDEN_CLASSES])
    own_classes = "forbidden_classes" in anchors.columns
    rules = anchors.select(
        "task_id",
        F.lit(True).alias("_task"),
        F.col("goal").alias("_goal"),
        F.col("origin").alias("_origin"),
        X.normalise_text(F.col("origin")).alias("_norigin"),
        # Python is not allowed inside a lambda; domain names are folded without NFKD.
        F.transform(domains, X.fold_lookalikes).alias("_domains"),
        (F.col("permitted_actions") if "permitted_actions" in anchors.columns else permitted).alias("_permitted"),
        (F.coalesce("forbidden_classes", general) if own_classes else general).alias("_classes"),
    )
    live = nodes.select(
        "task_id", "node_id", "tag", "name_attr", "id_attr", "input_type", F.lit(True).alias("_node")
    )
    base = (
        screen.with_normalised(actions)
        .withColumn("_live", X.normalise_text(F.col("live_origin")))
        .join(rules, "task_id", "left")
        .join(live, ["task_id", "node_id"], "left")
    )
    nav = F.col("action") == "NAVIGATE"
    has_node = F.coalesce("_node", F.lit(False))
    if compat:
        origin_ok = F.contains(F.col("_live"), F.col("_norigin"))
    else:
        origin_ok = origin_match(F.col("live_origin"), F.col("_origin"))
    keywords = [X.normalise_literal(t) for t in K.INJECTION_TERMS]
    injected = (
        X.contains_any(F.col("_reason"), keywords)
        | X.contains_any(F.col("_value"), keywords)
        | screen.goal_rule_hit(F.col("_goal"), F.col("_reason"), F.col("_value"))
    )
    pairs = screen.class_terms(compat)
    if own_classes:
        forbidden = screen.forbidden_hit(F.col("_reason"), F.col("_value"), pairs, F.col("_classes")).isNotNull() | F.exists(
            F.transform("_classes", X.fold_lookalikes),
            lambda c: F.contains(F.col("_reason"), c) | F.contains(F.col("_value"), c),
        )
    else:
        forbidden = screen.forbidden_any(F.col("_reason"), F.col("_value"), pairs)
    scheme = nav & screen.scheme_hit(F.col("_value"), compat)
    # A task without an allowed domain may go nowhere.
    at_home = F.coalesce(F.exists("_domains", lambda a: (a != "") & F.contains(F.col("_value"), a)), F.lit(False))
    foreign = nav & ~screen.scheme_hit(F.col("_value"), compat) & ~at_home
    conflict = has_node & _conflict(
        F.col("_goal"),
        F.col("action"),
        X.fold_lookalikes(F.coalesce("id_attr", F.lit(""))),
        X.fold_lookalikes(F.coalesce("input_type", F.lit(""))),
    )
    hard = (
        F.when(F.col("_task").isNull(), "TASK_MISMATCH")
        .when(~F.coalesce(origin_ok, F.lit(False)), "ORIGIN_HIJACK")
        .when(~F.coalesce(F.array_contains("_permitted", F.col("action")), F.lit(False)), "ACTION_TYPE")
        .when(~has_node & ~F.col("action").isin("WAIT", "SCROLL"), "STALE_TARGET")
    )
    soft = (
        F.when(conflict, "TARGET_CONFLICT")
        .when(scheme, "FORBIDDEN_SCHEME")
        .when(foreign, "FOREIGN_DOMAIN")
        .when(forbidden, "FORBIDDEN_CLASS")
    )
    marked = (
        base.withColumn("_hard", hard)
        .withColumn("_soft", soft)
        .withColumn("_injected", injected)
        .withColumn("_at", F.struct("ts", "action_id"))
        .withColumn("_risk", risk_level(has_node))
    )
    approved = F.col("_hard").isNull() & F.col("_soft").isNull() & ~F.col("_injected")
    first = (
        marked.filter(approved & carries_input(F.col("action"), F.col("value")))
        .groupBy("task_id")
        .agg(F.min("_at").alias("_first"))
    )
    away = ~F.contains(F.col("_value"), F.col("_norigin")) & ~F.contains(F.col("_value"), F.col("_live"))
    chain = F.coalesce(nav & (F.col("_at") > F.col("_first")) & away, F.lit(False))
    # Of the semantic tests the later one names the reason; the target comes last.
    semantic = (
        F.when(F.col("_soft") == "TARGET_CONFLICT", "TARGET_CONFLICT")
        .when(chain, "EXFIL_CHAIN")
        .otherwise(F.col("_soft"))
    )
    judged = (
        marked.join(first, "task_id", "left")
        .withColumn("_semantic", semantic)
        .withColumn("_block", F.coalesce("_hard", "_semantic", F.when(F.col("_injected"), "INJECTION")))
        .withColumn("_untrusted", F.col("_hard").isNull() & F.col("_block").isNotNull())
    )
    block = F.col("_block")
    decision = (
        F.when(block.isNotNull(), "BLOCK")
        .when(F.col("_risk").isin("CRITICAL", "HIGH"), "CONFIRM")
        .otherwise("ALLOW")
    )
    risk = (
        F.when(block.isNull(), F.col("_risk"))
        .when(block == "ACTION_TYPE", "HIGH")
        .when(block == "STALE_TARGET", "MEDIUM")
        .otherwise("CRITICAL")
    )
    return judged.select(
        *actions.columns,
        decision.alias("decision"),
        F.coalesce(block, F.lit("AUTHORISED")).alias("reason"),
        risk.alias("risk"),
        F.col("_untrusted").alias("untrusted"),
        (block.isNotNull() & (block != "STALE_TARGET")).alias("semantic_violation"),
    )


# --- authorisation tokens ---------------------------------------------------


def token_signature(secret: str, origin: Column, p: str = "") -> Column:
    """Keyed SHA-256 over the token's fields in their fixed order and format."""
    fields = (
        ("task=", F.col(f"{p}task_id").cast("string")),
        ("|action=", F.col(f"{p}action_id").cast("string")),
        ("|type=", F.col(f"{p}action")),
        ("|node=", F.coalesce(F.col(f"{p}node_id"), F.lit(""))),
        ("|selector=", F.coalesce(F.col(f"{p}selector"), F.lit(""))),
        ("|origin=", F.coalesce(origin, F.lit(""))),
        ("|decision=", F.col(f"{p}decision")),
        ("|confirmed=", F.col(f"{p}confirmed").cast("string")),
        ("|issued=", F.unix_millis(f"{p}issued_ts").cast("string")),
        ("|expires=", F.unix_millis(f"{p}expires_ts").cast("string")),
    )
    parts = [part for name, value in fields for part in (F.lit(name), value)]
    return F.concat(F.lit(K.SIGNATURE_PREFIX), F.sha2(F.concat(*parts, F.lit(f"|secret={secret}")), 256))


TOKEN_COLUMNS = (
    "token_id", "action_id", "task_id", "action", "node_id", "selector", "origin", "decision",
    "confirmed", "issued_ts", "expires_ts", "signature",
)


def issue_tokens(
    judged: DataFrame, secret: str, origin: str = "live_origin", issued: str = "ts", confirmed: bool = False
) -> DataFrame:
    """A signed token, good for 30 seconds, per allowed or confirmable action.

    The F1 origin is signed; signing the look-alike-folded one would make ports
    unusable.
    """
    rows = judged.filter(F.col("decision").isin("ALLOW", "CONFIRM"))
    if "selector" not in rows.columns:
        rows = rows.withColumn("selector", F.lit(""))
    rows = (
        rows.withColumn("origin", X.normalise_origin(F.col(origin)))
        .withColumn("confirmed", F.lit(confirmed))
        .withColumn("issued_ts", F.col(issued))
        .withColumn("expires_ts", F.col(issued) + F.make_dt_interval(secs=F.lit(K.AUTH_TTL_SECONDS)))
        .withColumn(
            "token_id",
            F.concat(F.lit("confirmed_" if confirmed else "token_"), F.col("action_id").cast("string")),
        )
    )
    return rows.withColumn("signature", token_signature(secret, F.col("origin"))).select(*TOKEN_COLUMNS)


def confirmations(judged: DataFrame, approvals: DataFrame, anchors: DataFrame, secret: str) -> DataFrame:
    """Confirmed tokens for CONFIRM actions a user approved from the right origin."""
    said = approvals.select("task_id", "action_id", F.col("live_origin").alias("_from"), "approved_ts")
    rules = anchors.select("task_id", F.col("origin").alias("_anchor"))
    agreed = (
        judged.filter(F.col("decision") == "CONFIRM")
        .join(said, ["task_id", "action_id"])
        .join(rules, "task_id")
        .filter(origin_match(F.col("_from"), F.col("_anchor")))
    )
    return issue_tokens(agreed, secret, origin="_from", issued="approved_ts", confirmed=True)


def verify_tokens(uses: DataFrame, secret: str) -> DataFrame:
    """Ordered verdict for each presented token.

    A use carries ``use_id, use_ts``, the presented token as ``t_*`` columns, and
    the action as ``task_id, action_id, action, node_id, live_origin``. Replay
    comes after every other test, because only a valid use consumes a token: the
    first valid use per token is a map-side combined ``min``.
    """
    t = {c: F.col(f"t_{c}") for c in TOKEN_COLUMNS}
    fields = ("action_id", "task_id", "action", "origin", "decision", "confirmed", "signature", "issued_ts", "expires_ts")
    required = [t[c] for c in fields]
    malformed = F.lit(False)
    for column in required:
        malformed = malformed | column.isNull() | (column.cast("string") == "")
    # What must be true; an unknown answer fails like a wrong one.
    demands = (
        ("MISSING", t["token_id"].isNotNull()),
        ("MALFORMED", ~malformed),
        ("BAD_WINDOW", t["expires_ts"] > t["issued_ts"]),
        ("BAD_SIGNATURE", t["signature"].eqNullSafe(token_signature(secret, X.normalise_origin(t["origin"]), "t_"))),
        ("EXPIRED", F.col("use_ts") <= t["expires_ts"]),
        ("TASK_MISMATCH", t["task_id"].eqNullSafe(F.col("task_id"))),
        ("ACTION_MISMATCH", t["action_id"].eqNullSafe(F.col("action_id"))),
        ("TYPE_MISMATCH", t["action"].eqNullSafe(F.col("action"))),
        ("NODE_MISMATCH", F.coalesce(t["node_id"], F.lit("")).eqNullSafe(F.coalesce("node_id", F.lit("")))),
        ("ORIGIN_MISMATCH", origin_match(F.col("live_origin"), t["origin"])),
        ("UNCONFIRMED", (t["decision"] != "CONFIRM") | t["confirmed"]),
    )
    chain = None
    for name, demand in demands:
        fails = ~F.coalesce(demand, F.lit(False))
        chain = F.when(fails, name) if chain is None else chain.when(fails, name)
    tested = uses.withColumn("_fault", chain)
    first = (
        tested.filter(F.col("_fault").isNull())
        .groupBy("t_token_id")
        .agg(F.min(F.struct("use_ts", "use_id")).alias("_first"))
    )
    # Early tests outrank replay, the binding tests do not.
    early = ("MISSING", "MALFORMED", "BAD_WINDOW", "BAD_SIGNATURE", "EXPIRED")
    joined = tested.join(first, "t_token_id", "left")
    replay = F.coalesce(F.struct("use_ts", "use_id") > F.col("_first"), F.lit(False))
    verdict = (
        F.when(F.col("_fault").isin(*early), F.col("_fault"))
        .when(replay, "REPLAY")
        .otherwise(F.coalesce("_fault", F.lit("OK")))
    )
    return joined.withColumn("verdict", verdict).drop("_fault", "_first")


def _first_failing(*demands: tuple[str, Column]) -> Column:
    """The name of the first demand that is not plainly true; an unknown answer fails like a wrong one."""
    chain = F
    for name, demand in demands:
        chain = chain.when(~F.coalesce(demand, F.lit(False)), name)
    return chain.otherwise("OK")


# --- page and capture integrity ---------------------------------------------


def recheck_targets(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What became of each approved target between two snapshots of the page.

    What is not known counts against the target: an approval without an action is
    void, and a target without both sizes is hidden. An attribute that is null is one
    that the element does not have.
    """
    old = before.select(*keys, F.col("origin").alias("_o"), F.col("action").alias("_action"), F.lit(True).alias("_was"))
    new = after.select(
        *keys,
        F.col("origin").alias("_no"),
        _low("id_attr").alias("_id"),
        _low("input_type").alias("_type"),
        _low("data_action").alias("_data"),
        "w",
        "h",
        F.lit(True).alias("_is"),
    )
    joined = old.join(new, keys, "full_outer")
    mutated = (
        F.col("_id").contains("transfer")
        | F.col("_id").contains("delete")
        | F.col("_id").contains("reset")
        | F.col("_data").contains("exfiltrate")
        | ((F.col("_type") == "password") & ~F.col("_action").eqNullSafe("TYPE"))
    )
    sized = F.col("w").isNotNull() & F.col("h").isNotNull() & ((F.col("w") != 0) | (F.col("h") != 0))
    seen = sized | (F.col("_action") == "WAIT")
    verdict = (
        F.when(F.col("_was").isNull(), "NEW")
        .when(F.col("_is").isNull(), "VANISHED")
        .when(~origin_match(F.col("_no"), F.col("_o")), "ORIGIN_CHANGED")
        .when(mutated, "MUTATED")
        .when(F.col("_action").isNull(), "UNKNOWN_ACTION")
        .when(~F.coalesce(seen, F.lit(False)), "HIDDEN")
        .otherwise("OK")
    )
    return joined.select(*keys, verdict.alias("verdict"))


def capture_integrity(requests: DataFrame, pre: DataFrame, post: DataFrame) -> DataFrame:
    """The tab must be the same, active and on its origin before and after a capture."""

    def side(df, p):
        return df.select("capture_id", *[F.col(c).alias(f"_{p}_{c}") for c in ("tab_id", "window_id", "active", "origin")])

    joined = requests.join(side(pre, "pre"), "capture_id", "left").join(side(post, "post"), "capture_id", "left")
    has_origin = F.col("expected_origin").isNotNull() & (F.col("expected_origin") != "")

    def wrong_origin(p):
        return has_origin & ~origin_match(F.col(f"_{p}_origin"), F.col("expected_origin"))

    def wrong_window(p):
        return F.col("sender_window_id").isNotNull() & ~F.col(f"_{p}_window_id").eqNullSafe(F.col("sender_window_id"))

    verdict = (
        F.when(F.col("sender_tab_id").isNull(), "NO_SENDER")
        .when(F.col("claimed_tab_id").isNotNull() & (F.col("claimed_tab_id") != F.col("sender_tab_id")), "SPOOFED_TAB")
        .when(~F.col("_pre_tab_id").eqNullSafe(F.col("sender_tab_id")), "PRE_TAB")
        .when(~F.coalesce("_pre_active", F.lit(False)), "PRE_INACTIVE")
        .when(wrong_window("pre"), "PRE_WINDOW")
        .when(wrong_origin("pre"), "PRE_ORIGIN")
        .when(~F.col("_post_tab_id").eqNullSafe(F.col("sender_tab_id")), "POST_TAB")
        .when(~F.coalesce("_post_active", F.lit(False)), "POST_INACTIVE")
        .when(wrong_window("post"), "POST_WINDOW")
        .when(wrong_origin("post"), "POST_ORIGIN")
        .otherwise("OK")
    )
    return joined.withColumn("verdict", verdict).select(*requests.columns, "verdict")


def response_fault(max_age_ms: int = K.CAPTURE_MAX_AGE_MS, compat: bool = False) -> Column:
    """First fault of a response joined to its request (request columns ``q_*``).

    ``compat`` takes an absent task or origin for a match.
    """
    age = F.unix_millis("received_ts") - F.unix_millis("captured_ts")

    def differs(mine, theirs):
        if compat:
            return F.coalesce(F.col(mine) != F.col(theirs), F.lit(False))
        return ~F.col(mine).eqNullSafe(F.col(theirs))

    return (
        F.when(F.col("q_task_id").isNull(), "UNKNOWN_NONCE")
        .when(differs("task_id", "q_task_id"), "WRONG_TASK")
        .when(differs("origin", "q_origin"), "WRONG_ORIGIN")
        .when(age.isNull() | ~age.between(0, max_age_ms), "STALE")
    )


def capture_response_valid(requests: DataFrame, responses: DataFrame, compat: bool = False) -> DataFrame:
    """Known single-use nonce, same task and origin, age 0 to 5000 ms.

    A nonce is spent by its first response, valid or not.
    """
    asked = requests.select("nonce", F.col("task_id").alias("q_task_id"), F.col("origin").alias("q_origin"))
    first = responses.groupBy("nonce").agg(F.min(F.struct("received_ts", "response_id")).alias("_first"))
    joined = responses.join(asked, "nonce", "left").join(first, "nonce", "left")
    reused = F.struct("received_ts", "response_id") > F.col("_first")
    verdict = F.when(reused, "NONCE_SPENT").otherwise(F.coalesce(response_fault(compat=compat), F.lit("OK")))
    return joined.withColumn("verdict", verdict).select(*responses.columns, "verdict")


def navigation_binding(uses: DataFrame, navigations: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """Uses are void on another tab or origin, and confirmed ones when the tab navigated since the confirmation.

    The latest navigation inside (confirm, use] is found by an equi-join on
    (task, time bucket): a use is repeated for the few buckets its interval
    touches, so a busy task is spread over its buckets. A use must prove its tab,
    origin and decision; a confirmed one also its task and both times, or nobody
    can say what happened in between (``NO_INTERVAL``). A navigation without a time
    may have happened at any time.
    """

    def bucket(ts):
        return F.floor(F.unix_seconds(ts) / bucket_seconds)

    spans = uses.select(
        "use_id",
        "task_id",
        "confirm_ts",
        "use_ts",
        F.explode(F.sequence(bucket(F.col("confirm_ts")), bucket(F.col("use_ts")))).alias("_b"),
    )
    moves = navigations.select("task_id", "nav_ts", bucket(F.col("nav_ts")).alias("_b"))
    inside = (F.col("nav_ts") > F.col("confirm_ts")) & (F.col("nav_ts") <= F.col("use_ts"))
    last = (
        spans.join(moves, ["task_id", "_b"]).filter(inside).groupBy("use_id").agg(F.max("nav_ts").alias("last_nav_ts"))
    )
    undated = navigations.filter("nav_ts is null").select("task_id").distinct().withColumn("_undated", F.lit(True))
    joined = uses.join(last, "use_id", "left").join(undated, "task_id", "left")
    allowed = F.col("decision") == "ALLOW"
    known = F.col("use_id").isNotNull() & F.col("task_id").isNotNull() & (F.col("use_ts") >= F.col("confirm_ts"))
    verdict = _first_failing(
        ("CROSS_TAB", F.col("tab_id") == F.col("anchor_tab_id")),
        ("ORIGIN_HIJACK", origin_match(F.col("anchor_origin"), F.col("current_origin"))),
        ("NO_DECISION", F.col("decision").isin("ALLOW", "CONFIRM")),
        ("NO_INTERVAL", allowed | known),
        ("NAVIGATED", allowed | (F.col("last_nav_ts").isNull() & F.col("_undated").isNull())),
    )
    return joined.select(*uses.columns, "last_nav_ts", verdict.alias("verdict"))


# --- binding to regions -----------------------------------------------------


def allowed_types(action: Column) -> Column:
    """Region types an action may bind to; unknown actions bind like CLICK."""
    chain = None
    for name, types in K.ACTION_COMPATIBILITY.items():
        arr = F.array(*[F.lit(t) for t in types])
        chain = F.when(F.upper(action) == name, arr) if chain is None else chain.when(F.upper(action) == name, arr)
    return chain.otherwise(F.array(*[F.lit(t) for t in K.ACTION_COMPATIBILITY["CLICK"]]))


def _compat_rows(regions: DataFrame) -> DataFrame:
    """Regions repeated for each action they accept."""
    arms = F.array(
        *[
            F.when(F.col("region_type").isin(*types), F.lit(name))
            for name, types in K.ACTION_COMPATIBILITY.items()
        ]
    )
    return regions.withColumn("_action", F.explode(F.filter(arms, lambda a: a.isNotNull())))


GRAM = 4


def _grams(text: Column, size: int) -> Column:
    """The distinct pieces of ``size`` characters of a text; the whole text where it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (size - 1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def mentioned(reasons: DataFrame, texts: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, _reason, _text) for every text of the scope that a reason contains; both sides distinct and not empty.

    Each text is filed under its rarest piece of four characters among the texts of
    its scope (a shorter text under itself), and a reason looks under its own pieces.
    So a reason meets texts that share an unusual piece with it, not all of them; the
    pieces travel without the texts, which are compared afterwards.
    """
    pieces = texts.select(*scope, "_text", F.explode(_grams(F.col("_text"), GRAM)).alias("_g"))
    spread = pieces.groupBy(*scope, "_g").agg(F.count("*").alias("_n"))
    filed = pieces.join(spread, [*scope, "_g"]).groupBy(*scope, "_text").agg(F.min(F.struct("_n", "_g"))["_g"].alias("_g"))
    named = reasons.withColumn("_key", F.xxhash64(*scope, "_reason"))
    looks = F.array_distinct(F.flatten(F.array(*(_grams(F.col("_reason"), k) for k in range(1, GRAM + 1)))))
    looked = named.select("_key", *scope, F.explode(looks).alias("_g"))
    met = looked.join(filed, [*scope, "_g"]).select("_key", "_text").distinct()
    return named.join(met, "_key").filter(F.contains("_reason", "_text")).select(*scope, "_reason", "_text")


def bind_actions(actions: DataFrame, regions: DataFrame, cell: int = 256) -> DataFrame:
    """The region each action is meant for.

    Order: a compatible region under the click point, else one whose text the
    reasoning mentions, else the first compatible one. Each step is a ``min``
    over an equi-join: points meet regions on grid cells, reasons meet the texts they
    share a rare piece with (the first region per image, action and text), the
    fallback is one per (image, action). Regions carry ``region_ord`` as their order in the image.
    An action for which an image has no compatible region stays, as ``UNBOUND``. In calm
    images an action meets the regions of its image directly, after one shuffle.
    """
    known = F.upper("action").isin(*K.ACTION_COMPATIBILITY)
    acts = actions.withColumn("_action", F.when(known, F.upper("action")).otherwise("CLICK"))
    (acts, regions), crowded = split_crowded(acts, regions)
    joined = _bound_directly(acts, regions)
    if crowded is not None:
        joined = joined.unionByName(_bound_by_joins(*crowded, cell))
    best = F.coalesce("_p", "_t", "_f")
    how = F.when(F.col("_p").isNotNull(), "POINT").when(F.col("_t").isNotNull(), "TEXT")
    how = how.when(F.col("_f").isNotNull(), "FIRST").otherwise("UNBOUND")
    r = joined.withColumn("_best", best)
    return r.select(
        *actions.columns,
        how.alias("bound_by"),
        F.col("_best.region_id").alias("region_id"),
        F.col("_best.region_type").alias("region_type"),
        F.col("_best.x").alias("rx"),
        F.col("_best.y").alias("ry"),
        F.col("_best.w").alias("rw"),
        F.col("_best.h").alias("rh"),
        F.coalesce("click_x", F.col("_best.x") + B.js_round(F.col("_best.w") / 2)).alias("bound_x"),
        F.coalesce("click_y", F.col("_best.y") + B.js_round(F.col("_best.h") / 2)).alias("bound_y"),
    )


PICKED = ("region_ord", "region_id", "region_type", "x", "y", "w", "h")


def _bound_directly(acts: DataFrame, regions: DataFrame) -> DataFrame:
    """Actions of calm images with ``_p``, ``_t`` and ``_f``: the first region under the point, mentioned, and compatible.

    Equal actions are one row until the end; each comes back as often as the joins of
    ``_bound_by_joins`` repeat it.
    """
    same = acts.repartition("image_id").groupBy(*acts.columns).agg(F.count("*").alias("_n"))
    fits = [
        (F.col("a__action") == name) & F.col("b_region_type").isin(*types) for name, types in K.ACTION_COMPATIBILITY.items()
    ]
    met = met_in_image(same, regions.select("image_id", *PICKED, "region_text"), reduce(or_, fits), "left")
    picked = F.struct(*(F.col(f"b_{c}").alias(c) for c in PICKED))
    known = F.col("a_action_id").isNotNull()
    under = known & B.contains_point(B.box("b_"), F.col("a_click_x"), F.col("a_click_y"))
    text, reason = F.lower("b_region_text"), F.lower("a_reasoning")
    said = known & (text != "") & (reason != "") & F.contains(reason, text)
    kept = ["image_id", *(F.col(f"a_{c}").alias(c) for c in same.columns if c != "image_id")]
    bound = met.groupBy(*kept).agg(
        F.min(F.when(under, picked)).alias("_p"), F.min(F.when(said, picked)).alias("_t"),
        F.min(F.when(F.col("b_region_type").isNotNull(), picked)).alias("_f"),
    )
    times = F.col("_n") * F.when(F.col("_t").isNotNull(), F.col("_n")).otherwise(1)
    repeated = bound.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    return repeated.select(*acts.columns, "_p", "_t", "_f")


def _bound_by_joins(acts: DataFrame, regions: DataFrame, cell: int) -> DataFrame:
    """The same for images of any size, by joins on cells, rare pieces and images."""
    open_ = _compat_rows(regions)
    picked = F.struct(*PICKED)
    cells = open_.withColumn(
        "_cx", F.explode(F.sequence(F.floor(F.col("x") / cell), F.floor((F.col("x") + F.col("w")) / cell)))
    ).withColumn(
        "_cy", F.explode(F.sequence(F.floor(F.col("y") / cell), F.floor((F.col("y") + F.col("h")) / cell)))
    )
    points = acts.filter(F.col("click_x").isNotNull()).select(
        "action_id",
        "image_id",
        "_action",
        "click_x",
        "click_y",
        F.floor(F.col("click_x") / cell).alias("_cx"),
        F.floor(F.col("click_y") / cell).alias("_cy"),
    )
    by_point = (
        points.join(cells, ["image_id", "_action", "_cx", "_cy"])
        .filter(B.contains_point(B.box(), F.col("click_x"), F.col("click_y")))
        .groupBy("action_id")
        .agg(F.min(picked).alias("_p"))
    )
    texts = (
        open_.filter(F.coalesce(F.col("region_text"), F.lit("")) != "")
        .groupBy("image_id", "_action", F.lower("region_text").alias("_text"))
        .agg(F.min(picked).alias("_r"))
    )
    scope = ["image_id", "_action"]
    said = acts.select("action_id", *scope, F.lower("reasoning").alias("_reason")).filter("_reason <> ''")
    found = mentioned(said.select(*scope, "_reason").distinct(), texts.select(*scope, "_text"), scope)
    named = found.join(texts, [*scope, "_text"]).groupBy(*scope, "_reason").agg(F.min("_r").alias("_t"))
    by_text = said.join(named, [*scope, "_reason"]).select("action_id", "_t")
    first = open_.groupBy("image_id", "_action").agg(F.min(picked).alias("_f"))
    joined = (
        acts.join(first, ["image_id", "_action"], "left")
        .join(by_point, "action_id", "left")
        .join(by_text, "action_id", "left")
    )
    return joined.select(*acts.columns, "_p", "_t", "_f")


def verify_grounding(bindings: DataFrame) -> DataFrame:
    """Ordered verdict just before an action runs.

    Columns: ``region_id, region_type, action, bound_ts, now_ts, bound_x,
    bound_y``, the bound box ``rx, ry, rw, rh`` and the live box ``lx, ly, lw, lh``.
    Every demand must hold; a value that is missing fails like a wrong one. Only
    a click point that was never given is no fault: there is nothing to be outside of.
    An absent action counts as CLICK, and one without rules binds to any region.
    """
    age = F.unix_millis("now_ts") - F.unix_millis("bound_ts")
    act = F.upper(F.coalesce("action", F.lit("CLICK")))
    known = act.isin(*K.ACTION_COMPATIBILITY)
    fits = F.array_contains(allowed_types(act), F.col("region_type"))
    inside = B.contains_point(
        (F.col("rx"), F.col("ry"), F.col("rw"), F.col("rh")), F.col("bound_x"), F.col("bound_y")
    )
    pointed = act.isin("CLICK", "TYPE", "SELECT") & (F.col("bound_x").isNotNull() | F.col("bound_y").isNotNull())
    boxed = F.col("rx").isNotNull() & F.col("ry").isNotNull() & F.col("rw").isNotNull() & F.col("rh").isNotNull()
    # greatest() passes over nulls, so both shifts are asked for
    near = (F.abs(F.col("lx") - F.col("rx")) <= K.GROUNDING_MAX_SHIFT) & (F.abs(F.col("ly") - F.col("ry")) <= K.GROUNDING_MAX_SHIFT)
    verdict = _first_failing(
        ("MISSING", F.col("region_id").isNotNull()),
        ("STALE", age.between(0, K.GROUNDING_MAX_AGE_MS)),
        ("DISABLED", F.coalesce("region_type", F.lit("")) != "DISABLED_CONTROL"),
        ("UNKNOWN_REGION", F.col("region_type") != "UNKNOWN_VISUAL_REGION"),
        ("INCOMPATIBLE", ~known | fits),
        ("OUTSIDE", ~pointed | inside),
        ("ZERO_SIZE", (F.col("lw") > 0) & (F.col("lh") > 0)),
        ("MOVED", near & boxed),
    )
    return bindings.withColumn("verdict", verdict)
