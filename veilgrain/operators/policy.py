"""Disclosure decisions, tokens and redaction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain import constants as K
from veilgrain.functions import text as X


@dataclass(frozen=True)
class PolicyConfig:
    """Policy options; compiled to literals of the plan."""

    confidence_threshold: float = K.CONFIDENCE_THRESHOLD
    fail_closed: str = K.FAIL_CLOSED_TREATMENT
    matrix: tuple = field(default=tuple(K.POLICY_MATRIX))


# --- intent -----------------------------------------------------------------


def goal_of(prompt: Column) -> Column:
    low = F.lower(prompt)
    return (
        F.when(X.contains_any(low, K.BOOKING_WORDS), "flight_booking")
        .when(X.contains_any(low, K.CHECKOUT_WORDS), "ecommerce_checkout")
        .otherwise("generic_web_navigation")
    )


def classify_intent(prompts: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Goal, slots and data classes of each prompt."""
    text = F.col(prompt)
    booking, checkout = F.col("goal") == "flight_booking", F.col("goal") == "ecommerce_checkout"
    slot = F.lit("TOKENIZED_SLOT")

    def entry(key, value):
        return F.when(value.isNotNull(), F.struct(F.lit(key).alias("k"), value.alias("v")))

    booking_slots = F.array(
        entry("origin_city", X.first_match(text, r"(?i)from\s+([A-Za-z]+)", 1)),
        entry("destination_city", X.first_match(text, r"(?i)to\s+([A-Za-z]+)", 1)),
        entry("passenger_name", slot),
        entry("passenger_email", slot),
    )
    checkout_slots = F.array(entry("shipping_address", slot))
    slots = F.when(booking, booking_slots).when(checkout, checkout_slots)
    present = F.coalesce(
        F.filter(slots, lambda e: e.isNotNull()), F.array().cast("array<struct<k:string,v:string>>")
    )

    def words(values):
        return F.array(*[F.lit(v) for v in values])

    return (
        prompts.withColumn("goal", goal_of(text))
        .withColumn("slots", F.map_from_entries(present))
        .withColumn(
            "allowed_classes",
            F.when(booking, words(K.BOOKING_CLASSES))
            .when(checkout, words(K.CHECKOUT_CLASSES))
            .otherwise(F.array().cast("array<string>")),
        )
        .withColumn("forbidden_classes", words(K.FORBIDDEN_CLASSES))
        .withColumn("permitted_actions", words(K.PERMITTED_ACTIONS))
        .withColumn("max_steps", F.lit(K.MAX_STEPS))
    )


# --- decisions --------------------------------------------------------------


def necessity_of(kind: Column, sensitivity: Column, raw: Column, goal: Column, prompt: Column) -> Column:
    value = F.lower(raw)
    quoted = (F.length(value) > 2) & F.contains(F.lower(prompt), value)
    return (
        F.when((sensitivity == "CRITICAL") | (kind == "PASSWORD"), "NONE")
        .when(kind.isin("NAME", "EMAIL") & goal.isin("flight_booking", "ecommerce_checkout"), "HIGH")
        .when(quoted, "HIGH")
        .when(kind == "PHONE", "MEDIUM")
        .otherwise("NONE")
    )


def treatment_of(
    confidence: Column, sensitivity: Column, necessity: Column, config: PolicyConfig = PolicyConfig()
) -> Column:
    """Fail closed on low confidence, else the sensitivity x necessity matrix."""
    chain = F.when(confidence < config.confidence_threshold, config.fail_closed)
    for tier, need, treatment in config.matrix:
        chain = chain.when((sensitivity == tier) & (necessity == need), treatment)
    return chain.otherwise(config.fail_closed)


def task_necessity(entities: DataFrame, anchors: DataFrame) -> DataFrame:
    """Necessity of each entity for its task; entities of unknown tasks need nothing."""
    known = anchors.select(
        "task_id", F.col("goal").alias("_goal"), F.col("prompt").alias("_prompt")
    )
    joined = entities.join(known, "task_id", "left")
    necessity = necessity_of(
        F.col("kind"),
        F.col("sensitivity"),
        F.col("raw_value"),
        F.coalesce("_goal", F.lit("generic_web_navigation")),
        F.coalesce("_prompt", F.lit("")),
    )
    return joined.withColumn("necessity", necessity).drop("_goal", "_prompt")


def apply_treatment(entities: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """The matrix decides; low confidence was failed closed before it is asked.

    Sixteen rules become one CASE expression, which is cheaper than joining a
    table of sixteen rows.
    """
    return entities.withColumn(
        "treatment", treatment_of(F.col("confidence"), F.col("sensitivity"), F.col("necessity"), config)
    )


def fail_closed(entities: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Only the confidence rule."""
    low = F.col("confidence") < config.confidence_threshold
    return entities.withColumn("treatment", F.when(low, config.fail_closed).otherwise(F.col("treatment")))


# --- tokens -----------------------------------------------------------------


def token_of(kind: Column, raw: Column, task: Column, origin: Column, secret: str) -> Column:
    """Keyed, deterministic and scoped token: no coordination, no collisions."""
    prefix = F.lit(K.TOKEN_DEFAULT_PREFIX)
    for etype, name in K.TOKEN_PREFIXES.items():
        prefix = F.when(kind == etype, name).otherwise(prefix)
    keyed = F.sha2(
        F.concat_ws("|", F.lit(secret), task.cast("string"), F.coalesce(origin, F.lit("")), raw), 256
    )
    return F.concat(prefix, F.lit("#"), F.upper(F.substring(keyed, 1, 32)))


def build_vault(
    entities: DataFrame, secret: str, ttl_minutes: int = K.VAULT_TTL_MINUTES
) -> DataFrame:
    """One token per (raw value, task, origin) among TOKENIZE entities.

    ``min`` keeps the first entity of a scope and combines map-side.
    """
    first = (
        entities.filter(F.col("treatment") == "TOKENIZE")
        .groupBy("task_id", "origin", "raw_value")
        .agg(F.min(F.struct("created_ts", "entity_ord", "kind")).alias("first"))
    )
    return first.select(
        token_of(F.col("first.kind"), F.col("raw_value"), F.col("task_id"), F.col("origin"), secret).alias("token"),
        "raw_value",
        F.col("first.kind").alias("kind"),
        "task_id",
        "origin",
        F.col("first.created_ts").alias("created_ts"),
        (F.col("first.created_ts") + F.make_dt_interval(mins=F.lit(ttl_minutes))).alias("expires_ts"),
    )


def tokenise(entities: DataFrame, vault: DataFrame) -> DataFrame:
    """Put the token on every TOKENIZE row."""
    held = vault.select(
        F.col("task_id").alias("_task"), F.col("origin").alias("_origin"), F.col("raw_value").alias("_raw"), F.col("token").alias("_token")
    )
    same = (
        F.col("task_id").eqNullSafe(F.col("_task"))
        & F.col("origin").eqNullSafe(F.col("_origin"))
        & F.col("raw_value").eqNullSafe(F.col("_raw"))
    )
    joined = entities.join(held, same, "left").drop("_task", "_origin", "_raw")
    return joined.withColumn("token", F.when(F.col("treatment") == "TOKENIZE", F.col("_token"))).drop("_token")


def detokenise(values: DataFrame, vault: DataFrame, asof: Column) -> DataFrame:
    """Resolve the first token of ``value`` for its own task and origin.

    Values without a token get scattered join keys, so they do not pile up in
    one partition.
    """
    token = X.first_match(F.col("value"), K.TOKEN_PATTERN)
    plain = [f.name for f in values.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    spread = F.concat(F.lit("~"), F.xxhash64(*plain).cast("string"))
    held = vault.select(
        F.col("token").alias("_key"),
        F.col("raw_value").alias("_raw"),
        F.col("task_id").alias("_task"),
        F.col("origin").alias("_origin"),
        F.col("expires_ts").alias("_expires"),
    )
    keyed = values.withColumn("_token", token).withColumn("_key", F.coalesce("_token", spread))
    joined = keyed.join(held, "_key", "left")
    reason = (
        F.when(F.col("_token").isNull(), "NO_TOKEN")
        .when(F.col("_task").isNull(), "UNKNOWN_TOKEN")
        .when(F.col("_task") != F.col("task_id"), "TASK_MISMATCH")
        .when(~F.col("_origin").eqNullSafe(F.col("origin")), "ORIGIN_MISMATCH")
        .when(F.col("_expires") < asof, "EXPIRED")
        .otherwise("RESOLVED")
    )
    whole = F.overlay(
        F.col("value"), F.col("_raw"), F.position(F.col("_token"), F.col("value")), F.length("_token")
    )
    return (
        joined.withColumn("reason", reason)
        .withColumn(
            "resolved",
            F.when(F.col("reason") == "RESOLVED", whole).when(F.col("reason") == "NO_TOKEN", F.col("value")),
        )
        .drop("_key", "_token", "_raw", "_task", "_origin", "_expires")
    )


def purge_vault(vault: DataFrame, finished_tasks: DataFrame) -> DataFrame:
    """Vault without the entries of finished tasks."""
    return vault.join(finished_tasks.select("task_id"), "task_id", "left_anti")


def active_tokens(vault: DataFrame, asof: Column) -> DataFrame:
    """Live entries with the raw value masked."""
    live = vault.filter(F.col("expires_ts") > asof)
    return live.withColumn("raw_value", F.repeat(F.lit("•"), F.length("raw_value")))


# --- redaction --------------------------------------------------------------


def _rank(sensitivity: Column) -> Column:
    chain = F.lit(0)
    for weight, tier in enumerate(("LOW", "MEDIUM", "HIGH", "CRITICAL"), start=1):
        chain = F.when(sensitivity == tier, weight).otherwise(chain)
    return chain


def redact_text(text: Column, spans: Column) -> Column:
    """Replace ``spans`` (``struct(pos, len, rank, label)``) in one text.

    Leftmost wins, then longest, then most sensitive; a span overlapping the one
    before it widens that one. One fold over the sorted spans.
    """
    ordered = F.transform(
        F.array_sort(
            F.transform(
                spans,
                lambda s: F.struct(
                    s["pos"].alias("pos"),
                    (-s["len"]).alias("neg_len"),
                    (-s["rank"]).alias("neg_rank"),
                    s["label"].alias("label"),
                ),
            )
        ),
        lambda s: F.struct(s["pos"].alias("pos"), (-s["neg_len"]).alias("len"), s["label"].alias("label")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        end = s["pos"] + s["len"]
        fresh = s["pos"] >= acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["pos"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], end).alias("at"),
            F.when(fresh, F.concat(acc["parts"], F.array(gap, s["label"]))).otherwise(acc["parts"]).alias("parts"),
        )

    def finish(acc: Column) -> Column:
        tail = F.substring(text, acc["at"] + 1, F.length(text))
        return F.concat(F.array_join(acc["parts"], ""), tail)

    return F.aggregate(ordered, start, step, finish)


def decide_array(
    entities: Column, goal: Column, prompt: Column, task: Column, origin: Column, secret: str,
    config: PolicyConfig = PolicyConfig(),
) -> Column:
    """Necessity, treatment and token for an entity array, inside the row."""

    def decided(e: Column) -> Column:
        need = necessity_of(e["kind"], e["sensitivity"], e["raw_value"], goal, prompt)
        treat = treatment_of(e["confidence"], e["sensitivity"], need, config)
        token = F.when(treat == "TOKENIZE", token_of(e["kind"], e["raw_value"], task, origin, secret))
        return F.struct(
            *[e[c].alias(c) for c in ("kind", "pos", "raw_value", "masked", "confidence", "sensitivity")],
            need.alias("necessity"),
            treat.alias("treatment"),
            token.alias("token"),
        )

    return F.transform(entities, decided)


def redact_spans(docs: DataFrame, text: str = "text", entities: str = "entities", out: str = "redacted") -> DataFrame:
    """Every treated span becomes its token or ``[REDACTED KIND]``; KEEP stays.

    Works inside the row on an entity array, so there is nothing to shuffle and
    a text with very many entities is still one row.
    """
    treated = F.filter(F.col(entities), lambda e: e["treatment"] != "KEEP")
    spans = F.transform(
        treated,
        lambda e: F.struct(
            e["pos"].alias("pos"),
            F.length(e["raw_value"]).alias("len"),
            _rank(e["sensitivity"]).alias("rank"),
            F.coalesce(e["token"], F.concat(F.lit("[REDACTED "), e["kind"], F.lit("]"))).alias("label"),
        ),
    )
    return docs.withColumn(out, redact_text(F.col(text), spans))


def sanitise_nodes(nodes: DataFrame, entities: DataFrame, compat: bool = False) -> DataFrame:
    """Node text with its entities replaced by token or mask.

    ``compat`` applies the first entity of a node only, to the whole text, and
    lets LOCAL_ONLY and ABSTRACT through. Otherwise attribute findings cover the
    whole value, text findings their own spans, and only KEEP passes.
    Entities of one node are bounded by the node's own text.
    """
    keys = ["page_id", "node_ord"]
    if compat:
        first = entities.groupBy(*keys).agg(
            F.min(F.struct("entity_ord", "treatment", "token", "masked")).alias("e")
        )
        joined = nodes.join(first, keys, "left")
        shown = (
            F.when(F.col("e.treatment") == "TOKENIZE", F.col("e.token"))
            .when(F.col("e.treatment").isin("MASK", "REMOVE"), F.col("e.masked"))
            .otherwise(F.col("text"))
        )
        return joined.withColumn("text", shown).drop("e")
    mark = F.coalesce(F.col("token"), F.col("masked"))
    treated = entities.filter(F.col("treatment") != "KEEP")
    per_node = treated.groupBy(*keys).agg(
        F.min(
            F.when(F.col("source") == "DOM_ATTR", F.struct("entity_ord", mark.alias("mark")))
        ).alias("_whole"),
        F.collect_list(
            F.when(
                F.col("source") != "DOM_ATTR",
                F.struct(
                    F.col("pos").alias("pos"),
                    F.length("raw_value").alias("len"),
                    _rank(F.col("sensitivity")).alias("rank"),
                    mark.alias("label"),
                ),
            )
        ).alias("_spans"),
    )
    joined = nodes.join(per_node, keys, "left")
    shown = (
        F.when(F.col("_whole").isNotNull(), F.col("_whole.mark"))
        .when(F.size("_spans") > 0, redact_text(F.col("text"), F.col("_spans")))
        .otherwise(F.col("text"))
    )
    return joined.withColumn("text", shown).drop("_whole", "_spans")


def disclosure_counts(entities: DataFrame, by: str = "task_id") -> DataFrame:
    """Counts by what happened to the entities of each task."""
    t = F.col("treatment")
    return entities.groupBy(by).agg(
        F.count("*").alias("detected"),
        F.count_if(t == "KEEP").alias("transmitted"),
        F.count_if(t == "TOKENIZE").alias("tokenised"),
        F.count_if(t.isin("REMOVE", "MASK")).alias("blocked"),
        F.count_if(t == "LOCAL_ONLY").alias("local_only"),
        F.count_if(t == "ABSTRACT").alias("abstracted"),
    )
