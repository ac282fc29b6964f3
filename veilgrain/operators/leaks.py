"""Auditing outgoing data for raw or encoded sensitive values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain import constants as K
from veilgrain.functions import text as X
from veilgrain.session import written


def payload_strings(payload: Column) -> Column:
    """Every string of a JSON text, keys included, at any depth; else the text itself.

    String literals are cut out of the JSON source and unescaped, so no depth,
    array or key limit is needed. Escaped backslashes and quotes are set aside as
    control characters, which valid JSON cannot hold, so that quotes alternate;
    a pattern for literals would recurse once per letter.
    """
    is_json = payload.rlike(r"^\s*[\[{]") & F.try_parse_json(payload).isNotNull()
    backslash, quote = F.lit("\\\\"), F.lit('\\"')
    hidden = F.replace(F.replace(payload, backslash, F.lit("\x01")), quote, F.lit("\x02"))
    literals = F.filter(F.split(hidden, '"', -1), lambda _, i: i % 2 == 1)
    shown = F.replace(F.replace(F.array_join(literals, '","'), F.lit("\x02"), quote), F.lit("\x01"), backslash)
    listed = F.when(F.size(literals) > 0, F.concat(F.lit('["'), shown, F.lit('"]'))).otherwise("[]")
    plain = F.from_json(listed, "array<string>")
    return F.coalesce(F.when(is_json, plain), F.array(payload))


def string_variants(payloads: DataFrame, text: str = "text", layers: int = 5) -> DataFrame:
    """One row per distinct reading of each string: as is and decoded.

    A layer tries percent-decoding, then ``\\u`` escapes, then base64, each on
    the result so far; a layer is only tried when the one before it changed
    something. Every step is its own column, so it is computed once.
    ``undecoded`` marks strings that could be decoded further still: nothing is
    known about those, so ``outgoing_findings`` reports them.
    """
    decoders = (("p", X.percent_decode), ("u", X.unescape_unicode), ("b", X.base64_text))

    def changed(decode, cur: Column) -> Column:
        return X.let(decode(cur), lambda got: F.when((got != cur) & (got != ""), got))

    df = payloads.withColumn("_cur", F.col(text))
    steps: list[str] = []
    more = F.lit(True)
    for layer in range(1, layers + 1):
        names = [f"_{name}{layer}" for name, _ in decoders]
        for step, (_, decode) in zip(names, decoders):
            df = df.withColumn(step, F.when(more, changed(decode, F.col("_cur")))).withColumn("_cur", F.coalesce(step, "_cur"))
        steps += names
        more = F.coalesce(*names).isNotNull()
    rest = F.coalesce(*[changed(decode, F.col("_cur")) for _, decode in decoders]).isNotNull()
    readings = F.array_distinct(
        F.filter(F.array(F.col(text), *[F.col(s) for s in steps]), lambda v: v.isNotNull())
    )
    kept = [c for c in payloads.columns if c != text]
    return df.withColumn("undecoded", more & rest).select(
        *kept, "undecoded", F.posexplode(readings).alias("variant_ord", "variant")
    )


def sensitive_targets(entities: DataFrame, by: str = "task_id") -> DataFrame:
    """Lower-cased raw, base64 (both encodings) and percent-encoded forms of what must not go out."""
    value = X.js_trim(F.col("raw_value"))
    latin = value.rlike(r"^[\x{00}-\x{ff}]*$")
    forms = F.array(
        value,
        X.base64_of(F.encode(F.when(latin, value), "ISO-8859-1")),
        X.base64_of(F.encode(value, "UTF-8")),
        X.uri_component(value),
    )
    wanted = entities.filter(
        (F.col("treatment") != "KEEP") & (F.col("kind") != K.UNVERIFIED_TYPE) & (F.length(value) >= 3)
    )
    exploded = wanted.select(by, F.explode(forms).alias("target"))
    return exploded.select(by, F.lower("target").alias("target")).filter("target IS NOT NULL").distinct()


#: First grams that are sought in a text one by one; a search takes about a thousandth of forming the text's own.
FEW_GRAMS = 256

_MARKS = r"\[REDACTED[^\]]*\]|\b[A-Z_]+#[A-F0-9]+\b|•+"


def _searchable(variant: Column, compat: bool) -> Column:
    """What is left to search once tokens and redaction marks are set aside.

    ``compat`` exempts a whole string when it is a token or holds any mark, so
    a raw value next to a mark goes unseen; otherwise only the marks are cut.
    """
    if compat:
        exempt = (
            variant.rlike(r"(?i)^[A-Z_]+#[A-F0-9]+$")
            | variant.contains("[REDACTED]")
            | variant.contains("••••")
        )
        return F.when(~exempt, F.lower(variant))
    marked = variant.contains("#") | variant.contains("[REDACTED") | variant.contains("•")
    return F.lower(F.when(marked, F.regexp_replace(variant, _MARKS, "\n")).otherwise(variant))


def find_leaks(
    variants: DataFrame, targets: DataFrame, by: str = "task_id", compat: bool = False
) -> DataFrame:
    """Variants that contain a target of the same task.

    A target has three letters or more, so it is looked up by its first three:
    each task's distinct first grams (a set bounded by the alphabet, not by the
    rows) select those grams of a variant that can start a target, and the pairs
    are formed on (task, gram). One busy task thus spreads over many keys.
    """
    keyed = targets.withColumn("_gram", F.substring("target", 1, 3))
    wanted = keyed.select(by, "_gram").distinct().groupBy(by).agg(F.collect_list("_gram").alias("_wanted"))
    few = F.size("_wanted") <= FEW_GRAMS
    letters = F.when(~few, F.split("_text", ""))
    grams = F.transform("_letters", lambda c, i: F.concat(c, F.get("_letters", i + 1), F.get("_letters", i + 2)))
    sought = F.filter("_wanted", lambda gram: F.contains(F.col("_text"), gram))
    found = (
        variants.withColumn("_text", _searchable(F.col("variant"), compat))
        .join(wanted, by)
        .withColumn("_letters", letters)
        .withColumn("_gram", F.explode(F.when(few, sought).otherwise(F.array_intersect(grams, "_wanted"))))
        .drop("_letters", "_wanted")
    )
    return found.join(keyed, [by, "_gram"]).filter(F.contains(F.col("_text"), F.col("target"))).drop("_text", "_gram")


def _candidates(text: Column) -> Column:
    """Normalised pattern matches of a text as ``struct(kind, value)``."""

    def of(kind, pattern, norm, keep=None):
        matches = X.all_matches(text, pattern)
        if kind == "EMAIL":  # the costly one; an address holds no space, so words without its mark take no part
            words = F.array_join(F.filter(F.split(text, " ", -1), lambda w: w.contains("@")), " ")
            matches = F.when(text.contains("@"), X.all_matches(words, pattern)).otherwise(F.array().cast("array<string>"))
        else:  # the others hold digits, all but cards three in a row
            digits = text.rlike("[0-9]" if kind == "CREDIT_CARD" else "[0-9]{3}")
            matches = F.when(digits, matches).otherwise(F.array().cast("array<string>"))
        values = F.transform(matches, norm)
        if keep is not None:
            values = F.filter(values, keep)
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.array_distinct(
        F.concat(
            of("EMAIL", K.EMAIL_PATTERN, F.lower),
            of("CREDIT_CARD", K.CARD_PATTERN, X.digits, lambda v: F.length(v).between(13, 19)),
            of("GOVT_ID", K.PASSPORT_PATTERN, lambda v: v),
            of("PHONE", K.PHONE_PATTERN, X.digits),
        )
    )


def pattern_leaks(
    payloads: DataFrame, entities: DataFrame, keys: list[str], text: str = "text", scope: list[str] | None = None
) -> DataFrame:
    """Pattern matches in ``payloads`` that equal a known raw value.

    An equi-join on (scope, kind, normalised value), so it works corpus-wide
    (``scope`` empty). Known values are reduced to one row each first, which
    keeps a value shared by very many entities from multiplying the matches.
    """
    scope = scope or []
    found = payloads.select(*dict.fromkeys([*keys, *scope]), F.explode(_candidates(F.col(text))).alias("c"))
    found = found.select(*dict.fromkeys([*keys, *scope]), "c.kind", "c.value")
    raw = F.col("raw_value")
    values = F.array(
        F.when(F.col("treatment") != "KEEP", F.struct(F.lit("EMAIL").alias("kind"), F.lower(raw).alias("value"))),
        F.struct(F.lit("CREDIT_CARD").alias("kind"), X.digits(raw).alias("value")),
        F.struct(F.lit("GOVT_ID").alias("kind"), raw.alias("value")),
        F.struct(F.lit("PHONE").alias("kind"), X.digits(raw).alias("value")),
    )
    known = (
        entities.select(*scope, F.explode(values).alias("k"))
        .select(*scope, "k.kind", "k.value")
        .filter("value <> ''")
        .distinct()
    )
    return found.join(known, [*scope, "kind", "value"], "left_semi")


def embedded_blob_flag(df: DataFrame, text: str = "text") -> DataFrame:
    """Long strings that carry an image data URL or unredacted base64."""
    t = F.col(text)
    blob = (F.length(t) > 500) & (
        t.contains("data:image/") | (t.contains("base64,") & ~t.contains("[REDACTED]"))
    )
    return df.withColumn("embedded_blob", blob)


def check_attestations(images: DataFrame, attestations: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered verdict per outgoing image; any failure drops the bytes.

    A privacy state that is unknown counts as unverified; a key, task or capture
    that is missing attests nothing.
    """
    held = attestations.select(
        *keys,
        F.col("status").alias("_status"),
        F.col("digest").alias("_digest"),
        F.col("task_id").alias("_task"),
        F.col("capture_id").alias("_capture"),
    )
    joined = images.join(held, keys, "left")
    verdict = (
        F.when(~F.coalesce(F.col("image").startswith("data:image/png;base64,"), F.lit(False)), "NO_IMAGE")
        .when(F.coalesce("state", F.lit("VISUAL_PRIVACY_UNVERIFIED")) == "VISUAL_PRIVACY_UNVERIFIED", "STATE_UNVERIFIED")
        .when(F.col("_status").isNull() | (F.col("_status") != "SANITIZED"), "NOT_SANITIZED")
        .when(~F.col("_digest").eqNullSafe(F.sha2("image", 256)), "DIGEST_MISMATCH")
        .when(~F.coalesce(F.col("_task") == F.col("task_id"), F.lit(False)), "WRONG_TASK")
        .when(~F.coalesce(F.col("_capture") == F.col("capture_id"), F.lit(False)), "WRONG_CAPTURE")
        .otherwise("OK")
    )
    return (
        joined.withColumn("verdict", verdict)
        .withColumn("image", F.when(F.col("verdict") == "OK", F.col("image")))
        .drop("_status", "_digest", "_task", "_capture")
    )


def outgoing_findings(payloads: DataFrame, entities: DataFrame, by: str = "task_id", text: str = "text") -> DataFrame:
    """Everything that speaks against sending: rows ``by, variant_ord, finding``.

    All strings of a payload are read in all their encodings. ``VALUE`` is a raw
    or encoded value of the task, ``PATTERN`` a differently written one,
    ``IMAGE`` an embedded picture, ``UNDECODED`` a string encoded too deeply to
    be judged. The readings feed three searches, so they are written once.
    """
    strings = payloads.select(by, F.explode(payload_strings(F.col(text))).alias(text))
    variants = written(string_variants(strings, text), "readings", compression="zstd")

    def named(rows: DataFrame, finding: str) -> DataFrame:
        return rows.select(by, "variant_ord", F.lit(finding).alias("finding"))

    marks = F.array_compact(
        F.array(F.when(F.col("embedded_blob"), "IMAGE"), F.when(F.col("undecoded"), "UNDECODED"))
    )
    flagged = embedded_blob_flag(variants, "variant").select(by, "variant_ord", F.explode(marks).alias("finding"))
    return (
        named(find_leaks(variants, sensitive_targets(entities, by), by), "VALUE")
        .unionByName(named(pattern_leaks(variants, entities, [by, "variant_ord"], "variant", [by]), "PATTERN"))
        .unionByName(flagged)
    )


def boundary_report(
    counts: DataFrame, payloads: DataFrame, leaks: DataFrame, raw_sizes: DataFrame, by: str = "task_id",
    text: str = "text", images: DataFrame | None = None,
) -> DataFrame:
    """One row per task: what was found, what leaks, and payload sizes.

    ``leaks`` are rows of ``outgoing_findings`` or ``find_leaks``; ``images`` those
    of ``check_attestations``, whose refused bytes are gone already. A picture is
    verified when there is one and none was refused. Each input is reduced to
    one row per task before it is joined; payloads of no task are never clean.
    """
    sent = payloads.groupBy(by).agg(F.sum(F.octet_length(text)).alias("_sent"))
    leaked = leaks.groupBy(by).agg(F.count("*").alias("leaks"))
    raw = raw_sizes.groupBy(by).agg(F.sum(F.length("raw_value")).alias("_raw"))
    joined = sent.join(counts, by, "left").join(leaked, by, "left").join(raw, by, "left")
    if images is None:
        joined = joined.withColumn("_seen", F.lit(False)).withColumn("_image", F.lit(0))
    else:
        seen = images.filter(F.col("verdict") != "NO_IMAGE").groupBy(by).agg(
            F.bool_and(F.col("verdict") == "OK").alias("_seen"), F.sum(F.octet_length("image")).alias("_image")
        )
        joined = joined.join(seen, by, "left")
    numbers = [c for c in counts.columns if c != by]
    size = F.coalesce("_sent", F.lit(0)) + F.coalesce("_image", F.lit(0))
    return joined.select(
        by,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers],
        F.coalesce("leaks", F.lit(0)).alias("leaks"),
        (F.col("leaks").isNull() & F.col(by).isNotNull()).alias("zero_raw_pii"),
        F.coalesce("_seen", F.lit(False)).alias("visual_redaction_verified"),
        size.alias("sanitised_bytes"),
        (size + F.coalesce("_raw", F.lit(0))).alias("raw_bytes"),
    )


def report_details(entities: DataFrame, leaks: DataFrame, by: str = "task_id") -> DataFrame:
    """The details of a report as rows, so a large task never becomes one array."""
    t = F.col("treatment")
    what = (
        F.when(t == "KEEP", "passed as KEEP")
        .when(t == "TOKENIZE", "replaced by token")
        .when(t.isin("REMOVE", "MASK"), "blocked or masked")
        .when(t == "LOCAL_ONLY", "kept local")
        .otherwise("abstracted")
    )
    named = {
        "PATTERN": "differently written value", "IMAGE": "embedded picture", "UNDECODED": "string encoded too deeply",
    }
    what_leaks = F.lit("raw or encoded value")
    if "finding" in leaks.columns:
        for finding, words in named.items():
            what_leaks = F.when(F.col("finding") == finding, words).otherwise(what_leaks)
    decided = entities.select(by, F.concat_ws(" ", "kind", what).alias("detail"))
    found = leaks.select(by, F.concat(what_leaks, F.lit(" in variant "), F.col("variant_ord").cast("string")).alias("detail"))
    return decided.unionByName(found)


def gate_payloads(payloads: DataFrame, reports: DataFrame, by: str = "task_id") -> tuple[DataFrame, DataFrame]:
    """(payloads that may leave, payloads for quarantine); unreported ones stay."""
    clean = reports.filter("zero_raw_pii").select(by)
    return payloads.join(clean, by, "left_semi"), payloads.join(clean, by, "left_anti")
