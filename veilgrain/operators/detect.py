"""Finding sensitive entities in text, page nodes and media elements."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrain import constants as K
from veilgrain.functions import text as X

ENTITY_TYPE = (
    "array<struct<kind:string,pos:int,raw_value:string,masked:string,confidence:double,"
    "sensitivity:string,necessity:string,treatment:string>>"
)


def _masked(kind: str, raw: Column) -> Column:
    if kind == "EMAIL":
        return F.concat(F.substring(raw, 1, 1), F.lit("***@***.com"))
    if kind == "PHONE":
        return F.concat(F.lit(K.BULLETS8), X.last4(raw))
    if kind == "CREDIT_CARD":
        return F.concat(F.lit(K.CARD_MASK), X.last4(X.digits(raw)))
    if kind == "NAME":
        second = F.coalesce(F.substring(F.split(raw, " ", -1)[1], 1, 1), F.lit(""))
        if_two = F.when(F.size(F.split(raw, " ", -1)) > 1, second).otherwise(F.lit(""))
        return F.concat(F.substring(raw, 1, 1), F.lit("*** "), if_two, F.lit("***"))
    return F.lit(K.BULLETS8)


def _entity(kind: str, raw: Column, pos: Column, confidence: float | None = None) -> Column:
    conf, sensitivity, necessity, treatment = K.TEXT_ENTITY_SPECS[kind]
    return F.struct(
        F.lit(kind).alias("kind"),
        pos.cast("int").alias("pos"),
        raw.alias("raw_value"),
        _masked(kind, raw).alias("masked"),
        F.lit(conf if confidence is None else confidence).alias("confidence"),
        F.lit(sensitivity).alias("sensitivity"),
        F.lit(necessity).alias("necessity"),
        F.lit(treatment).alias("treatment"),
    )


def _known_name_pattern() -> str:
    return r"(?i)\b(" + "|".join(K.KNOWN_NAMES) + r")\b"


def _names_a_known_one(low: Column) -> Column:
    return reduce(or_, (low.contains(name.lower()) for name in K.KNOWN_NAMES))


def _labels_a_name(low: Column) -> Column:
    return reduce(or_, (low.contains(label) for label in ("name:", "passenger:", "user:", "person:")))


def _label_prefix_len(text_hit: Column, name: Column) -> Column:
    return F.length(text_hit) - F.length(name)


def entity_array(text: Column, kind: str, low: Column | None = None) -> Column:
    """Every entity of one kind in ``text`` as an array of structs, in text order.

    ``low`` is the text in lower case, when the caller has it at hand.
    """
    none = F.array().cast(ENTITY_TYPE)
    low = F.lower(text) if low is None else low
    if kind == "NAME":
        labelled = X.located_matches(text, K.LABELLED_NAME_PATTERN)
        known = X.located_matches(text, _known_name_pattern())

        def of_label(hit: Column) -> Column:
            name = F.regexp_extract(hit["raw"], X.java_pattern(K.LABELLED_NAME_PATTERN), 1)
            return _entity("NAME", name, hit["pos"] + _label_prefix_len(hit["raw"], name))

        listed = _names_a_known_one(low)
        # The list is the fallback for texts without a labelled name.
        found = F.coalesce(
            F.when(_labels_a_name(low), F.transform(labelled, of_label)),
            F.when(listed, F.transform(known, lambda hit: _entity("NAME", hit["raw"], hit["pos"]))),
        )
        return F.coalesce(found.cast(ENTITY_TYPE), none)
    pattern = {
        "EMAIL": K.EMAIL_PATTERN,
        "PHONE": K.PHONE_PATTERN,
        "CREDIT_CARD": K.CARD_PATTERN,
        "GOVT_ID": K.PASSPORT_PATTERN,
        "PASSWORD": K.SECRET_PATTERN,
    }[kind]
    hits = X.located_matches(text, pattern)
    if kind == "CREDIT_CARD":
        hits = F.filter(hits, lambda h: F.length(X.digits(h["raw"])).between(13, 19))
    found = F.transform(hits, lambda h: _entity(kind, h["raw"], h["pos"]))
    return F.coalesce(F.when(_may_hold(text, low, kind), found.cast(ENTITY_TYPE)), none)


def _may_hold(text: Column, low: Column, kind: str) -> Column:
    """A cheap necessary condition, so most texts never meet the full pattern."""
    if kind == "EMAIL":
        return text.contains("@")
    if kind == "PHONE":
        return text.rlike(r"[0-9]{4}")
    if kind == "CREDIT_CARD":
        return text.rlike(r"[0-9][ -]*[0-9][ -]*[0-9][ -]*[0-9]")
    if kind == "GOVT_ID":
        return text.rlike(r"[0-9]{7}")
    return low.contains("pass") | low.contains("secret123")


# Order in which a text is scanned; it fixes ``entity_ord``.
SCAN_ORDER = ("EMAIL", "PHONE", "CREDIT_CARD", "GOVT_ID", "NAME", "PASSWORD")


def entity_arrays(text: Column, kinds=SCAN_ORDER) -> Column:
    """All kinds, concatenated in scan order."""
    return X.let(F.lower(text), lambda low: F.concat(*[entity_array(text, kind, low) for kind in kinds]))


def scan_array(df: DataFrame, text: str = "text", kinds=SCAN_ORDER, out: str = "entities") -> DataFrame:
    """Keep the rows and add the entity array: no explode, no shuffle."""
    return df.withColumn(out, entity_arrays(F.col(text), kinds))


def scan_all(df: DataFrame, src: str, text: str = "text", kinds=SCAN_ORDER) -> DataFrame:
    """One pass over the text, one explode, to one row per entity."""
    found = df.select(
        F.col(src).alias("src_id"), F.posexplode(entity_arrays(F.col(text), kinds)).alias("entity_ord", "e")
    )
    return found.select("src_id", "entity_ord", "e.*", F.lit("REGEX").alias("source"))


def scan_emails(df: DataFrame, src: str, text: str = "text") -> DataFrame:
    return scan_all(df, src, text, ("EMAIL",))


def scan_phones(df: DataFrame, src: str, text: str = "text") -> DataFrame:
    return scan_all(df, src, text, ("PHONE",))


def scan_cards(df: DataFrame, src: str, text: str = "text") -> DataFrame:
    return scan_all(df, src, text, ("CREDIT_CARD",))


def scan_passports(df: DataFrame, src: str, text: str = "text") -> DataFrame:
    return scan_all(df, src, text, ("GOVT_ID",))


def scan_names(df: DataFrame, src: str, text: str = "text") -> DataFrame:
    return scan_all(df, src, text, ("NAME",))


def scan_secrets(df: DataFrame, src: str, text: str = "text") -> DataFrame:
    return scan_all(df, src, text, ("PASSWORD",))


def scan_attributes(nodes: DataFrame) -> DataFrame:
    """Password, passport and card fields recognised by their attributes."""
    kind, name, ident = (
        F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("input_type", "name_attr", "id_attr")
    )
    rules = (
        ("PASSWORD", (kind == "password") | name.contains("pass") | ident.contains("pass"), K.BULLETS8),
        ("GOVT_ID", name.contains("passport") | ident.contains("passport"), K.BULLETS8),
        (
            "CREDIT_CARD",
            name.contains("card") | ident.contains("card") | name.contains("cc"),
            K.CARD_MASK + "••••",
        ),
    )
    candidates = [
        F.when(
            hit,
            F.struct(
                F.lit(i).alias("entity_ord"),
                F.lit(etype).alias("kind"),
                F.coalesce(F.col("text"), F.lit("")).alias("raw_value"),
                F.lit(mask).alias("masked"),
                F.lit(K.ATTRIBUTE_CONFIDENCE[etype]).alias("confidence"),
                F.lit("CRITICAL").alias("sensitivity"),
                F.lit("NONE").alias("necessity"),
                F.lit("REMOVE").alias("treatment"),
                F.lit("DOM_ATTR").alias("source"),
            ),
        )
        for i, (etype, hit, mask) in enumerate(rules)
    ]
    found = nodes.select(
        "page_id", "node_ord", F.explode(F.filter(F.array(*candidates), lambda c: c.isNotNull())).alias("e")
    )
    return found.select("page_id", "node_ord", "e.*")


def region_entities(text: Column) -> Column:
    """First match per kind in one region; a phone is dropped when a card matched."""

    def entry(kind: str, raw: Column) -> Column:
        return X.let(
            raw,
            lambda r: F.when(
                r.isNotNull(), _entity(kind, r, F.position(r, text) - 1, K.REGION_CONFIDENCE[kind])
            ),
        )

    def first(kind: str, pattern: str, low: Column) -> Column:
        return F.when(_may_hold(text, low, kind), X.first_match(text, pattern))

    def all_kinds(card: Column, low: Column) -> Column:
        card_ok = F.length(X.digits(card)).between(13, 19)
        name = F.coalesce(
            F.when(_labels_a_name(low), X.first_match(text, K.LABELLED_NAME_PATTERN, 1)),
            F.when(_names_a_known_one(low), X.first_match(text, _known_name_pattern(), 1)),
        )
        return F.array(
            entry("EMAIL", first("EMAIL", K.EMAIL_PATTERN, low)),
            entry("CREDIT_CARD", F.when(card_ok, card)),
            entry("GOVT_ID", first("GOVT_ID", K.PASSPORT_PATTERN, low)),
            entry("PHONE", F.when(card.isNull(), first("PHONE", K.PHONE_PATTERN, low))),
            entry("NAME", name),
            entry("PASSWORD", first("PASSWORD", K.SECRET_PATTERN, low)),
        )

    found = X.let(F.lower(text), lambda low: X.let(first("CREDIT_CARD", K.CARD_PATTERN, low), lambda card: all_kinds(card, low)))
    kept = F.filter(found, lambda e: e.isNotNull())
    skipped = X.contains_any(text, K.REGION_SKIP_MARKS)
    return F.when(skipped, F.array().cast(ENTITY_TYPE)).otherwise(kept.cast(ENTITY_TYPE))


def scan_region_text(regions: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Entities of recognised text regions; text already treated is skipped."""
    found = regions.select(*keys, F.posexplode(region_entities(F.col(text))).alias("entity_ord", "e"))
    return found.select(*keys, "entity_ord", "e.*", F.lit(True).alias("visual_only"))


def dedup_entities(entities: DataFrame, scope: list[str], order: str = "entity_ord") -> DataFrame:
    """One row per (scope, kind, value ignoring case and outer space, x, y).

    The highest confidence wins, the first seen on ties. A ``min`` over a struct
    combines map-side, so a hot value is reduced before the shuffle.
    """
    zero = F.lit(0.0)
    x = F.coalesce(F.col("x"), zero) if "x" in entities.columns else zero
    y = F.coalesce(F.col("y"), zero) if "y" in entities.columns else zero
    keyed = entities.select(
        *scope,
        F.col("kind"),
        F.lower(X.js_trim(F.col("raw_value"))).alias("_value"),
        x.alias("_x"),
        y.alias("_y"),
        F.struct(
            (-F.col("confidence")).alias("neg"),
            F.col(order).alias("ord"),
            F.struct(*[F.col(c) for c in entities.columns if c not in (*scope, "kind")]).alias("row"),
        ).alias("_best"),
    )
    best = keyed.groupBy(*scope, "kind", "_value", "_x", "_y").agg(F.min("_best").alias("_best"))
    return best.select(*scope, "kind", "_best.row.*")


MEDIA_TAGS = {"canvas": "CANVAS_TEXT", "svg": "SVG_TEXT", "img": "IMAGE_TEXT"}


def _media_text() -> Column:
    def attr(*names):
        values = [F.nullif(F.col("attributes")[n], F.lit("")) for n in names]
        return F.coalesce(*values, F.lit(""))

    return (
        F.when(F.col("tag") == "canvas", attr("data-canvas-text", "aria-label", "title"))
        .when(F.col("tag") == "img", attr("alt", "data-ocr-text"))
        .otherwise(F.coalesce(F.col("text"), F.lit("")))
    )


def media_entities(nodes: DataFrame) -> DataFrame:
    """Canvas, svg and img elements: readable ones are scanned, the rest fail closed.

    Small svg (20 px) and img (30 px) elements and ``aria-hidden`` svg may stay
    unread; a size that is absent or unknown counts as large enough.
    """
    width, height = (F.coalesce(c, F.lit(100)) if c in nodes.columns else F.lit(100) for c in ("w", "h"))
    media = nodes.filter(F.col("tag").isin(*MEDIA_TAGS)).withColumn("_text", _media_text())
    least = F.when(F.col("tag") == "img", 30).otherwise(20)
    decorative = (F.col("tag") == "svg") & F.coalesce(
        F.col("attributes")["aria-hidden"] != "", F.lit(False)
    )
    big = (F.col("tag") == "canvas") | ((width > least) & (height > least) & ~decorative)
    unread = F.array(
        F.struct(
            F.lit(K.UNVERIFIED_TYPE).alias("kind"),
            F.lit(0).alias("pos"),
            F.concat(F.lit("[UNVERIFIED_"), F.upper("tag"), F.lit("]")).alias("raw_value"),
            F.lit("[VISUAL_PRIVACY_UNVERIFIED]").alias("masked"),
            F.lit(K.UNVERIFIED_CONFIDENCE).alias("confidence"),
            F.lit("CRITICAL").alias("sensitivity"),
            F.lit("NONE").alias("necessity"),
            F.lit("REMOVE").alias("treatment"),
        )
    ).cast(ENTITY_TYPE)
    rows = F.when(F.col("_text") != "", region_entities(F.col("_text"))).when(big, unread)
    source = reduce(
        lambda acc, kv: acc.when(F.col("tag") == kv[0], kv[1]), MEDIA_TAGS.items(), F
    )
    found = media.select("page_id", "node_ord", source.alias("source"), F.posexplode(rows).alias("entity_ord", "e"))
    return found.select("page_id", "node_ord", "entity_ord", "e.*", "source", F.lit(True).alias("visual_only"))


def unverified_media(nodes: DataFrame) -> DataFrame:
    """Only the media elements nobody could read."""
    return media_entities(nodes).filter(F.col("kind") == K.UNVERIFIED_TYPE)


STATE_RANK = {"VERIFIED_SAFE": 0, "VISUAL_PRIVACY_UNVERIFIED": 1, "PII_DETECTED": 2, "SCAN_FAILED": 3}


def privacy_state(pages: DataFrame, media: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Fold media findings to one state per page.

    A finding beats an unread region, and a scan that failed beats both. Every
    page keeps a row. ``max`` and ``count`` combine map-side.
    """
    marks = media.select(
        "page_id",
        F.when(F.col("kind") == K.UNVERIFIED_TYPE, 1).otherwise(2).alias("rank"),
        F.when(F.col("kind") == K.UNVERIFIED_TYPE, 1).otherwise(0).alias("unread"),
    )
    base = pages.select("page_id", F.lit(0).alias("rank"), F.lit(0).alias("unread"))
    rows = base.unionByName(marks)
    if failed is not None:
        rows = rows.unionByName(
            failed.select("page_id", F.lit(3).alias("rank"), F.lit(1).alias("unread"))
        )
    folded = rows.groupBy("page_id").agg(
        F.max("rank").alias("rank"), F.sum("unread").alias("unverified_regions")
    )
    state = (
        F.when(F.col("rank") == 2, "PII_DETECTED")
        .when(F.col("rank") == 0, "VERIFIED_SAFE")
        .otherwise("VISUAL_PRIVACY_UNVERIFIED")
    )
    return folded.select("page_id", state.alias("state"), "unverified_regions")


def fuse_sources(model: DataFrame, fallback: DataFrame, *more: DataFrame, key: str = "image_id",
                 fallback_only_when_empty: bool = False) -> DataFrame:
    """Detections of several detectors under one schema, tagged by ``source``.

    With ``fallback_only_when_empty`` the fallback counts only for images the
    model said nothing about.
    """
    if fallback_only_when_empty:
        fallback = fallback.join(model.select(key).distinct(), key, "left_anti")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), more, model.unionByName(fallback, allowMissingColumns=True))
