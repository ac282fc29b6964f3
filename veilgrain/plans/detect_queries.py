"""Entity detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.operators import detect
from veilgrain.plans import views as V
from veilgrain.plans.entity_sql import entities_sql, region_sql

Q = {}
SQL = {}


def _scan(name, operator, view, kinds):
    Q[name] = lambda spark, d: operator(view(spark, d), "doc_id")
    table = "documents" if view is _documents else "texts_synth"
    SQL[name] = V.with_views([] if table == "documents" else [table], entities_sql(table, "doc_id", kinds))


def _documents(spark, d):
    return V.table(spark, d, "documents")


_scan("scan_emails", detect.scan_emails, _documents, ("EMAIL",))
_scan("scan_phones", detect.scan_phones, _documents, ("PHONE",))
_scan("scan_cards", detect.scan_cards, _documents, ("CREDIT_CARD",))
_scan("scan_passports", detect.scan_passports, V.texts_synth, ("GOVT_ID",))
_scan("scan_names", detect.scan_names, V.texts_synth, ("NAME",))
_scan("scan_secrets", detect.scan_secrets, V.texts_synth, ("PASSWORD",))
_scan("scan_all", detect.scan_all, V.texts_synth, ("EMAIL", "PHONE", "CREDIT_CARD", "GOVT_ID", "NAME", "PASSWORD"))


def entity_census(spark, d):
    """Entities per language and kind, with the documents affected."""
    found = detect.scan_array(V.texts_synth(spark, d).select("doc_id", "lang", "text"))
    kinds = found.select("lang", "doc_id", F.explode("entities").alias("e"))
    per_doc = kinds.groupBy("lang", "doc_id", F.col("e.kind").alias("kind")).agg(F.count("*").alias("n"))
    return per_doc.groupBy("lang", "kind").agg(
        F.sum("n").alias("entities"), F.count("*").alias("documents")
    )


Q["entity_census"] = entity_census
SQL["entity_census"] = V.with_views(
    ["texts_synth"],
    "SELECT lang, kind, count(*) AS entities, count(DISTINCT src_id) AS documents FROM ents "
    "JOIN documents ON src_id = doc_id GROUP BY lang, kind",
    {"ents": entities_sql("texts_synth", "doc_id")},
)


def dedup_entities(spark, d):
    # Scanned per language and source of text, so that copies of one value meet.
    docs = V.texts_synth(spark, d)
    ents = detect.scan_all(docs, "doc_id")
    tagged = ents.join(docs.select(F.col("doc_id").alias("src_id"), "source").withColumnRenamed("source", "origin"), "src_id")
    tagged = tagged.withColumn("seen", F.col("src_id") * 100000 + F.col("entity_ord"))
    best = detect.dedup_entities(tagged, ["origin"], "seen")
    return best.select("origin", "kind", "src_id", "entity_ord", "raw_value", "confidence")


Q["dedup_entities"] = dedup_entities
SQL["dedup_entities"] = V.with_views(
    ["texts_synth"],
    """SELECT origin, kind, src_id, entity_ord, raw_value, confidence FROM (
      SELECT documents.source AS origin, ents.*, row_number() OVER (PARTITION BY documents.source, kind, lower(trim(raw_value))
        ORDER BY confidence DESC, src_id * 100000 + entity_ord) AS rn
      FROM ents JOIN documents ON src_id = doc_id) WHERE rn = 1""",
    {"ents": entities_sql("texts_synth", "doc_id")},
)

Q["scan_attributes"] = lambda spark, d: detect.scan_attributes(V.nodes_synth(spark, d))
SQL["scan_attributes"] = V.with_views(
    ["nodes_synth"],
    """SELECT page_id, node_ord, entity_ord, kind, text AS raw_value, masked, confidence, 'CRITICAL' AS sensitivity, 'NONE' AS necessity,
        'REMOVE' AS treatment, 'DOM_ATTR' AS source
      FROM (
        SELECT *, 0 AS entity_ord, 'PASSWORD' AS kind, '••••••••' AS masked, 0.99 :: DOUBLE AS confidence FROM nodes_synth
          WHERE lower(input_type) = 'password' OR contains(lower(name_attr), 'pass') OR contains(lower(id_attr), 'pass')
        UNION ALL SELECT *, 1, 'GOVT_ID', '••••••••', 0.98 FROM nodes_synth
          WHERE contains(lower(name_attr), 'passport') OR contains(lower(id_attr), 'passport')
        UNION ALL SELECT *, 2, 'CREDIT_CARD', '••••-••••-••••-••••', 0.95 FROM nodes_synth
          WHERE contains(lower(name_attr), 'card') OR contains(lower(id_attr), 'card') OR contains(lower(name_attr), 'cc'))""",
)

Q["scan_region_text"] = lambda spark, d: detect.scan_region_text(V.regions(spark, d), ["conv_id", "turn"])
SQL["scan_region_text"] = V.with_views(["regions"], region_sql("regions", "conv_id, turn"))

Q["unverified_media"] = lambda spark, d: detect.unverified_media(V.nodes_synth(spark, d)).select(
    "page_id", "node_ord", "kind", "raw_value", "confidence", "treatment", "source"
)
_UNREAD = """SELECT page_id, node_ord, tag FROM nodes_synth
  WHERE tag IN ('img', 'canvas') AND alt = '' AND (tag = 'canvas' OR (w > 30 AND h > 30))"""
SQL["unverified_media"] = V.with_views(
    ["nodes_synth"],
    f"""SELECT page_id, node_ord, 'UNVERIFIED_VISUAL_REGION' AS kind, '[UNVERIFIED_' || upper(tag) || ']' AS raw_value, 0.5 :: DOUBLE AS confidence,
      'REMOVE' AS treatment, CASE tag WHEN 'img' THEN 'IMAGE_TEXT' ELSE 'CANVAS_TEXT' END AS source FROM ({_UNREAD})""",
)


def privacy_state(spark, d):
    nodes = V.nodes_synth(spark, d)
    pages = V.table(spark, d, "pages")
    failed = pages.filter(F.col("page_id") % 41 == 0)
    return detect.privacy_state(pages, detect.media_entities(nodes), failed)


Q["privacy_state"] = privacy_state
SQL["privacy_state"] = V.with_views(
    ["nodes_synth"],
    """SELECT page_id, CASE WHEN page_id % 41 = 0 THEN 'VISUAL_PRIVACY_UNVERIFIED' WHEN coalesce(found, false) THEN 'PII_DETECTED'
        WHEN coalesce(unread, 0) > 0 THEN 'VISUAL_PRIVACY_UNVERIFIED' ELSE 'VERIFIED_SAFE' END AS state,
        coalesce(unread, 0) + CASE WHEN page_id % 41 = 0 THEN 1 ELSE 0 END AS unverified_regions
      FROM pages LEFT JOIN (SELECT page_id, count(*) AS unread FROM unread GROUP BY page_id) USING (page_id)
        LEFT JOIN (SELECT page_id, true AS found FROM found GROUP BY page_id) USING (page_id)""",
    {
        "unread": _UNREAD,
        "found": region_sql("(SELECT * FROM nodes_synth WHERE tag IN ('img', 'canvas') AND alt <> '')", "page_id, node_ord", "alt"),
    },
)


def fuse_sources(spark, d):
    pred = V.boxes_pred(spark, d).select("image_id", F.col("pred_id").alias("id"), "cls", "x", "y", "w", "h")
    model = pred.filter(F.col("image_id") % 3 != 0).withColumn("source", F.lit("model"))
    gt = V.boxes_gt(spark, d).select("image_id", F.col("gt_id").alias("id"), "cls", "x", "y", "w", "h")
    fallback = gt.withColumn("source", F.lit("fallback"))
    ocr = gt.filter("cls = 3").withColumn("source", F.lit("ocr"))
    fused = detect.fuse_sources(model, fallback, ocr, fallback_only_when_empty=True)
    return fused.groupBy("image_id", "source").agg(F.count("*").alias("boxes"), F.sum("x").alias("sum_x"))


Q["fuse_sources"] = fuse_sources
SQL["fuse_sources"] = V.with_views(
    ["boxes_pred"],
    """SELECT image_id, source, count(*) AS boxes, CAST(sum(x) AS BIGINT) AS sum_x FROM (
      SELECT image_id, 'model' AS source, x FROM boxes_pred WHERE image_id % 3 <> 0
      UNION ALL SELECT image_id, 'fallback', x FROM boxes_gt
        WHERE image_id NOT IN (SELECT image_id FROM boxes_pred WHERE image_id % 3 <> 0)
      UNION ALL SELECT image_id, 'ocr', x FROM boxes_gt WHERE cls = 3) GROUP BY ALL""",
)
