"""Sources, sinks and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.plans import views as V
from veilgrain.session import fresh_path
from veilgrain.sources import html, tables
from veilgrain.streaming.streams import drain

Q = {}
SQL = {}


def read_table(spark, d):
    docs = tables.read_table(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


Q["read_table"] = read_table
SQL["read_table"] = "SELECT lang, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang"


def flatten_samples(spark, d):
    return tables.flatten_samples(V.samples(spark, d))


Q["flatten_samples"] = flatten_samples
SQL["flatten_samples"] = """SELECT CAST(vec_id AS VARCHAR) AS image_id, 1920 AS vp_w, 1080 AS vp_h, CAST(i AS INTEGER) AS gt_ord,
    'a' || i AS gt_id, 'c' || (i % 3) AS cls,
    floor(abs(CAST(embedding[i * 4 + 1] AS DOUBLE)) * 1000) AS x, floor(abs(CAST(embedding[i * 4 + 2] AS DOUBLE)) * 1000) AS y,
    floor(abs(CAST(embedding[i * 4 + 3] AS DOUBLE)) * 1000) AS w, floor(abs(CAST(embedding[i * 4 + 4] AS DOUBLE)) * 1000) AS h
  FROM (SELECT *, unnest(range(len(embedding) // 4)) AS i FROM embeddings)"""

BODY_TAGS = ("nav", "ul", "li", "a", "div", "article", "h1", "p", "b", "br", "footer")


def page_nodes(spark, d):
    nodes = html.page_nodes(tables.read_table(spark, d, "pages"))
    return nodes.groupBy("tag").agg(
        F.count("*").alias("nodes"), F.count_if("is_clickable").alias("clickable")
    )


Q["page_nodes"] = page_nodes
SQL["page_nodes"] = """SELECT tag, count(*) AS nodes, count(*) FILTER (WHERE tag IN ('a', 'button')) AS clickable
  FROM (SELECT unnest(regexp_extract_all(regexp_replace(html, '^.*<body[^>]*>', '', 's'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages)
  WHERE tag NOT IN ('script', 'style', 'noscript') GROUP BY tag"""


#: One row per element of a body: the piece of markup after each "<" that opens one, and the piece that follows.
_PIECES = """SELECT page_id, n, piece, row_number() OVER (PARTITION BY page_id ORDER BY n) AS node_ord, nxt FROM (
    SELECT page_id, n, piece, lead(piece) OVER (PARTITION BY page_id ORDER BY n) AS nxt FROM (
      SELECT page_id, unnest(range(len(p))) AS n, unnest(p) AS piece FROM (
        SELECT page_id, string_split(regexp_replace(html, '^.*<body[^>]*>', '', 's'), '<') AS p FROM {pages})))
  WHERE regexp_matches(piece, '^[a-z][a-z0-9]*')"""
_ATTRIBUTE = """coalesce(regexp_extract(piece, '^[^>]* {name}="([^"]*)"', 1), '')"""


def _nodes_sql(pages: str) -> str:
    """Leaves are elements that the next piece of markup ends: by their own end tag, or, for a paragraph, by a block."""
    return f"""SELECT page_id, CAST(node_ord AS INTEGER) AS node_ord, tag, tag IN ('a', 'button') AS is_clickable, tag IN ('input', 'textarea', 'select') AS is_input,
      CASE WHEN tag = 'input' THEN coalesce(nullif({_ATTRIBUTE.format(name='value')}, ''), {_ATTRIBUTE.format(name='placeholder')})
        WHEN tag IN ('br', 'img') THEN '' WHEN starts_with(nxt, '/') OR (tag = 'p' AND regexp_matches(nxt, '^(p|article|div|footer|form|ul|nav|h1)[ >]'))
        THEN replace(replace(replace(replace(replace(replace(trim(regexp_replace(piece, '^[^>]*>', ''), chr(32) || chr(10) || chr(9)),
          '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') ELSE '' END AS text,
      {_ATTRIBUTE.format(name='href')} AS href, CAST(len(list_filter(regexp_extract_all(regexp_extract(piece, '^[^>]*'), ' ([a-z-]+)=', 1), lambda x: x NOT IN ('style', 'class', 'onclick'))) AS BIGINT) AS n_attributes
    FROM (SELECT *, regexp_extract(piece, '^[a-z][a-z0-9]*') AS tag FROM ({_PIECES.format(pages=pages)}))"""


def page_elements(spark, d):
    nodes = html.page_nodes(tables.read_table(spark, d, "pages"))
    return nodes.select(
        "page_id", "node_ord", "tag", "is_clickable", "is_input", "text",
        F.coalesce(F.col("attributes")["href"], F.lit("")).alias("href"), F.size("attributes").cast("long").alias("n_attributes"),
    )


Q["page_elements"] = page_elements
SQL["page_elements"] = _nodes_sql("pages")


def write_report(spark, d):
    labels = tables.read_table(spark, d, "labels")
    path = fresh_path(spark, "report")
    report = labels.groupBy("quality", "toxic").agg(F.count("*").alias("docs"))
    tables.write_report(report, path, partition_by=["quality"])
    return spark.read.schema("docs long, toxic int, quality int").parquet(path)


Q["write_report"] = write_report
SQL["write_report"] = "SELECT quality, toxic, count(*) AS docs FROM labels GROUP BY ALL"


def stream_table(spark, d):
    events = tables.stream_table(spark, d, "events")
    out = drain(events.select("event_id", "event_type", "user_id"), "stream-table")
    return out.groupBy("event_type").agg(
        F.count("*").alias("events"), F.sum("event_id").alias("id_sum")
    )


Q["stream_table"] = stream_table
SQL["stream_table"] = "SELECT event_type, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY ALL"


def decode_slots(spark, d):
    dets = tables.decode_slots(V.slots(spark, d))
    return dets.withColumn("conf", F.round("conf", 6))


Q["decode_slots"] = decode_slots
SQL["decode_slots"] = V.with_views(
    ["slots"],
    """SELECT image_id, slot, CAST(abs(CAST(floor(v[6] + 0.5) AS BIGINT)) % 11 AS INTEGER) AS cls,
      round(1.0 / (1.0 + exp(-v[5])), 6) AS conf, CAST(floor(x1 * 1920 + 0.5) AS BIGINT) AS x, CAST(floor(y1 * 1080 + 0.5) AS BIGINT) AS y,
      greatest(15, CAST(floor(abs(x2 - x1) * 1920 + 0.5) AS BIGINT)) AS w, greatest(15, CAST(floor(abs(y2 - y1) * 1080 + 0.5) AS BIGINT)) AS h
    FROM (SELECT *, greatest(0.0, least(1.0, v[1])) AS x1, greatest(0.0, least(1.0, v[2])) AS y1,
            greatest(0.0, least(1.0, v[3])) AS x2, greatest(0.0, least(1.0, v[4])) AS y2 FROM slots)
    WHERE 1.0 / (1.0 + exp(-v[5])) >= 0.30""",
)


def content_manifest(spark, d):
    return tables.content_manifest(tables.read_table(spark, d, "documents"), ["doc_id"])


Q["content_manifest"] = content_manifest
_DIGEST = """sha256('lang,n_chars,source,text' || '|' || coalesce(length(lang) || ':' || lang, '-') || '|'
    || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || '|' || coalesce(length(source) || ':' || source, '-') || '|'
    || coalesce(length(text) || ':' || text, '-'))"""
SQL["content_manifest"] = f"SELECT doc_id, {_DIGEST} AS digest FROM documents"


def manifest_diff(spark, d):
    docs = tables.read_table(spark, d, "documents")
    later = docs.filter(F.col("doc_id") % 17 != 0).withColumn(
        "text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    )
    added = docs.filter(F.col("doc_id") % 23 == 0).withColumn("doc_id", -F.col("doc_id") - 1)
    before = tables.content_manifest(docs, ["doc_id"])
    after = tables.content_manifest(later.unionByName(added), ["doc_id"])
    return tables.manifest_diff(before, after, ["doc_id"]).select("doc_id", "status")


Q["manifest_diff"] = manifest_diff
SQL["manifest_diff"] = """SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'REMOVED' WHEN doc_id % 10 = 0 THEN 'CHANGED' ELSE 'SAME' END AS status
  FROM documents UNION ALL SELECT -doc_id - 1, 'ADDED' FROM documents WHERE doc_id % 23 = 0"""


def sample_manifest_join(spark, d):
    docs = tables.read_table(spark, d, "documents").select("doc_id", "source")
    joined = tables.sample_manifest_join(docs, tables.read_table(spark, d, "labels"), ["doc_id"])
    return joined.groupBy("source").agg(
        F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.sum("quality").alias("good")
    )


Q["sample_manifest_join"] = sample_manifest_join
SQL["sample_manifest_join"] = """SELECT source, count(*) AS docs, count(quality) AS labelled, CAST(sum(quality) AS BIGINT) AS good
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source"""
