"""Dataset audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.operators import audits as A
from veilgrain.plans import views as V

Q = {}
SQL = {}

Q["split_overlap"] = lambda spark, d: A.split_overlap(V.splits(spark, d), A.content_key("text")).select(
    "key", F.array_join("splits", ",").alias("splits"), "rows"
)
_OVER = "SELECT {k} AS key, list_sort(list_distinct(list(split))) AS s, count(*) AS rows FROM {t} GROUP BY 1 HAVING count(DISTINCT split) > 1"
SQL["split_overlap"] = V.with_views(
    ["splits"], "SELECT key, array_to_string(s, ',') AS splits, rows FROM o", {"o": _OVER.format(k="sha256(text)", t="splits")}
)
Q["split_pairs"] = lambda spark, d: A.split_pairs(A.split_overlap(V.splits(spark, d), A.content_key("text")))
SQL["split_pairs"] = V.with_views(
    ["splits"],
    """SELECT x.split AS a, y.split AS b, count(*) AS shared FROM k x JOIN k y ON x.key = y.key AND x.split < y.split GROUP BY ALL""",
    {"k": "SELECT DISTINCT sha256(text) AS key, split FROM splits"},
)
Q["template_overlap"] = lambda spark, d: A.template_overlap(V.splits(spark, d), "source").select("key", F.size("splits").alias("n_splits"), "rows")
SQL["template_overlap"] = V.with_views(["splits"], "SELECT key, CAST(len(s) AS INTEGER) AS n_splits, rows FROM o", {"o": _OVER.format(k="source", t="splits")})
Q["template_overlap_clean"] = lambda spark, d: A.template_overlap(V.splits(spark, d, leaky=False), "source").select("key", "rows")
SQL["template_overlap_clean"] = V.with_views(["splits_clean"], "SELECT key, rows FROM o", {"o": _OVER.format(k="source", t="splits_clean")})

Q["assign_splits"] = lambda spark, d: A.assign_splits(V.table(spark, d, "documents"), "source").select("doc_id", "split")
_PLACE = "CAST('0x' || substr(md5({k}), 1, 8) AS BIGINT) / 4294967296.0"
SQL["assign_splits"] = f"""SELECT doc_id, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'val' ELSE 'test' END AS split
  FROM (SELECT doc_id, {_PLACE.format(k='source')} AS p FROM documents)"""


def _split_boxes(spark, d):
    return A.assign_splits(V.boxes_gt(spark, d), "image_id")


Q["distribution_stats"] = lambda spark, d: A.distribution_stats(_split_boxes(spark, d), ["split"])
_DIST = {
    "b": f"""SELECT *, w * h AS area, CASE WHEN p < 0.7 THEN 'train' WHEN p < 0.85 THEN 'val' ELSE 'test' END AS split
      FROM (SELECT *, {_PLACE.format(k='CAST(image_id AS VARCHAR)')} AS p FROM boxes_gt)""",
    "st": """SELECT split, count(DISTINCT image_id) AS images, count(*) AS objects, round(count(*) / count(DISTINCT image_id), 2) AS density,
      round(avg(area), 1) AS mean_area, round(count(*) FILTER (area < 1024) / count(*) * 100, 2) AS small_pct, round(avg(w / greatest(1, h)), 2) AS mean_aspect,
      round(quantile_cont(area, 0.5), 1) AS median_area FROM b GROUP BY split""",
}
SQL["distribution_stats"] = V.with_views(["boxes_gt"], "SELECT * FROM st", _DIST)
Q["class_distribution"] = lambda spark, d: A.class_distribution(_split_boxes(spark, d), ["split"])
SQL["class_distribution"] = V.with_views(
    ["boxes_gt"], "SELECT split, cls, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split) * 100, 2) AS pct FROM b GROUP BY split, cls", _DIST
)
Q["domain_gap"] = lambda spark, d: A.domain_gap(A.distribution_stats(_split_boxes(spark, d), ["split"]), "split", "val", "train")
SQL["domain_gap"] = V.with_views(
    ["boxes_gt"],
    "SELECT " + ", ".join(f"round(v.{n} - t.{n}, 2) AS {n}_gap" for n in ("density", "small_pct", "mean_aspect", "mean_area", "median_area"))
    + " FROM st v, st t WHERE v.split = 'val' AND t.split = 'train'",
    _DIST,
)

Q["benchmark_leakage"] = lambda spark, d: A.benchmark_leakage(
    V.table(spark, d, "documents"), V.table(spark, d, "benchmark"), "doc_id", "item_id"
)
_W = "list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_G = "SELECT {k}, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' ')))) AS g FROM (SELECT {k}, " + _W + " AS w FROM {t}) WHERE len(w) >= 8"
SQL["benchmark_leakage"] = f"""WITH d AS ({_G.format(k='doc_id', t='documents')}), b AS ({_G.format(k='item_id', t='benchmark')}),
  t AS (SELECT item_id, count(*) AS grams FROM b GROUP BY item_id)
  SELECT doc_id, item_id, count(*) AS shared, any_value(grams) AS grams, round(count(*) / any_value(grams), 6) AS containment
  FROM d JOIN b USING (g) JOIN t USING (item_id) GROUP BY doc_id, item_id"""

Q["benchmark_containment"] = lambda spark, d: A.benchmark_containment(
    V.table(spark, d, "documents"), V.table(spark, d, "benchmark"), "doc_id", "item_id", least=0.3
)
SQL["benchmark_containment"] = f"SELECT * FROM ({SQL['benchmark_leakage']}) WHERE shared >= greatest(1, ceil(0.3 * grams))"
