"""Detection evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain import constants as K
from veilgrain.operators import evaluate as E
from veilgrain.plans import views as V
from veilgrain.plans.geometry_queries import INTER_SQL, IOU_SQL, NMS_KEPT, nms_ctes

Q = {}
SQL = {}

_gt, _pred = V.boxes_gt, V.boxes_pred
PAIRS = f"""SELECT a.image_id, gt_id, a.cls, a.w, a.h, pred_id, b.cls AS pred_cls, conf, {IOU_SQL} AS iou FROM boxes_gt a JOIN boxes_pred b ON a.image_id = b.image_id,
    LATERAL (SELECT {INTER_SQL} AS i) WHERE i > 0"""
BEST = """SELECT g.image_id, g.gt_id, g.cls, g.w, g.h, coalesce(iou, 0.0) AS best_iou, pred_id, pred_cls, conf AS pred_conf FROM boxes_gt g LEFT JOIN (
    SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY image_id, gt_id ORDER BY iou DESC, pred_id) = 1) USING (image_id, gt_id)"""
GREEDY = """SELECT *, coalesce(iou >= 0.3 AND row_number() OVER (PARTITION BY image_id, gt_id, iou >= 0.3 ORDER BY pred_id) = 1, false) AS tp FROM (
    SELECT p.image_id, p.pred_id, p.cls, coalesce(iou, 0.0) AS iou, gt_id, gt_cls FROM boxes_pred p LEFT JOIN (
      SELECT image_id, pred_id, gt_id, cls AS gt_cls, iou FROM pairs QUALIFY row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, gt_id) = 1) USING (image_id, pred_id))"""
CTX = {"pairs": PAIRS, "best": BEST, "greedy": GREEDY}


def sql(body: str, more: dict | None = None) -> str:
    return V.with_views(["boxes_pred"], body, {**CTX, **(more or {})})


def best(spark, d):
    return E.best_match(_gt(spark, d), _pred(spark, d))


def greedy(spark, d):
    return E.greedy_match(_gt(spark, d), _pred(spark, d))


Q["best_match"] = lambda spark, d: best(spark, d).select("gt_id", F.round("best_iou", 6).alias("best_iou"), "pred_id", "pred_cls")
SQL["best_match"] = sql("SELECT gt_id, round(best_iou, 6) AS best_iou, pred_id, pred_cls FROM best")
Q["best_match_same_class"] = lambda spark, d: E.best_match(_gt(spark, d), _pred(spark, d), same_class=True).select("gt_id", "pred_id")
SQL["best_match_same_class"] = sql("""SELECT g.gt_id, pred_id FROM boxes_gt g LEFT JOIN (SELECT * FROM pairs WHERE cls = pred_cls
  QUALIFY row_number() OVER (PARTITION BY image_id, gt_id ORDER BY iou DESC, pred_id) = 1) USING (image_id, gt_id)""")
Q["greedy_match"] = lambda spark, d: greedy(spark, d).select("pred_id", "gt_id", "tp")
SQL["greedy_match"] = sql("SELECT pred_id, gt_id, tp FROM greedy")

COUNTS = """SELECT cls, CAST(sum(g) AS BIGINT) AS gt, CAST(sum(t) AS BIGINT) AS tp, CAST(sum(f) AS BIGINT) AS fp, CAST(sum(g) - sum(t) AS BIGINT) AS fn, sum(s) AS iou_sum FROM (
    SELECT unnest(range(11)) AS cls, 0 AS g, 0 AS t, 0 AS f, 0.0 AS s UNION ALL SELECT cls, 1, 0, 0, 0.0 FROM boxes_gt
    UNION ALL SELECT CASE WHEN tp THEN gt_cls ELSE cls END, 0, tp :: INT, (NOT tp) :: INT, CASE WHEN tp THEN iou ELSE 0.0 END FROM greedy) GROUP BY cls"""
_RATES = """CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS r"""
_F1 = "round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1"
Q["pr_f1"] = lambda spark, d: E.pr_f1(E.class_counts(_gt(spark, d), greedy(spark, d)))
SQL["pr_f1"] = sql(
    f"SELECT tp, fp, fn, {_F1} FROM (SELECT *, {_RATES} FROM (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM counts))", {"counts": COUNTS}
)
Q["per_class_metrics"] = lambda spark, d: E.per_class_metrics(_gt(spark, d), greedy(spark, d))
_PER_CLASS = f"""SELECT CAST(cls AS INTEGER) AS cls, tp, fp, fn, {_F1}, gt, CASE WHEN tp > 0 THEN round(iou_sum / tp, 6) ELSE 0.0 END AS mean_iou,
    round(round(p, 6) * round(r, 6), 4) AS ap_proxy FROM (SELECT *, {_RATES} FROM counts)"""
SQL["per_class_metrics"] = sql("SELECT * FROM pc", {"counts": COUNTS, "pc": _PER_CLASS})
Q["worst_class"] = lambda spark, d: E.worst_class(E.per_class_metrics(_gt(spark, d), greedy(spark, d)))
SQL["worst_class"] = sql("SELECT cls, recall FROM pc WHERE gt > 0 ORDER BY recall, cls LIMIT 1", {"counts": COUNTS, "pc": _PER_CLASS})

Q["iou_stats"] = lambda spark, d: E.iou_stats(best(spark, d))
SQL["iou_stats"] = sql("""SELECT count(*) AS matched, round(avg(best_iou), 6) AS mean_iou, round(quantile_cont(best_iou, 0.5), 6) AS median_iou,
  round(quantile_cont(best_iou, 0.95), 6) AS p95_iou FROM best WHERE best_iou >= 0.3""")

_BUCKETS = {
    "area": "CASE WHEN w * h < 1024 THEN 'tiny' WHEN w * h < 4096 THEN 'small' WHEN w * h < 16384 THEN 'medium' ELSE 'large' END",
    "dim": "CASE WHEN greatest(w, h) < 8 THEN '<8' WHEN greatest(w, h) < 16 THEN '8-16' WHEN greatest(w, h) < 32 THEN '16-32' WHEN greatest(w, h) < 64 THEN '32-64' WHEN greatest(w, h) < 128 THEN '64-128' ELSE '>=128' END",
    "density": "CASE WHEN density < 10 THEN 'low' WHEN density <= 25 THEN 'medium' ELSE 'high' END",
    "density5": "CASE WHEN density <= 5 THEN '1-5' WHEN density <= 10 THEN '6-10' WHEN density <= 20 THEN '11-20' WHEN density <= 40 THEN '21-40' ELSE '>40' END",
    "viewport": "CAST(vp_w AS VARCHAR) || 'x' || vp_h",
}
_VP = "CASE image_id % 3 WHEN 0 THEN 1920 WHEN 1 THEN 1440 ELSE 390 END AS vp_w, CASE image_id % 3 WHEN 0 THEN 1080 WHEN 1 THEN 900 ELSE 844 END AS vp_h"


def _buckets(kind):
    def run(spark, d):
        rows = best(spark, d)
        if kind == "viewport":
            k = F.col("image_id") % 3
            rows = rows.withColumn("vp_w", V._pick((1920, 1440, 390), k)).withColumn("vp_h", V._pick((1080, 900, 844), k))
        return E.bucket_recall(rows, kind)

    return run


for _kind, _expr in _BUCKETS.items():
    Q[f"bucket_recall_{_kind}"] = _buckets(_kind)
    SQL[f"bucket_recall_{_kind}"] = sql(
        f"""SELECT {_expr} AS bucket, count(*) AS gt, count(*) FILTER (best_iou >= 0.3) AS tp, round(count(*) FILTER (best_iou >= 0.3) / count(*), 6) AS recall
          FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS density, {_VP} FROM best) GROUP BY 1"""
    )

Q["threshold_sweep"] = lambda spark, d: E.threshold_sweep(_gt(spark, d), _pred(spark, d), K.SWEEP_THRESHOLDS).drop("missed_with_candidate", "candidate_pct")
Q["missed_with_candidate"] = lambda spark, d: E.threshold_sweep(_gt(spark, d), _pred(spark, d)).select("threshold", "fn", "missed_with_candidate", "candidate_pct")


def _sweep_sql(thrs):
    return {
        "thr": "SELECT unnest([" + ", ".join(f"{t} :: DOUBLE" for t in thrs) + "]) AS t",
        "m": """SELECT t, image_id, gt_id, pred_id FROM thr JOIN pairs ON conf >= t AND iou >= 0.3
            QUALIFY row_number() OVER (PARTITION BY t, image_id, gt_id ORDER BY iou DESC, pred_id) = 1""",
        "sweep": """SELECT t AS threshold, tp, np - used AS fp, ng - tp AS fn, CASE WHEN tp + np - used > 0 THEN tp / (tp + np - used) ELSE 1.0 END AS p, tp / ng AS r, reach - tp AS mwc FROM (
            SELECT t, (SELECT count(*) FROM m WHERE m.t = thr.t) AS tp, (SELECT count(DISTINCT (image_id, pred_id)) FROM m WHERE m.t = thr.t) AS used,
              (SELECT count(*) FROM boxes_pred WHERE conf >= thr.t) AS np, (SELECT count(*) FROM boxes_gt) AS ng,
              (SELECT count(DISTINCT gt_id) FROM pairs WHERE iou >= 0.3) AS reach FROM thr)""",
    }


SQL["threshold_sweep"] = sql(f"SELECT threshold, tp, fp, fn, {_F1} FROM sweep", _sweep_sql(K.SWEEP_THRESHOLDS))
SQL["missed_with_candidate"] = sql(
    "SELECT threshold, fn, mwc AS missed_with_candidate, CASE WHEN fn > 0 THEN round(mwc / fn * 100, 2) ELSE 0.0 END AS candidate_pct FROM sweep",
    _sweep_sql(K.CALIBRATION_THRESHOLDS),
)
Q["best_threshold"] = lambda spark, d: E.best_threshold(E.threshold_sweep(_gt(spark, d), _pred(spark, d)))
SQL["best_threshold"] = sql(
    f"SELECT threshold, f1 FROM (SELECT threshold, {_F1} FROM sweep) ORDER BY f1 DESC, threshold LIMIT 1", _sweep_sql(K.CALIBRATION_THRESHOLDS)
)

Q["duplicate_matches"] = lambda spark, d: E.duplicate_matches(best(spark, d)).select("gt_id", "pred_id")
SQL["duplicate_matches"] = sql("SELECT gt_id, pred_id FROM best WHERE best_iou >= 0.3 QUALIFY row_number() OVER (PARTITION BY image_id, pred_id ORDER BY gt_id) > 1")

_FAIL = {
    "causes": """CASE WHEN pred_id IS NULL OR best_iou < 0.1 THEN CASE WHEN greatest(w, h) < 32 THEN 'small_object_loss' WHEN cls = 1 THEN 'low_contrast_failure'
        WHEN density > 25 THEN 'dense_layout_failure' ELSE 'missed_completely' END WHEN pred_conf < 0.3 THEN 'confidence_below_threshold'
        WHEN pred_cls <> cls THEN CASE WHEN cls = 1 AND pred_cls IN (7, 10, 0) THEN 'visually_similar_class_confusion' ELSE 'wrong_class' END
        WHEN best_iou < 0.3 THEN 'localization_failure' ELSE 'duplicate_suppression' END""",
    "short": "CASE WHEN w * h < 4096 THEN 'SMALL_OBJECT' WHEN density > 25 THEN 'DENSE_LAYOUT' ELSE 'BOUNDING_BOX_ERROR' END",
    "grades": """CASE WHEN greatest(w, h) < 16 OR w * h < 256 THEN 'A_representation_loss' WHEN best_iou >= 0.5 AND pred_cls = cls AND pred_conf >= 0.3 THEN 'G_correct_detection'
        WHEN best_iou >= 0.5 AND pred_cls = cls THEN 'B_low_confidence' WHEN best_iou >= 0.5 THEN 'C_wrong_class' WHEN best_iou >= 0.15 THEN 'D_localization_failure' ELSE 'F_grid_collision' END""",
}
for _scheme, _expr in _FAIL.items():
    Q[f"failure_taxonomy_{_scheme}"] = lambda spark, d, s=_scheme: E.failure_shares(E.failure_taxonomy(_gt(spark, d), _pred(spark, d), s))
    _where = "" if _scheme == "grades" else "WHERE (image_id, gt_id) NOT IN (SELECT (image_id, gt_id) FROM pairs WHERE conf >= 0.3 AND iou >= 0.3)"
    if _scheme == "causes":
        _where = _where.replace("0.3)", "0.3 AND (image_id, pred_id) IN (SELECT (image_id, pred_id) FROM survivors))")
    _more = {**nms_ctes("image_id, cls", "r.cls = s.cls", "conf >= 0.3"), "survivors": NMS_KEPT} if _scheme == "causes" else {}
    SQL[f"failure_taxonomy_{_scheme}"] = sql(
        f"""SELECT reason, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct FROM (SELECT {_expr} AS reason FROM (
          SELECT *, count(*) OVER (PARTITION BY image_id) AS density FROM best) {_where}) GROUP BY reason""",
        _more,
    )


def top_failures(spark, d):
    missed = E.failure_taxonomy(_gt(spark, d), _pred(spark, d), "short")
    return E.top_failures(missed, 20, ["image_id", "gt_id"]).select("image_id", "gt_id", "reason")


Q["top_failures"] = top_failures
SQL["top_failures"] = sql(
    f"""SELECT image_id, gt_id, {_FAIL['short']} AS reason FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS density FROM best)
      WHERE (image_id, gt_id) NOT IN (SELECT (image_id, gt_id) FROM pairs WHERE conf >= 0.3 AND iou >= 0.3) ORDER BY image_id, gt_id LIMIT 20"""
)

Q["confusion"] = lambda spark, d: E.confusion(best(spark, d))
SQL["confusion"] = sql("SELECT cls, CASE WHEN best_iou >= 0.15 THEN pred_cls END AS predicted, count(*) AS n FROM best GROUP BY ALL")

AP_IOUS = tuple(round(0.50 + 0.05 * i, 2) for i in range(10))
Q["average_precision"] = lambda spark, d: E.average_precision(_gt(spark, d), _pred(spark, d), AP_IOUS)
_AP = {
    "own": "SELECT * FROM pairs WHERE cls = pred_cls QUALIFY row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, gt_id) = 1",
    "cut": "SELECT unnest([" + ", ".join(f"{t} :: DOUBLE" for t in AP_IOUS) + "]) AS iou_thr",
    "won": """SELECT iou_thr, pred_id FROM own JOIN cut ON iou >= iou_thr QUALIFY row_number() OVER (PARTITION BY iou_thr, image_id, gt_id ORDER BY conf DESC, pred_id) = 1""",
    "step": """SELECT iou_thr, cls, conf, count(w.pred_id) AS tp, count(*) AS n FROM boxes_pred JOIN cut ON true LEFT JOIN won w USING (iou_thr, pred_id) GROUP BY ALL""",
    "curve": "SELECT *, sum(tp) OVER w / sum(n) OVER w AS pr FROM step WINDOW w AS (PARTITION BY iou_thr, cls ORDER BY conf DESC)",
    "env": "SELECT *, max(pr) OVER (PARTITION BY iou_thr, cls ORDER BY conf) AS e FROM curve",
    "ap": """SELECT iou_thr, CAST(g.cls AS INTEGER) AS cls, gt, round(coalesce(area, 0.0) / gt, 6) AS ap FROM (SELECT cls, count(*) AS gt FROM boxes_gt GROUP BY cls) g JOIN cut ON true
      LEFT JOIN (SELECT iou_thr, cls, sum(tp * e) AS area FROM env GROUP BY ALL) USING (iou_thr, cls)""",
}
SQL["average_precision"] = sql("SELECT * FROM ap", _AP)
Q["mean_average_precision"] = lambda spark, d: E.mean_average_precision(E.average_precision(_gt(spark, d), _pred(spark, d), AP_IOUS))
SQL["mean_average_precision"] = sql("SELECT iou_thr, count(*) AS classes, round(avg(ap), 5) AS map FROM ap GROUP BY iou_thr", _AP)

Q["detect_vs_localise"] = lambda spark, d: E.detect_vs_localise(best(spark, d))
SQL["detect_vs_localise"] = sql("""SELECT cls, count(*) AS total, count(*) FILTER (best_iou >= 0.3) AS detected,
  count(*) FILTER (best_iou >= 0.3 AND pred_cls = cls) AS correct_class, count(*) FILTER (best_iou >= 0.5) AS localised FROM best GROUP BY cls""")


def compare_configs(spark, d):
    rows = best(spark, d).withColumn("config", V._pick(("full", "tiled", "hybrid"), F.col("image_id") % 3))
    rows = rows.withColumn("recall", (F.col("best_iou") >= 0.30).cast("double")).withColumn("iou", F.col("best_iou"))
    return E.compare_configs(rows, "config", "full", ["recall", "iou"])


Q["compare_configs"] = compare_configs
SQL["compare_configs"] = sql(
    """SELECT config, recall, iou, round(recall - br, 6) AS recall_delta, round(iou - bi, 6) AS iou_delta FROM c, (SELECT recall AS br, iou AS bi FROM c WHERE config = 'full')""",
    {"c": """SELECT CASE image_id % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'tiled' ELSE 'hybrid' END AS config, round(avg(CASE WHEN best_iou >= 0.3 THEN 1.0 ELSE 0.0 END :: DOUBLE), 6) AS recall,
        round(avg(best_iou), 6) AS iou FROM best GROUP BY 1"""},
)


Q["compare_detectors"] = lambda spark, d: E.compare_detectors(_gt(spark, d), E.detector_configs(_pred(spark, d), "pred_id", 1600, 900))
_CONFIGS = {
    "cut": """SELECT image_id, pred_id || '/' || tile AS pred_id, cls, conf, l AS x, u AS y, r - l AS w, d - u AS h FROM (
      SELECT image_id, pred_id, cls, conf, tile, greatest(x, tx) AS l, least(x + w, tx + 800) AS r, greatest(y, ty) AS u, least(y + h, ty + 450) AS d
      FROM boxes_pred, (VALUES (0, 0, 0), (1, 800, 0), (2, 0, 450), (3, 800, 450)) t(tile, tx, ty)) WHERE r > l AND d > u""",
    "whole": "SELECT image_id, pred_id || '/f' AS pred_id, cls, conf, x, y, w, h FROM boxes_pred",
    "rough": """SELECT image_id * 3 + 1 AS image_id, * EXCLUDE image_id FROM cut UNION ALL SELECT image_id * 3 + 2, * EXCLUDE image_id FROM cut
      UNION ALL SELECT image_id * 3 + 2, * EXCLUDE image_id FROM whole""",
    **nms_ctes("image_id, cls", "r.cls = s.cls", source="rough"),
    "runs": f"""SELECT image_id * 3 AS image_id, * EXCLUDE image_id FROM whole UNION ALL SELECT * FROM rough WHERE (image_id, pred_id) IN ({NMS_KEPT})""",
    "truth": "SELECT image_id * 3 + k AS image_id, gt_id, cls, x, y, w, h, k FROM boxes_gt, (SELECT unnest([0, 1, 2]) AS k)",
    "claim": f"""SELECT * FROM (SELECT a.image_id, gt_id, pred_id, {IOU_SQL} AS iou FROM truth a JOIN runs b ON a.image_id = b.image_id, LATERAL (SELECT {INTER_SQL} AS i) WHERE i > 0)
      QUALIFY row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, gt_id) = 1""",
    "found": """SELECT k, cls, greatest(w, h) < 32 AS small, (image_id, gt_id) IN (SELECT (image_id, gt_id) FROM claim WHERE iou >= 0.3) AS hit FROM truth""",
    "rated": """SELECT k, cls, count(*) AS gt, count(*) FILTER (hit) AS tp, round(count(*) FILTER (hit) / count(*), 6) AS recall,
      round(count(*) FILTER (hit AND small) / nullif(count(*) FILTER (small), 0), 6) AS small_recall FROM found GROUP BY GROUPING SETS ((k), (k, cls))""",
}
SQL["compare_detectors"] = V.with_views(
    ["boxes_pred"],
    """SELECT ['full', 'tiled', 'hybrid'][r.k + 1] AS config, CAST(r.cls AS INTEGER) AS cls, r.gt, r.tp, r.recall, r.small_recall, round(r.recall - f.recall, 6) AS recall_delta
      FROM rated r JOIN rated f ON f.k = 0 AND r.cls IS NOT DISTINCT FROM f.cls""",
    _CONFIGS,
)


def quality_gates(spark, d):
    rated = E.pr_f1(E.class_counts(_gt(spark, d), greedy(spark, d)))
    long = rated.select(F.explode(F.create_map(F.lit("precision"), "precision", F.lit("recall"), "recall", F.lit("f1"), "f1")).alias("metric", "value"))
    rules = spark.createDataFrame(
        [("precision", ">=", 0.85), ("recall", ">=", 0.99), ("f1", "<=", 1.0), ("map", ">=", 0.5)], "metric string, op string, threshold double"
    )
    return E.quality_gates(long, rules)


Q["quality_gates"] = quality_gates
SQL["quality_gates"] = sql(
    f"""SELECT metric, op, threshold, value, coalesce(CASE op WHEN '>=' THEN value >= threshold WHEN '<=' THEN value <= threshold ELSE value = threshold END, false) AS passed
      FROM (VALUES ('precision', '>=', 0.85 :: DOUBLE), ('recall', '>=', 0.99), ('f1', '<=', 1.0), ('map', '>=', 0.5)) r(metric, op, threshold) LEFT JOIN (
        SELECT 'precision' AS metric, precision AS value FROM o UNION ALL SELECT 'recall', recall FROM o UNION ALL SELECT 'f1', f1 FROM o) USING (metric)""",
    {"counts": COUNTS, "o": f"SELECT {_F1} FROM (SELECT *, {_RATES} FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM counts))"},
)

Q["latency_stats"] = lambda spark, d: E.latency_stats(V.table(spark, d, "events"), "value", ["event_type"])
SQL["latency_stats"] = """SELECT event_type, count(*) AS n, round(avg(value), 2) AS mean, max(value) FILTER (rn = n_ // 2 + 1) AS median,
    max(value) FILTER (rn = ceil(0.95 * n_)) AS p95, max(value) FILTER (rn = ceil(0.99 * n_)) AS p99, min(value) AS min, max(value) AS max
  FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n_ FROM events) GROUP BY event_type"""


def stage_breakdown(spark, d):
    ev = V.table(spark, d, "events")
    marks = ev.select(
        F.expr("event_id div 10").alias("run"), (F.col("event_id") % 10).alias("stage"),
        ((F.col("event_id") % 10 + 1) * 100.0 + F.col("event_id") % 37).alias("mark"),
    )
    return E.stage_breakdown(marks, "run", "stage", "mark")


Q["stage_breakdown"] = stage_breakdown
SQL["stage_breakdown"] = """SELECT stage, count(*) AS runs, round(sum(d) / count(*), 4) AS mean, round(sum(d) / sum(sum(d)) OVER () * 100, 4) AS share_pct FROM (
  SELECT stage, mark - coalesce(lag(mark) OVER (PARTITION BY run ORDER BY stage), 0) AS d FROM (
    SELECT event_id // 10 AS run, event_id % 10 AS stage, (event_id % 10 + 1) * 100.0 :: DOUBLE + event_id % 37 AS mark FROM events)) GROUP BY stage"""


def _agreement(spark, d):
    a = V.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("v"))
    return E.vector_agreement(a, V.perturbed(spark, d), "vec_id")


Q["vector_agreement"] = lambda spark, d: _agreement(spark, d).select(
    "vec_id", F.round("cosine", 6).alias("cosine"), F.round("max_diff", 6).alias("max_diff"), F.round("mean_diff", 6).alias("mean_diff"), "matches"
)
_AGREE = {
    "pair": """SELECT p.vec_id, list_dot_product(a, v) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(v, v))) AS cosine,
      list_transform(range(1, len(a) + 1), lambda i: abs(a[i] - v[i])) AS dd FROM perturbed p JOIN (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings) e USING (vec_id)""",
    "rated": "SELECT vec_id, cosine, list_max(dd) AS max_diff, list_avg(dd) AS mean_diff, list_max(dd) < 1e-3 AND cosine > 0.999 AS matches FROM pair",
}
SQL["vector_agreement"] = V.with_views(
    ["perturbed"], "SELECT vec_id, round(cosine, 6) AS cosine, round(max_diff, 6) AS max_diff, round(mean_diff, 6) AS mean_diff, matches FROM rated", _AGREE
)
Q["agreement_verdict"] = lambda spark, d: E.agreement_verdict(_agreement(spark, d))
SQL["agreement_verdict"] = V.with_views(
    ["perturbed"],
    """SELECT count(*) AS pairs, count(*) FILTER (matches) AS matched, round(max(max_diff), 6) AS max_diff, round(avg(cosine), 6) AS mean_cosine,
      max(max_diff) < 1e-3 AND avg(cosine) >= 0.999 AND count(*) FILTER (matches) / count(*) >= 0.95 AS verified FROM rated""",
    _AGREE,
)
