"""Scoring detections against ground truth.

All pairs come from one grid join (``overlap_pairs``); every "first wins" rule
is a map-side combined ``min``. The match tables are worth keeping: callers
that derive several reports from one should write it out once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrain import constants as K
from veilgrain.functions import ranks as R
from veilgrain.operators.geometry import (
    grid_pairs, met_in_image, nms, overlap_pairs, overlapping, split_crowded, tile_grid, untile, with_iou,
)
from veilgrain.session import written

GT = ["image_id", "gt_id", "cls", "x", "y", "w", "h"]
PRED = ["image_id", "pred_id", "cls", "conf", "x", "y", "w", "h"]


def iou_pairs(gt: DataFrame, pred: DataFrame, same_class: bool = False, min_iou: float = 0.0) -> DataFrame:
    """Overlapping (ground truth, prediction) pairs with their IoU."""
    pairs = with_iou(overlap_pairs(gt.select(*GT), pred.select(*PRED))).filter(F.col("iou") > 0)
    if same_class:
        pairs = pairs.filter("a_cls = b_cls")
    return pairs.filter(F.col("iou") >= min_iou) if min_iou else pairs


def _met(a: DataFrame, b: DataFrame, same_class: bool) -> DataFrame:
    """Every row of ``a`` with what it overlaps in its calm image, with nulls and an ``iou`` of 0 where that is nothing."""
    meets = overlapping() & (F.col("a_cls") == F.col("b_cls")) if same_class else overlapping()
    rows = with_iou(met_in_image(a, b, meets, "left"))
    return rows.withColumn("iou", F.when(F.col("b_cls").isNotNull() | F.col("b_x").isNotNull(), F.col("iou")).otherwise(0.0))


def _grid_iou(gt: DataFrame, pred: DataFrame, same_class: bool) -> DataFrame:
    pairs = with_iou(grid_pairs(gt, pred)).filter(F.col("iou") > 0)
    return pairs.filter("a_cls = b_cls") if same_class else pairs


def best_match(gt: DataFrame, pred: DataFrame, same_class: bool = False) -> DataFrame:
    """Best prediction of every ground-truth box, the first one on ties.

    In calm images a box meets the predictions of its image in an outer join, and
    all that follows goes by image. In crowded ones, boxes without any overlap enter
    as rows of their own, so one aggregation serves both and no outer join follows.
    """
    (gt, pred), crowded = split_crowded(gt.select(*GT), pred.select(*PRED))
    met = _met(gt, pred, same_class)
    m = F.struct((-F.col("iou")).alias("neg"), F.col("b_pred_id").alias("pred_id"), F.col("b_cls").alias("pred_cls"), F.col("b_conf").alias("pred_conf"))
    best = met.groupBy("image_id", *[F.col(f"a_{c}").alias(c) for c in GT[1:]]).agg(F.min(m).alias("m"))
    if crowded is not None:
        best = best.unionByName(_best_on_grid(*crowded, same_class))
    return best.select(*GT, (-F.col("m.neg") + 0.0).alias("best_iou"), "m.pred_id", "m.pred_cls", "m.pred_conf")


def _best_on_grid(gt: DataFrame, pred: DataFrame, same_class: bool) -> DataFrame:
    pairs = _grid_iou(gt, pred, same_class)
    seen = pairs.select(
        "image_id",
        *[F.col(f"a_{c}").alias(c) for c in GT[1:]],
        F.struct(
            (-F.col("iou")).alias("neg"), F.col("b_pred_id").alias("pred_id"),
            F.col("b_cls").alias("pred_cls"), F.col("b_conf").alias("pred_conf"),
        ).alias("m"),
    )
    kind = dict(seen.dtypes)["m"]
    alone = gt.select(*GT, F.struct(F.lit(0.0), F.lit(None), F.lit(None), F.lit(None)).cast(kind).alias("m"))
    return seen.unionByName(alone).groupBy(*GT).agg(F.min("m").alias("m"))


def greedy_match(gt: DataFrame, pred: DataFrame, iou: float = K.MATCH_IOU, by_confidence: bool = False,
                 same_class: bool = False, run: str | None = None) -> DataFrame:
    """One-to-one matching, prediction by prediction.

    The best ground truth of a prediction does not depend on earlier matches, so
    the true positive of a box is simply its first claimant; no loop is needed. In calm
    images both steps go by image, after one shuffle. Where ``run`` names a column, the predictions
    are those of several runs, each of which is matched with all boxes of its image.
    """
    runs = [run] if run else []
    (gt, pred), crowded = split_crowded(gt.select(*GT), pred.select(*PRED, *runs), share=len(CONFIGS) if run else 1)
    met = _met(pred, gt, same_class)
    m = F.struct((-F.col("iou")).alias("neg"), F.col("b_gt_id").alias("gt_id"), F.col("b_cls").alias("gt_cls"))
    best = met.groupBy("image_id", *[F.col(f"a_{c}").alias(c) for c in CLAIMANT[1:] + runs]).agg(F.min(m).alias("m"))
    best = best.select(*CLAIMANT, *runs, (-F.col("m.neg") + 0.0).alias("iou"), "m.gt_id", "m.gt_cls")
    turn = F.struct((-F.col("conf")).alias("neg"), "pred_id") if by_confidence else F.struct("pred_id")
    claims = (F.col("iou") >= iou) & F.col("gt_id").isNotNull()
    first = F.min(F.when(claims, turn)).over(Window.partitionBy("image_id", *runs, "gt_id"))
    tp = claims & (F.col("_first.pred_id") == F.col("pred_id"))
    matched = best.withColumn("_first", first).withColumn("tp", F.coalesce(tp, F.lit(False))).drop("_first")
    return matched if crowded is None else matched.unionByName(_greedy_on_grid(*crowded, iou, turn, same_class, runs).select(*matched.columns))


CLAIMANT = ["image_id", "pred_id", "cls", "conf"]


def _greedy_on_grid(gt: DataFrame, pred: DataFrame, iou: float, turn: Column, same_class: bool, runs: list[str]) -> DataFrame:
    pairs = _grid_iou(gt, pred, same_class)
    seen = pairs.select(
        "image_id", F.col("b_pred_id").alias("pred_id"), F.col("b_cls").alias("cls"), F.col("b_conf").alias("conf"), *(F.col(f"b_{c}").alias(c) for c in runs),
        F.struct((-F.col("iou")).alias("neg"), F.col("a_gt_id").alias("gt_id"), F.col("a_cls").alias("gt_cls")).alias("m"),
    )
    kind = dict(seen.dtypes)["m"]
    alone = pred.select("image_id", "pred_id", "cls", "conf", *runs, F.struct(F.lit(0.0), F.lit(None), F.lit(None)).cast(kind).alias("m"))
    best = seen.unionByName(alone).groupBy("image_id", "pred_id", "cls", "conf", *runs).agg(F.min("m").alias("m"))
    best = best.select("image_id", "pred_id", "cls", "conf", *runs, (-F.col("m.neg") + 0.0).alias("iou"), "m.gt_id", "m.gt_cls")
    claims = best.filter(F.col("iou") >= iou).groupBy("image_id", *runs, "gt_id").agg(F.min(turn).alias("_first"))
    joined = best.join(claims, ["image_id", *runs, "gt_id"], "left")
    tp = (F.col("iou") >= iou) & (F.col("_first.pred_id") == F.col("pred_id"))
    return joined.withColumn("tp", F.coalesce(tp, F.lit(False))).drop("_first")


def class_counts(gt: DataFrame, matched: DataFrame) -> DataFrame:
    """``cls, gt, tp, fp, fn, iou_sum`` per class, classes without boxes included."""
    zero = F.lit(0).cast("long")
    table = gt.sparkSession.createDataFrame([(i,) for i in range(len(K.UI_CLASSES))], "cls int")
    rows = (
        table.select("cls", zero.alias("gt"), zero.alias("tp"), zero.alias("fp"), F.lit(0.0).alias("iou_sum"))
        .unionByName(gt.select("cls", F.lit(1).cast("long").alias("gt"), zero.alias("tp"), zero.alias("fp"), F.lit(0.0).alias("iou_sum")))
        .unionByName(
            matched.select(
                F.when(F.col("tp"), F.col("gt_cls")).otherwise(F.col("cls")).alias("cls"),
                zero.alias("gt"),
                F.col("tp").cast("long").alias("tp"),
                (~F.col("tp")).cast("long").alias("fp"),
                F.when(F.col("tp"), F.col("iou")).otherwise(0.0).alias("iou_sum"),
            )
        )
    )
    sums = rows.groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("gt", "tp", "fp", "iou_sum")])
    return sums.withColumn("fn", F.col("gt") - F.col("tp"))


def pr_f1(counts: DataFrame, by: list[str] | None = None, empty: float = 0.0) -> DataFrame:
    """Precision, recall and F1 from ``tp, fp, fn``; an empty denominator gives ``empty``."""
    sums = counts.groupBy(*(by or [])).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp = F.col("tp")

    def ratio(whole):
        return F.when(whole > 0, tp / whole).otherwise(F.lit(float(empty)))

    p, r = ratio(tp + F.col("fp")), ratio(tp + F.col("fn"))
    rated = sums.withColumn("_p", p).withColumn("_r", r)
    both = F.col("_p") + F.col("_r")
    f1 = F.when(both > 0, 2 * F.col("_p") * F.col("_r") / both).otherwise(0.0)
    return rated.select(
        *(by or []), "tp", "fp", "fn",
        F.round("_p", 6).alias("precision"), F.round("_r", 6).alias("recall"), F.round(f1, 6).alias("f1"),
    )


def per_class_metrics(gt: DataFrame, matched: DataFrame, empty: float = 0.0) -> DataFrame:
    """Per-class counts, ratios, mean matched IoU and the proxy ``ap_proxy`` = P * R."""
    counts = class_counts(gt, matched)
    rated = pr_f1(counts, ["cls"], empty)
    extra = counts.select("cls", "gt", F.when(F.col("tp") > 0, F.round(F.col("iou_sum") / F.col("tp"), 6)).otherwise(0.0).alias("mean_iou"))
    return rated.join(extra, "cls").withColumn("ap_proxy", F.round(F.col("precision") * F.col("recall"), 4))


def iou_stats(matches: DataFrame, iou: float = K.MATCH_IOU, exact: bool = True) -> DataFrame:
    """Mean, median and p95 (linear interpolation) of matched IoU.

    Exact ranks come from counted values sorted over the cluster; ``exact=False`` uses a sketch.
    """
    hit = matches.filter(F.col("best_iou") >= iou).select(F.col("best_iou").alias("v"))
    if not exact:
        return hit.agg(
            F.count("*").alias("matched"), F.round(F.avg("v"), 6).alias("mean_iou"),
            F.percentile_approx("v", 0.5).alias("median_iou"), F.percentile_approx("v", 0.95).alias("p95_iou"),
        )
    ranked = R.value_ranks(hit, [], "v")
    return ranked.agg(
        F.sum("n").alias("matched"),
        F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 6).alias("mean_iou"),
        F.round(R.linear_quantile("v", 0.5), 6).alias("median_iou"),
        F.round(R.linear_quantile("v", 0.95), 6).alias("p95_iou"),
    )


# --- buckets ----------------------------------------------------------------


def _ladder(value: Column, steps, last: str) -> Column:
    chain = None
    for limit, name in steps:
        chain = F.when(value < limit, name) if chain is None else chain.when(value < limit, name)
    return chain.otherwise(last)


AREA_STEPS = ((32 * 32, "tiny"), (64 * 64, "small"), (128 * 128, "medium"))
DIM_STEPS = ((8, "<8"), (16, "8-16"), (32, "16-32"), (64, "32-64"), (128, "64-128"))
DENSITY_STEPS = ((10, "low"), (26, "medium"))
DENSITY5_STEPS = ((6, "1-5"), (11, "6-10"), (21, "11-20"), (41, "21-40"))


def with_density(rows: DataFrame, gt: DataFrame) -> DataFrame:
    """Boxes of the same image as ``density``: a small aggregate joined back."""
    per_image = gt.groupBy("image_id").agg(F.count("*").alias("density"))
    return rows.join(per_image, "image_id")


def bucket_of(kind: str) -> Column:
    largest = F.greatest("w", "h")
    if kind == "area":
        return _ladder(F.col("w") * F.col("h"), AREA_STEPS, "large")
    if kind == "dim":
        return _ladder(largest, DIM_STEPS, ">=128")
    if kind == "density":
        return _ladder(F.col("density"), DENSITY_STEPS, "high")
    if kind == "density5":
        return _ladder(F.col("density"), DENSITY5_STEPS, ">40")
    if kind == "viewport":
        return F.concat_ws("x", F.col("vp_w").cast("string"), F.col("vp_h").cast("string"))
    raise ValueError(f"unknown bucket kind {kind}")


def bucket_recall(matches: DataFrame, kind: str, iou: float = K.MATCH_IOU) -> DataFrame:
    """Recall by size, density or viewport bucket."""
    rows = with_density(matches, matches) if kind.startswith("density") else matches
    hit = F.count_if(F.col("best_iou") >= iou)
    return rows.groupBy(bucket_of(kind).alias("bucket")).agg(
        F.count("*").alias("gt"), hit.alias("tp"), F.round(hit / F.count("*"), 6).alias("recall")
    )


# --- thresholds -------------------------------------------------------------


def threshold_sweep(gt: DataFrame, pred: DataFrame, thresholds=K.CALIBRATION_THRESHOLDS, iou: float = K.MATCH_IOU) -> DataFrame:
    """TP/FP/FN, ratios and recoverable misses at each confidence cut, from one IoU pass.

    A pair's level is the number of cuts it passes. The best pair of each box
    and level is kept, at most one per cut; from the highest level down, the
    best so far matches the box between two levels. These spans go to their
    prediction, whose number per cut gives both the matches and the used ones.
    """
    cuts = sorted({float(t) for t in thresholds})
    listed = F.array(*[F.lit(t) for t in cuts])
    places = range(1, len(cuts) + 1)
    level = F.size(F.filter(listed, lambda t: t <= F.col("b_conf")))
    firsts = iou_pairs(gt, pred, min_iou=iou).groupBy("image_id", "a_gt_id", level.alias("level")).agg(
        F.min(F.struct((-F.col("iou")).alias("neg"), F.col("b_pred_id").alias("pred_id"))).alias("m")
    )
    boxes = firsts.groupBy("image_id", "a_gt_id").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("level", "m")))).alias("es")
    )
    span = F.transform(
        "es",
        lambda e, i: F.struct(
            F.array_min(F.transform(F.slice("es", 1, i + 1), lambda x: x["m"]))["pred_id"].alias("pred_id"),
            F.coalesce(F.get("es", i + 1)["level"], F.lit(0)).alias("low"),
            e["level"].alias("high"),
            (i == 0).cast("long").alias("box"),
        ),
    )
    spans = boxes.select("image_id", F.explode(span).alias("s")).select("image_id", "s.*")
    held = spans.groupBy("image_id", "pred_id").agg(
        F.sum("box").alias("boxes"),
        *[F.count_if((F.col("low") < j) & (F.lit(j) <= F.col("high"))).alias(f"n{j}") for j in places],
    )
    sums = held.agg(
        F.coalesce(F.sum("boxes"), F.lit(0)).alias("reachable"),
        F.array(*[F.struct(F.sum(f"n{j}").alias("tp"), F.count_if(F.col(f"n{j}") > 0).alias("used")) for j in places]).alias("at"),
    )
    hits = sums.select("reachable", F.explode(F.arrays_zip(listed.alias("threshold"), F.col("at").alias("at"))).alias("r")).select(
        F.col("r.threshold").alias("threshold"), "reachable", "r.at.tp", "r.at.used"
    )
    counted = pred.agg(F.array(*[F.count_if(F.col("conf") >= t) for t in cuts]).alias("n"))
    shown = counted.select(F.explode(F.arrays_zip(listed.alias("threshold"), F.col("n").alias("preds"))).alias("r")).select("r.*")
    # The totals repeated per threshold are the frame the other counts join.
    total = gt.agg(F.count("*").alias("gt")).select(F.explode(listed).alias("threshold"), "gt")
    rows = total.join(hits, "threshold", "left").join(shown, "threshold", "left")
    z = F.lit(0)
    tp = F.coalesce("tp", z)
    fp = F.coalesce("preds", z) - F.coalesce("used", z)
    flat = rows.select("threshold", tp.alias("tp"), fp.alias("fp"), (F.col("gt") - tp).alias("fn"),
                       (F.col("reachable") - tp).alias("missed_with_candidate"), "gt")
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    r = F.when(F.col("gt") > 0, F.col("tp") / F.col("gt")).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return flat.select(
        "threshold", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
        F.round(f1, 6).alias("f1"), "missed_with_candidate",
        F.when(F.col("fn") > 0, F.round(F.col("missed_with_candidate") / F.col("fn") * 100, 2)).otherwise(0.0).alias("candidate_pct"),
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The cut with the best F1, the first one on ties."""
    return sweep.agg(F.min(F.struct((-F.col("f1")).alias("n"), "threshold")).alias("b")).select(
        F.col("b.threshold").alias("threshold"), (-F.col("b.n")).alias("f1")
    )


def duplicate_matches(matches: DataFrame, iou: float = K.MATCH_IOU) -> DataFrame:
    """Ground truths whose best prediction another one (first by id) already used."""
    hit = matches.filter(F.col("best_iou") >= iou)
    first = hit.groupBy("image_id", "pred_id").agg(F.min("gt_id").alias("_first"))
    return hit.join(first, ["image_id", "pred_id"]).filter(F.col("gt_id") != F.col("_first")).drop("_first")


# --- failures ---------------------------------------------------------------


def failure_taxonomy(gt: DataFrame, pred: DataFrame, scheme: str = "causes", conf: float = 0.30, iou: float = K.MATCH_IOU) -> DataFrame:
    """Why each ground truth was missed.

    ``causes`` is the fine rule set, ``grades`` puts every box (found ones too)
    into one of six grades, ``short`` is the three-way set. A box counts as found
    under ``causes`` when a prediction that survives suppression meets it; the
    cause is read off the raw predictions, so suppression can be one.
    """
    raw = best_match(gt, pred)
    sure = pred.filter(F.col("conf") >= conf)
    # suppression runs once, though its result is counted and then met
    kept = written(nms(sure, "pred_id").select(*PRED), "kept") if scheme == "causes" else sure
    found = iou_pairs(gt, kept, min_iou=iou).select("image_id", F.col("a_gt_id").alias("gt_id")).distinct()
    largest, area = F.greatest("w", "h"), F.col("w") * F.col("h")
    same = F.coalesce(F.col("pred_cls") == F.col("cls"), F.lit(False))
    name = {c: i for i, c in enumerate(K.UI_CLASSES)}
    if scheme == "grades":
        reason = (
            F.when((largest < 16) | (area < 256), "A_representation_loss")
            .when((F.col("best_iou") >= 0.5) & same & (F.col("pred_conf") >= conf), "G_correct_detection")
            .when((F.col("best_iou") >= 0.5) & same, "B_low_confidence")
            .when(F.col("best_iou") >= 0.5, "C_wrong_class")
            .when(F.col("best_iou") >= 0.15, "D_localization_failure")
            .otherwise("F_grid_collision")
        )
        return raw.withColumn("reason", reason)
    missed = with_density(raw.join(found, ["image_id", "gt_id"], "left_anti"), gt)
    if scheme == "short":
        reason = (
            F.when(area < 64 * 64, "SMALL_OBJECT").when(F.col("density") > 25, "DENSE_LAYOUT").otherwise("BOUNDING_BOX_ERROR")
        )
        return missed.withColumn("reason", reason)
    is_input = F.col("cls") == name["input"]
    unseen = (
        F.when(largest < 32, "small_object_loss").when(is_input, "low_contrast_failure")
        .when(F.col("density") > 25, "dense_layout_failure").otherwise("missed_completely")
    )
    look_alike = is_input & F.col("pred_cls").isin(name["card"], name["text_block"], name["button"])
    reason = (
        F.when(F.col("pred_id").isNull() | (F.col("best_iou") < 0.10), unseen)
        .when(F.col("pred_conf") < conf, "confidence_below_threshold")
        .when(~same, F.when(look_alike, "visually_similar_class_confusion").otherwise("wrong_class"))
        .when(F.col("best_iou") < 0.30, "localization_failure")
        .otherwise("duplicate_suppression")
    )
    return missed.withColumn("reason", reason)


def failure_shares(failures: DataFrame) -> DataFrame:
    """Count and share of each reason."""
    counts = failures.groupBy("reason").agg(F.count("*").alias("n"))
    # A window over the few reasons, not over the failures.
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("reason", "n", F.round(F.col("n") / total * 100, 2).alias("pct"))


def confusion(matches: DataFrame, min_iou: float = 0.15) -> DataFrame:
    """Ground-truth class against best predicted class, long form; NULL = missed completely."""
    seen = F.when(F.col("best_iou") >= min_iou, F.col("pred_cls"))
    return matches.groupBy("cls", seen.alias("predicted")).agg(F.count("*").alias("n"))


def average_precision(gt: DataFrame, pred: DataFrame, ious=(0.50,)) -> DataFrame:
    """True AP per class and IoU threshold: area under the precision envelope.

    Equal confidences count as one step. Predictions are reduced to one row per
    (threshold, class, confidence) map-side; running sums and the envelope go
    over sampled ranges of the confidence, so a class is never one task, however
    its confidences crowd.
    """
    pairs = iou_pairs(gt, pred, same_class=True)
    best = pairs.groupBy("image_id", "b_pred_id", "b_conf", "b_cls").agg(
        F.min(F.struct((-F.col("iou")).alias("neg"), "a_gt_id")).alias("m")
    )
    cuts = F.array(*[F.lit(float(t)) for t in ious])
    # the surest hit of a box at every threshold at once: rows are not repeated before they are counted
    reached = [F.max(F.when(-F.col("m.neg") >= float(t), F.struct(F.lit(float(t)).alias("iou_thr"), F.col("b_conf").alias("conf")))) for t in ious]
    winners = best.groupBy("image_id", F.col("m.a_gt_id").alias("gt_id"), F.col("b_cls").alias("cls")).agg(F.array(*reached).alias("w"))
    winners = winners.select("cls", F.explode("w").alias("w")).filter("w is not null").select("cls", "w.*")
    hits = winners.groupBy("iou_thr", "cls", "conf").agg(F.count("*").alias("tp"), F.lit(0).cast("long").alias("n"))
    shown = pred.groupBy("cls", "conf").agg(F.count("*").alias("n")).select(
        F.explode(cuts).alias("iou_thr"), "cls", "conf", F.lit(0).cast("long").alias("tp"), "n"
    )
    steps = hits.unionByName(shown).groupBy("iou_thr", "cls", "conf").agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    key = ["iou_thr", "cls"]
    # one row per confidence, sorted over the cluster from the surest on
    placed = R.ranged(steps.withColumn("_order", -F.col("conf")), key, ["_order"], "ap-steps")
    curve = R.running(placed, key, ["_order"], {"_tp": "tp", "_n": "n"}).withColumn("_pr", F.col("_tp") / F.col("_n"))
    envelope = R.running(curve, key, ["_order"], {"_env": "_pr"}, F.max, backward=True)
    truths = gt.groupBy("cls").agg(F.count("*").alias("gt"))
    area = envelope.groupBy(*key).agg(F.sum(F.col("tp") * F.col("_env")).alias("_area"))
    base = truths.select("cls", "gt", F.explode(cuts).alias("iou_thr"))
    return base.join(area, key, "left").select(
        "iou_thr", "cls", "gt", F.round(F.coalesce(F.col("_area"), F.lit(0.0)) / F.col("gt"), 6).alias("ap")
    )


def mean_average_precision(ap: DataFrame) -> DataFrame:
    """mAP per IoU threshold over classes that have ground truth."""
    return ap.groupBy("iou_thr").agg(F.count("*").alias("classes"), F.round(F.avg("ap"), 5).alias("map"))


def detect_vs_localise(matches: DataFrame) -> DataFrame:
    """Per class: detected, of the right class, localised."""
    seen = F.col("best_iou") >= 0.30
    return matches.groupBy("cls").agg(
        F.count("*").alias("total"), F.count_if(seen).alias("detected"),
        F.count_if(seen & (F.col("pred_cls") == F.col("cls"))).alias("correct_class"),
        F.count_if(F.col("best_iou") >= 0.50).alias("localised"),
    )


def worst_class(metrics: DataFrame) -> DataFrame:
    """Lowest recall among classes with ground truth, the first class on ties."""
    return metrics.filter("gt > 0").agg(F.min(F.struct("recall", "cls")).alias("w")).select("w.cls", "w.recall")


def top_failures(failures: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first ``n`` misses: a top-k, not a sort of everything."""
    return failures.orderBy(*order).limit(n)


def compare_configs(runs: DataFrame, config: str, baseline: str, metrics: list[str]) -> DataFrame:
    """Metrics per configuration with their difference to the baseline's."""
    means = runs.groupBy(config).agg(*[F.round(F.avg(m), 6).alias(m) for m in metrics])
    # A window over the few configurations finds the baseline's row.
    few = Window.partitionBy(F.lit(0))

    def base(m):
        return F.max(F.when(F.col(config) == baseline, F.col(m))).over(few)

    return means.select(config, *metrics, *[F.round(F.col(m) - base(m), 6).alias(f"{m}_delta") for m in metrics])


CONFIGS = ("full", "tiled", "hybrid")


def detector_configs(pred: DataFrame, ident: str, vp_w: int, vp_h: int, thr: float = K.NMS_IOU) -> DataFrame:
    """What three ways of running one detector give, for every image, in one pass.

    ``full`` is the detections as they are, ``tiled`` those cut at a disjoint two by
    two grid of tiles, ``hybrid`` both; the last two are suppressed per class. Every
    detection is repeated for the configurations it is in, and one suppression runs
    over all of them: ``run`` names image and configuration together.
    """
    plain = pred.select("image_id", F.concat(F.col(ident).cast("string"), F.lit("/f")).alias("pred_id"), "cls", "conf", "x", "y", "w", "h")
    cut = untile(tile_grid(pred.select("image_id", F.col(ident).alias("_id"), "cls", "conf", "x", "y", "w", "h"), vp_w, vp_h, 0.5))
    cut = cut.select("image_id", F.concat(F.col("_id").cast("string"), F.lit("/"), F.col("tile").cast("string")).alias("pred_id"), "cls", "conf", "x", "y", "w", "h")

    def configs(*names: str) -> Column:
        return F.array(*(F.lit(CONFIGS.index(c)) for c in names))

    def run(forms: DataFrame) -> DataFrame:
        rows = forms.withColumn("_k", F.explode("_in")).withColumn("run", F.col("image_id") * len(CONFIGS) + F.col("_k"))
        return rows.withColumn("image_id", F.col("run")).drop("_k", "_in")

    # a form is shuffled once, and repeated where its image lies
    forms = plain.withColumn("_in", configs("hybrid")).unionByName(cut.withColumn("_in", configs("tiled", "hybrid")))
    kept = written(nms(forms, "pred_id", thr, repeat=run), "kept")
    return run(plain.withColumn("_in", configs("full"))).drop("image_id").unionByName(kept.drop("image_id"))


def compare_detectors(gt: DataFrame, runs: DataFrame, iou: float = K.MATCH_IOU, small: int = 32) -> DataFrame:
    """Recall of each configuration over the same boxes, overall (class null) and per class, and the difference to ``full``.

    ``runs`` as from ``detector_configs``. The runs of an image meet its truth together; what was hit is
    reduced to a row per box, and the truth is repeated per configuration only where it is counted.
    """
    count = F.lit(len(CONFIGS))
    kind, k = dict(gt.dtypes)["image_id"], F.pmod("run", count)
    whole = F.expr(f"(run - pmod(run, {len(CONFIGS)})) div {len(CONFIGS)}") if kind in ("int", "bigint") else (F.col("run") - k) / count
    hits = greedy_match(gt, runs.withColumn("image_id", whole.cast(kind)), iou, run="run").filter("tp")
    hits = hits.groupBy("image_id", "gt_id").agg(F.array(*(F.max((k == c).cast("int")) for c in range(len(CONFIGS)))).alias("_hit"))
    truth = gt.select("image_id", "gt_id", "cls", (F.greatest("w", "h") < small).alias("small")).join(hits, ["image_id", "gt_id"], "left")
    # a box of no image is in no configuration
    config = F.when(F.col("image_id").isNotNull(), F.element_at(F.array(*map(F.lit, CONFIGS)), F.col("_k") + 1))
    rows = truth.withColumn("_k", F.explode(F.array(*map(F.lit, range(len(CONFIGS))))))
    rows = rows.select(config.alias("config"), "cls", F.coalesce(F.get("_hit", "_k"), F.lit(0)).alias("hit"), "small")
    n, tp = F.count("*"), F.sum("hit")
    few, few_tp = F.count_if("small"), F.sum(F.when(F.col("small"), F.col("hit")))
    rated = rows.groupingSets([("config",), ("config", "cls")], "config", "cls").agg(
        n.alias("gt"), tp.alias("tp"), F.round(tp / n, 6).alias("recall"), F.when(few > 0, F.round(few_tp / few, 6)).alias("small_recall")
    )
    # a row per configuration and class
    base = F.max(F.when(F.col("config") == CONFIGS[0], F.col("recall"))).over(Window.partitionBy("cls"))
    return rated.withColumn("recall_delta", F.round(F.col("recall") - base, 6))


def quality_gates(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Each metric against its rule; a metric that is missing fails."""
    joined = rules.join(metrics, "metric", "left")
    v, t = F.col("value"), F.col("threshold")
    ok = F.when(F.col("op") == ">=", v >= t).when(F.col("op") == "<=", v <= t).when(F.col("op") == "==", v == t)
    return joined.withColumn("passed", F.coalesce(ok, F.lit(False)))


def gates_overall(gates: DataFrame) -> DataFrame:
    return gates.agg(F.bool_and("passed").alias("all_passed"), F.count_if(~F.col("passed")).alias("failed"))


def latency_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, upper median, nearest-rank p95 and p99, min and max."""
    ranked = R.value_ranks(df, by, value)
    return ranked.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 2).alias("mean"),
        R.at_rank(value, F.floor(F.col("total") / 2) + 1).alias("median"),
        R.nearest_rank(value, 0.95).alias("p95"),
        R.nearest_rank(value, 0.99).alias("p99"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )


def stage_breakdown(marks: DataFrame, run: str, stage: str, mark: str) -> DataFrame:
    """Mean duration and share of each stage from cumulative marks per run.

    The stages of one run are few; the shares come from sums per stage.
    """
    w = Window.partitionBy(run).orderBy(stage)
    durations = marks.withColumn("_d", F.col(mark) - F.lag(mark, 1, 0.0).over(w))
    sums = durations.groupBy(stage).agg(F.sum("_d").alias("_s"), F.count("*").alias("runs"))
    total = F.sum("_s").over(Window.partitionBy(F.lit(0)))  # over the few stages
    return sums.select(
        stage, "runs", F.round(F.col("_s") / F.col("runs"), 4).alias("mean"), F.round(F.col("_s") / total * 100, 4).alias("share_pct")
    )


def vector_agreement(a: DataFrame, b: DataFrame, key: str, v: str = "v") -> DataFrame:
    """Cosine and absolute differences of paired vectors, folded inside the row."""
    pairs = a.select(key, F.col(v).alias("_a")).join(b.select(key, F.col(v).alias("_b")), key)

    def dot(p, q):
        return F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, t: acc + t)

    diff = F.zip_with("_a", "_b", lambda s, t: F.abs(s - t))
    norm = F.sqrt(dot(F.col("_a"), F.col("_a"))) * F.sqrt(dot(F.col("_b"), F.col("_b")))
    rated = pairs.withColumn("_n", norm).withColumn("_d", diff).select(
        key,
        F.when(F.col("_n") > 0, dot(F.col("_a"), F.col("_b")) / F.col("_n")).otherwise(1.0).alias("cosine"),
        F.array_max("_d").alias("max_diff"),
        (F.aggregate("_d", F.lit(0.0), lambda acc, t: acc + t) / F.size("_d")).alias("mean_diff"),
    )
    return rated.withColumn("matches", (F.col("max_diff") < 1e-3) & (F.col("cosine") > 0.999))


def agreement_verdict(pairs: DataFrame) -> DataFrame:
    rate = F.count_if("matches") / F.count("*")
    passed = (F.max("max_diff") < 1e-3) & (F.avg("cosine") >= 0.999) & (rate >= 0.95)
    return pairs.agg(
        F.count("*").alias("pairs"), F.count_if("matches").alias("matched"), F.round(F.max("max_diff"), 6).alias("max_diff"),
        F.round(F.avg("cosine"), 6).alias("mean_cosine"), passed.alias("verified"),
    )
