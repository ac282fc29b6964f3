"""Box geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrain.operators import geometry as G
from veilgrain.plans import views as V

Q = {}
SQL = {}

IOU_SQL = """CASE WHEN a.w * a.h + b.w * b.h - i > 0 THEN i :: DOUBLE / (a.w * a.h + b.w * b.h - i) ELSE 0.0 END"""
INTER_SQL = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"


def slim_gt(spark, d):
    return V.boxes_gt(spark, d).select("image_id", "gt_id", "cls", "x", "y", "w", "h")


def iou(spark, d):
    pairs = G.with_iou(G.overlap_pairs(slim_gt(spark, d), V.boxes_pred(spark, d)))
    return pairs.groupBy("image_id").agg(
        F.count("*").alias("pairs"), F.round(F.sum("iou"), 4).alias("iou_sum"), F.round(F.max("iou"), 6).alias("iou_max")
    )


Q["iou"] = iou
SQL["iou"] = V.with_views(
    ["boxes_pred"],
    f"""SELECT image_id, count(*) AS pairs, round(sum(v), 4) AS iou_sum, round(max(v), 6) AS iou_max FROM (
      SELECT a.image_id, {IOU_SQL} AS v FROM boxes_gt a JOIN boxes_pred b ON a.image_id = b.image_id, LATERAL (SELECT {INTER_SQL} AS i) WHERE i > 0)
    GROUP BY image_id""",
)


def sanitise_boxes(spark, d):
    raw = slim_gt(spark, d).select(
        "image_id", "gt_id",
        F.when(F.col("w") == 22, float("nan")).otherwise(F.col("x") - 50.5).alias("x"),
        (F.col("y") + 400.5).alias("y"),
        F.when(F.col("w") == 28, -1.0).when(F.col("w") == 34, 5000.0).otherwise(F.col("w") + 0.5).alias("w"),
        F.col("h").cast("double").alias("h"),
    )
    return G.sanitise_boxes(raw, 1600, 900)


Q["sanitise_boxes"] = sanitise_boxes
SQL["sanitise_boxes"] = V.with_views(
    ["boxes_gt"],
    """SELECT image_id, gt_id, CAST(floor(cx + 0.5) AS BIGINT) AS x, CAST(floor(cy + 0.5) AS BIGINT) AS y,
      CAST(floor(least(w + 0.5, greatest(10.0, 1600 - cx)) + 0.5) AS BIGINT) AS w, CAST(floor(least(h, greatest(10.0, 900 - cy)) + 0.5) AS BIGINT) AS h
    FROM (SELECT *, greatest(0.0, x - 50.5) AS cx, y + 400.5 AS cy FROM boxes_gt WHERE w NOT IN (22, 28, 34) AND x - 50.5 < 1700 AND y + 400.5 < 1000)""",
)


def merge_overlapping(spark, d):
    return G.merge_overlapping(V.boxes_pred(spark, d), "pred_id")


Q["merge_overlapping"] = merge_overlapping


def merge_ctes(boxes: str, ident: str) -> dict[str, str]:
    """Box by box: the open one takes in what it meets until nothing is left to meet, then the next one opens."""
    hits = "list_filter(rest, lambda b: cur.x1 < b.x2 AND cur.x2 > b.x1 AND cur.y1 < b.y2 AND cur.y2 > b.y1)"
    ends = ", ".join(f"{c}: {f}(cur.{c}, {g}(list_transform(hits, lambda b: b.{c})))" for c, f, g in
                     (("x1", "least", "list_min"), ("y1", "least", "list_min"), ("x2", "greatest", "list_max"), ("y2", "greatest", "list_max")))
    return {
        "queue": f"""SELECT image_id, list({{id: id, x1: x1, y1: y1, x2: x2, y2: y2, n: 1}} ORDER BY id) AS rest FROM (
          SELECT image_id, min({ident}) AS id, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM {boxes} WHERE w > 0 AND h > 0 GROUP BY image_id, x, y, w, h) GROUP BY image_id""",
        "growing": f"""SELECT image_id, rest[1] AS cur, rest[2:] AS rest, false AS shut FROM queue
          UNION ALL SELECT image_id,
            CASE WHEN shut THEN rest[1] WHEN len(hits) > 0 THEN {{id: cur.id, {ends}, n: cur.n + CAST(len(hits) AS INTEGER)}} ELSE cur END,
            CASE WHEN shut THEN rest[2:] WHEN len(hits) > 0 THEN list_filter(rest, lambda b: NOT list_contains(list_transform(hits, lambda k: k.id), b.id)) ELSE rest END,
            NOT shut AND len(hits) = 0
          FROM (SELECT *, {hits} AS hits FROM growing ) WHERE NOT (shut AND len(rest) = 0)""",
        "merged": f"""SELECT image_id, cur.id AS {ident}, cur.x1 AS x, cur.y1 AS y, cur.x2 - cur.x1 AS w, cur.y2 - cur.y1 AS h, cur.n AS members
          FROM growing WHERE shut""",
    }


SQL["merge_overlapping"] = V.with_views(
    ["boxes_pred"],
    """SELECT image_id, pred_id, x :: DOUBLE AS x, y :: DOUBLE AS y, w :: DOUBLE AS w, h :: DOUBLE AS h, members FROM merged""",
    merge_ctes("boxes_pred", "pred_id"),
)

LOCAL = ("CONTAINS", "OVERLAPS", "NEAR", "ALIGNED_WITH")


def spatial_relations(spark, d):
    rel = G.spatial_relations(slim_gt(spark, d), "gt_id")
    return rel.groupBy("image_id", "relation").agg(
        F.count("*").alias("pairs"), F.count_if(F.col("src") < F.col("dst")).alias("forward")
    )


Q["spatial_relations"] = spatial_relations
_PAIR = """SELECT a.image_id, a.gt_id AS src, b.gt_id AS dst, i, a.x <= b.x AND a.y <= b.y AND a.x + a.w >= b.x + b.w AND a.y + a.h >= b.y + b.h AS inside,
    sqrt(pow(a.x + a.w / 2 - b.x - b.w / 2, 2) + pow(a.y + a.h / 2 - b.y - b.h / 2, 2)) <= greatest(140, 1.5 * greatest(a.w, a.h, b.w, b.h)) AND i = 0 AS near,
    least(abs(a.y - b.y), abs(a.y + a.h - b.y - b.h), abs(a.y + a.h / 2 - b.y - b.h / 2), abs(a.x - b.x), abs(a.x + a.w - b.x - b.w), abs(a.x + a.w / 2 - b.x - b.w / 2)) <= 8 AS aligned,
    CASE WHEN a.y + a.h <= b.y + 12 THEN 'ABOVE' WHEN b.y + b.h <= a.y + 12 THEN 'BELOW' END AS vert,
    CASE WHEN a.x + a.w <= b.x + 12 THEN 'LEFT_OF' WHEN b.x + b.w <= a.x + 12 THEN 'RIGHT_OF' END AS horiz
  FROM boxes_gt a JOIN boxes_gt b ON a.image_id = b.image_id AND a.gt_id <> b.gt_id, LATERAL (SELECT """ + INTER_SQL + " AS i)"
SQL["spatial_relations"] = V.with_views(
    ["boxes_gt"],
    """SELECT image_id, relation, count(*) AS pairs, count(*) FILTER (src < dst) AS forward FROM (
      SELECT image_id, src, dst, CASE WHEN inside THEN 'CONTAINS' ELSE 'OVERLAPS' END AS relation FROM pair WHERE i > 0
      UNION ALL SELECT image_id, src, dst, 'NEAR' FROM pair WHERE near UNION ALL SELECT image_id, src, dst, 'ALIGNED_WITH' FROM pair WHERE aligned
      UNION ALL SELECT image_id, src, dst, vert FROM pair WHERE (near OR i > 0) AND vert IS NOT NULL
      UNION ALL SELECT image_id, src, dst, horiz FROM pair WHERE (near OR i > 0) AND horiz IS NOT NULL) GROUP BY ALL""",
    {"pair": _PAIR},
)

Q["direction_counts"] = lambda spark, d: G.direction_counts(slim_gt(spark, d), "gt_id")
SQL["direction_counts"] = V.with_views(
    ["boxes_gt"],
    """SELECT a.image_id, a.gt_id, count(*) FILTER (vert = 'ABOVE') AS n_above, count(*) FILTER (vert = 'BELOW') AS n_below,
      count(*) FILTER (horiz = 'LEFT_OF') AS n_left, count(*) FILTER (horiz = 'RIGHT_OF') AS n_right
    FROM boxes_gt a LEFT JOIN pair ON a.image_id = pair.image_id AND a.gt_id = pair.src GROUP BY a.image_id, a.gt_id""",
    {"pair": _PAIR},
)

Q["alignment_runs"] = lambda spark, d: G.alignment_runs(slim_gt(spark, d), "gt_id")
SQL["alignment_runs"] = V.with_views(
    ["boxes_gt"],
    """SELECT image_id, gt_id, line, "at", run, count(*) OVER (PARTITION BY image_id, line, run) AS members FROM (
      SELECT *, max(start) OVER (PARTITION BY image_id, line ORDER BY "at") AS run FROM (
        SELECT *, CASE WHEN "at" - coalesce(lag("at") OVER (PARTITION BY image_id, line ORDER BY "at"), "at" - 99) > 8 THEN "at" END AS start FROM (
          SELECT image_id, gt_id, unnest(['top', 'bottom', 'middle', 'left', 'right', 'centre']) AS line,
            unnest([y, y + h, y + h / 2.0, x, x + w, x + w / 2.0]) :: DOUBLE AS "at" FROM boxes_gt)))""",
)


def point_in_box(spark, d):
    gt = slim_gt(spark, d)
    points = V.boxes_pred(spark, d).select("image_id", F.col("pred_id").alias("point_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    hits = G.points_in_boxes(points, gt)
    return hits.groupBy("image_id", "point_id").agg(F.count("*").alias("boxes"), F.min("gt_id").alias("first_box"))


Q["point_in_box"] = point_in_box
SQL["point_in_box"] = V.with_views(
    ["boxes_pred"],
    """SELECT p.image_id, pred_id AS point_id, count(*) AS boxes, min(gt_id) AS first_box FROM boxes_pred p JOIN boxes_gt g
      ON p.image_id = g.image_id AND p.x BETWEEN g.x AND g.x + g.w AND p.y BETWEEN g.y AND g.y + g.h GROUP BY ALL""",
)


def fuse_text_regions(spark, d):
    gt = V.boxes_gt(spark, d)
    regions = gt.filter("cls <= 5").select("image_id", F.col("gt_id").alias("region_id"), "x", "y", "w", "h")
    texts = gt.filter("cls > 5").select(
        "image_id", F.col("gt_id").alias("text_ord"), F.concat(F.lit("t"), F.col("cls").cast("string")).alias("text"), "x", "y", "w", "h"
    )
    return G.fuse_text_regions(regions, texts)


Q["fuse_text_regions"] = fuse_text_regions
SQL["fuse_text_regions"] = V.with_views(
    ["boxes_gt"],
    """SELECT image_id, region_id, string_agg('t' || tcls, ' ' ORDER BY tid) AS associated_text, max_by(occ, tid) AS occupancy,
      max_by(l, tid) AS pad_left, max_by(r, tid) AS pad_right, max_by(greatest(0, ty - y), tid) AS pad_top, max_by(greatest(0, y + h - ty - th), tid) AS pad_bottom,
      max_by(CASE WHEN abs(l - r) <= 20 THEN 'CENTER' WHEN l < r THEN 'LEFT' ELSE 'RIGHT' END, tid) AS position
    FROM (SELECT a.image_id, a.gt_id AS region_id, b.gt_id AS tid, b.cls AS tcls, a.y, a.h, b.y AS ty, b.h AS th,
        floor(least(1.0, (b.w * b.h) / greatest(1, a.w * a.h)) * 100 + 0.5) / 100 AS occ, greatest(0, b.x - a.x) AS l, greatest(0, a.x + a.w - b.x - b.w) AS r
      FROM boxes_gt a JOIN boxes_gt b ON a.image_id = b.image_id AND a.cls <= 5 AND b.cls > 5
        AND a.x <= b.x + b.w AND a.x + a.w >= b.x AND a.y <= b.y + b.h AND a.y + a.h >= b.y) GROUP BY image_id, region_id""",
)


NMS_KEPT = "SELECT image_id, k.id AS pred_id FROM (SELECT image_id, unnest(kept) AS k FROM steps WHERE n = total)"


def nms_ctes(keys: str, same: str, where: str = "true", source: str = "boxes_pred") -> dict[str, str]:
    return {
        "ranked": f"""SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY conf DESC, pred_id) AS n, count(*) OVER (PARTITION BY {keys}) AS total FROM {source} WHERE {where}""",
        "steps": f"""SELECT image_id, cls, n, total, [{{id: pred_id, x: x, y: y, w: w, h: h}}] AS kept FROM ranked WHERE n = 1
          UNION ALL SELECT s.image_id, s.cls, r.n, s.total, CASE WHEN len(list_filter(kept, lambda k: list_sum(list_transform(
            [greatest(0, least(k.x + k.w, r.x + r.w) - greatest(k.x, r.x)) * greatest(0, least(k.y + k.h, r.y + r.h) - greatest(k.y, r.y))],
            lambda i: CAST(i AS DOUBLE) / (k.w * k.h + r.w * r.h - i))) >= 0.4)) > 0 THEN kept
            ELSE list_append(kept, {{id: r.pred_id, x: r.x, y: r.y, w: r.w, h: r.h}}) END
          FROM steps s JOIN ranked r ON r.image_id = s.image_id AND {same} AND r.n = s.n + 1""",
    }


def _nms_sql(keys: str, same: str) -> str:
    return V.with_views(["boxes_pred"], NMS_KEPT, nms_ctes(keys, same))


Q["nms"] = lambda spark, d: G.nms(V.boxes_pred(spark, d), "pred_id").select("image_id", "pred_id")
SQL["nms"] = _nms_sql("image_id, cls", "r.cls = s.cls")
Q["nms_agnostic"] = lambda spark, d: G.nms(V.boxes_pred(spark, d), "pred_id", class_aware=False).select("image_id", "pred_id")
SQL["nms_agnostic"] = _nms_sql("image_id", "true")


def tile_grid(spark, d):
    tiles = G.tile_grid(slim_gt(spark, d), 1600, 900)
    return G.untile(tiles).select("gt_id", "tile", "x", "y", "w", "h")


Q["tile_grid"] = tile_grid
SQL["tile_grid"] = V.with_views(
    ["boxes_gt"],
    """SELECT gt_id, CAST(tile AS INTEGER) AS tile, l AS x, u AS y, greatest(1, r - l) AS w, greatest(1, d - u) AS h FROM (
      SELECT gt_id, tile, greatest(x, tx) AS l, least(x + w, tx + 960) AS r, greatest(y, ty) AS u, least(y + h, ty + 540) AS d
      FROM boxes_gt, (VALUES (0, 0, 0), (1, 640, 0), (2, 0, 360), (3, 640, 360)) t(tile, tx, ty)) WHERE r > l AND d > u""",
)

Q["crop_windows"] = lambda spark, d: G.crop_windows(V.boxes_pred(spark, d), "pred_id")
SQL["crop_windows"] = V.with_views(
    ["boxes_pred"],
    """SELECT image_id, CAST(rn AS INTEGER) AS crop, pred_id, cx AS x, cy AS y, least(1920 - cx, w + 40) AS w, least(1080 - cy, h + 40) AS h FROM (
      SELECT *, greatest(0, x - 20) AS cx, greatest(0, y - 20) AS cy, row_number() OVER (PARTITION BY image_id ORDER BY pred_id) AS rn FROM boxes_pred WHERE cls IN (6, 7)) WHERE rn <= 3""",
)


def _features(spark, d):
    b = V.boxes_gt(spark, d)
    m = lambda n: F.pmod(F.col("pk") * n + F.col("sk") * 7, F.lit(100)) / 100.0
    return b.select(
        "image_id", "gt_id", "x", "y", "w", "h",
        (F.round(F.col("w") / F.col("h") * 100) / 100).alias("aspect"),
        (m(3) * 0.4).alias("edge"), (m(5) * 60).alias("contrast"), (m(7) * 4000).alias("variance"),
        (F.col("w") * F.col("h")).alias("area"), m(11).alias("border"), (m(13) * 40).alias("interior"), m(17).alias("corner"), m(19).alias("fill"),
        V._pick(("CENTER", "LEFT", "RIGHT", "NONE"), F.col("pk") % 4).alias("text_pos"),
        (F.col("pk") % 3 + 1).alias("components"), m(23).alias("similarity"), m(29).alias("alignment"),
    )


_M = "((pk * {n} + sk * 7) % 100) / 100.0"
_FEATURES = f"""SELECT image_id, gt_id, x, y, w, h, round(w / h * 100) / 100 AS aspect, {_M.format(n=3)} * 0.4 AS edge, {_M.format(n=5)} * 60 AS contrast,
  {_M.format(n=7)} * 4000 AS variance, w * h AS area, {_M.format(n=11)} AS border, {_M.format(n=13)} * 40 AS interior, {_M.format(n=17)} AS corner, {_M.format(n=19)} AS fill,
  {V._case(("CENTER", "LEFT", "RIGHT", "NONE"), 'pk % 4')} AS text_pos, pk % 3 + 1 AS components, {_M.format(n=23)} AS similarity, {_M.format(n=29)} AS alignment FROM boxes_gt"""

Q["classify_regions"] = lambda spark, d: G.classify_regions(_features(spark, d)).select("gt_id", "region_type", "region_confidence")
_RULES = (
    ("VISUAL_CHECKBOX_RADIO", "w <= 36 AND h <= 36 AND aspect BETWEEN 0.7 AND 1.45 AND (border >= 0.4 OR corner >= 0.4 OR edge >= 0.18)", "least(0.96, greatest(0.75, 0.78 + 0.12 * border + 0.08 * corner))"),
    ("VISUAL_ICON", "w <= 55 AND h <= 55 AND aspect BETWEEN 0.65 AND 1.5 AND (edge >= 0.16 OR components >= 2) AND contrast >= 25", "least(0.94, greatest(0.7, 0.75 + 0.15 * least(1.0, edge * 3)))"),
    ("VISUAL_INPUT", "aspect BETWEEN 2.4 AND 14 AND h BETWEEN 22 AND 70 AND (fill >= 0.65 OR border >= 0.35) AND (edge < 0.22 OR text_pos = 'LEFT')", "least(0.95, greatest(0.75, 0.78 + 0.1 * fill + CASE WHEN text_pos = 'LEFT' THEN 0.07 ELSE 0 END))"),
    ("VISUAL_BUTTON", "aspect BETWEEN 1.2 AND 6 AND h BETWEEN 20 AND 80 AND (border >= 0.35 OR contrast >= 25 OR interior >= 20) AND (fill >= 0.55 OR text_pos = 'CENTER')", "least(0.96, greatest(0.75, 0.76 + 0.1 * border + 0.08 * fill + CASE WHEN text_pos = 'CENTER' THEN 0.06 ELSE 0 END))"),
    ("VISUAL_NAVIGATION", "(aspect >= 5 OR y <= 80) AND area >= 35000 AND (alignment >= 0.4 OR similarity >= 0.4 OR w >= 400)", "least(0.93, greatest(0.75, 0.8 + 0.1 * alignment))"),
    ("VISUAL_CARD", "w >= 160 AND h >= 90 AND area >= 18000 AND aspect BETWEEN 0.4 AND 4.5 AND (border >= 0.3 OR contrast >= 15 OR area >= 30000)", "least(0.94, greatest(0.75, 0.8 + CASE WHEN area > 40000 THEN 0.08 ELSE 0.04 END))"),
    ("VISUAL_IMAGE", "area >= 6000 AND variance >= 1500 AND fill < 0.5 AND edge < 0.25", "least(0.92, greatest(0.7, 0.75 + 0.15 * (1 - fill)))"),
    ("VISUAL_INTERACTIVE", "edge >= 0.12 OR contrast >= 20 OR border >= 0.25", "least(0.88, greatest(0.65, 0.7 + 0.12 * edge))"),
)
SQL["classify_regions"] = V.with_views(
    ["boxes_gt"],
    "SELECT gt_id, (CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c, _ in _RULES) + " ELSE 'UNKNOWN_VISUAL_REGION' END) AS region_type, "
    + "(CASE " + " ".join(f"WHEN {c} THEN floor(({v}) * 100 + 0.5) / 100" for _, c, v in _RULES) + " ELSE 0.4 END) :: DOUBLE AS region_confidence "
    + "FROM (SELECT image_id, gt_id, x, y, w, h, aspect, area, text_pos, components, " + ", ".join(f"{c} :: DOUBLE AS {c}" for c in ("edge", "contrast", "variance", "border", "interior", "corner", "fill", "similarity", "alignment")) + " FROM feats)",
    {"feats": _FEATURES},
)

Q["neighbourhood_stats"] = lambda spark, d: G.neighbourhood_stats(
    _features(spark, d).select("image_id", "gt_id", "x", "y", "w", "aspect", "fill"), "gt_id"
)
SQL["neighbourhood_stats"] = V.with_views(
    ["boxes_gt"],
    """SELECT a.image_id, a.gt_id, CAST(floor(coalesce(min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 500) + 0.5) AS BIGINT) AS isolation,
      floor(least(1.0, count(*) FILTER (abs(a.y - b.y) <= 10 OR abs(a.x - b.x) <= 10 OR abs(a.w - b.w) <= 10) / 4) * 100 + 0.5) / 100 AS alignment,
      floor(least(1.0, count(*) FILTER (abs(a.aspect - b.aspect) <= 0.3 AND abs(a.fill - b.fill) <= 0.2) / 4) * 100 + 0.5) / 100 AS similarity
    FROM f a LEFT JOIN f b ON a.image_id = b.image_id AND a.gt_id <> b.gt_id GROUP BY a.image_id, a.gt_id""",
    {"feats": _FEATURES, "f": "SELECT image_id, gt_id, x, y, w, aspect :: DOUBLE AS aspect, fill :: DOUBLE AS fill FROM feats"},
)


def uncertainty(spark, d):
    return G.uncertainty(V.boxes_pred(spark, d)).groupBy("cls", "uncertainty").agg(F.count("*").alias("n"))


Q["uncertainty"] = uncertainty
SQL["uncertainty"] = V.with_views(
    ["boxes_pred"],
    "SELECT cls, CASE WHEN conf >= 0.85 THEN 'CONFIDENT' WHEN conf >= 0.65 THEN 'AMBIGUOUS' ELSE 'UNCERTAIN_FALLBACK' END AS uncertainty, count(*) AS n FROM boxes_pred GROUP BY ALL",
)
Q["uncertainty_ratio"] = lambda spark, d: G.uncertainty_ratio(V.boxes_pred(spark, d))
SQL["uncertainty_ratio"] = V.with_views(
    ["boxes_pred"],
    "SELECT image_id, count(*) AS detections, floor(count(*) FILTER (conf < 0.85) :: DOUBLE / count(*) * 100 + 0.5) / 100 AS uncertainty_ratio FROM boxes_pred GROUP BY image_id",
)
Q["sequential_above"] = lambda spark, d: G.sequential_above(slim_gt(spark, d), "gt_id")
SQL["sequential_above"] = V.with_views(
    ["boxes_gt"],
    """SELECT image_id, src, dst FROM (SELECT image_id, gt_id AS src, y + h AS e, lead(gt_id) OVER w AS dst, lead(y) OVER w AS ny FROM boxes_gt
      WINDOW w AS (PARTITION BY image_id ORDER BY gt_id)) WHERE e <= ny""",
)


def scene_summary(spark, d):
    gt = slim_gt(spark, d).withColumn("kind", F.concat(F.lit("c"), F.col("cls").cast("string")))
    return G.scene_summary(gt, "gt_id", "kind")


Q["scene_summary"] = scene_summary
SQL["scene_summary"] = V.with_views(
    ["boxes_gt"],
    """SELECT image_id, string_agg('[c' || cls || ' at (' || x || ',' || y || ') [' || w || 'x' || h || ']]', ', ' ORDER BY gt_id) AS summary FROM boxes_gt GROUP BY image_id""",
)

Q["slot_collisions"] = lambda spark, d: G.slot_collisions(slim_gt(spark, d))
_SLOTS = """SELECT image_id, greatest(0, least(15, CAST(floor((x + w / 2.0) / 1920 * 16) AS BIGINT))) AS gx, greatest(0, least(15, CAST(floor((y + h / 2.0) / 1080 * 16) AS BIGINT))) AS gy,
    CASE WHEN w / 1920 > h / 1080 THEN 0 ELSE 1 END AS anchor, count(*) AS occupancy FROM boxes_gt GROUP BY ALL"""
SQL["slot_collisions"] = V.with_views(
    ["boxes_gt"], "SELECT occupancy, count(*) AS slots, CAST(sum(occupancy) AS BIGINT) AS objects FROM s GROUP BY occupancy", {"s": _SLOTS}
)
Q["collision_summary"] = lambda spark, d: G.collision_summary(slim_gt(spark, d))
SQL["collision_summary"] = V.with_views(
    ["boxes_gt"],
    """SELECT CAST(o AS BIGINT) AS objects, CAST(a AS BIGINT) AS alone, CAST(o - a AS BIGINT) AS collided, round(a / o * 100, 2) AS unique_pct, round((o - a) / o * 100, 2) AS collided_pct
      FROM (SELECT sum(occupancy) AS o, sum(occupancy) FILTER (occupancy = 1) AS a FROM s)""",
    {"s": _SLOTS},
)

Q["grid_round_trip"] = lambda spark, d: G.grid_round_trip(slim_gt(spark, d), "gt_id").drop("error_px")
_RT = """SELECT *, CAST(CASE WHEN w * h < 14400 THEN CASE WHEN ar > 1.5 THEN 0 ELSE 256 END + least(15, greatest(0, CAST(floor(y1 * 16) AS BIGINT))) * 16 + least(15, greatest(0, CAST(floor(x1 * 16) AS BIGINT)))
    ELSE CASE WHEN ar <= 1.5 THEN 512 ELSE 576 END + least(7, greatest(0, CAST(floor(y1 * 8) AS BIGINT))) * 8 + least(7, greatest(0, CAST(floor(x1 * 8) AS BIGINT))) END AS BIGINT) AS slot
  FROM (SELECT *, abs(x2 - x1) / greatest(1e-4, abs(y2 - y1)) AS ar FROM (SELECT *, least(1.0, x / 1920) AS x1, least(1.0, y / 1080) AS y1,
    least(1.0, (x + w) / 1920) AS x2, least(1.0, (y + h) / 1080) AS y2 FROM boxes_gt))"""
SQL["grid_round_trip"] = V.with_views(
    ["boxes_gt"],
    "SELECT image_id, gt_id, slot, gt_id <> max(gt_id) OVER (PARTITION BY image_id, slot) AS lost FROM rt",
    {"rt": _RT},
)


def redaction_coverage(spark, d):
    merged = G.merge_overlapping(slim_gt(spark, d), "gt_id")
    return G.redaction_coverage(merged.select("image_id", "x", "y", "w", "h"), 2, 1920, 1080)


Q["redaction_coverage"] = redaction_coverage
Q["redaction_coverage_disjoint"] = lambda spark, d: G.redaction_coverage(
    slim_gt(spark, d).filter("cls = 3").select("image_id", "x", "y", "w", "h"), 2, 1600, 900
)


def _area_sql(boxes: str) -> str:
    """Union area line by line: on each pixel row, what every interval adds to those before it."""
    return f"""SELECT image_id, sum(greatest(0, x2 - greatest(x1, reach))) AS area FROM (
      SELECT *, coalesce(max(x2) OVER (PARTITION BY image_id, line ORDER BY x1, x2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), x1) AS reach FROM (
        SELECT DISTINCT image_id, x1, x2, unnest(range(CAST(y1 AS BIGINT), CAST(y2 AS BIGINT))) AS line FROM ({boxes}) WHERE x2 > x1 AND y2 > y1)) GROUP BY image_id"""


def _coverage_sql(boxes: str, width: int, height: int, kind: str) -> str:
    padded = f"""SELECT image_id, greatest(0, x - 2) AS x1, greatest(0, y - 2) AS y1, least({width}, greatest(0, x - 2) + w + 4) AS x2,
      least({height}, greatest(0, y - 2) + h + 4) AS y2 FROM {boxes}"""
    raw = f"SELECT image_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM {boxes}"
    return f"""SELECT image_id, CAST(s AS {kind}) AS sensitive, CAST(f AS {kind}) AS filled, round(least(s, f) / nullif(f, 0), 6) AS precision, round(least(s, f) / s, 6) AS recall,
      CASE WHEN {width * height} - s > 0 THEN round((f - s) / ({width * height} - s), 6) END AS over_redaction FROM (
      SELECT image_id, coalesce(t.area, 0) AS s, coalesce(p.area, 0) AS f FROM (SELECT DISTINCT image_id FROM {boxes})
        LEFT JOIN ({_area_sql(raw)}) t USING (image_id) LEFT JOIN ({_area_sql(padded)}) p USING (image_id))"""


SQL["redaction_coverage_disjoint"] = V.with_views(
    ["boxes_gt"], _coverage_sql("(SELECT * FROM boxes_gt WHERE cls = 3)", 1600, 900, "BIGINT")
)
SQL["redaction_coverage"] = V.with_views(["boxes_gt"], _coverage_sql("merged", 1920, 1080, "DOUBLE"), merge_ctes("boxes_gt", "gt_id"))
