"""Regions of calm images meet directly, the others are searched."""

import random

from veilgrain.operators import geometry

REGION = "image_id long, id long, x double, y double, w double, aspect double, fill double"


def test_calm_images_need_no_search(spark, monkeypatch):
    def never(*_):
        raise AssertionError("a calm image was searched")

    monkeypatch.setattr(geometry, "nearest_distance", never)
    rng = random.Random(4)
    rows = [(i, 100 * i + k, *(float(rng.randrange(60)) for _ in range(3)), rng.randrange(90) / 100, rng.randrange(50) / 100) for i in range(6) for k in range(i + 1)]
    got = {r.id: tuple(r)[2:] for r in geometry.neighbourhood_stats(spark.createDataFrame(rows, REGION), "id").collect()}
    for a in rows:
        others = [b for b in rows if b[0] == a[0] and b[1] != a[1]]
        near = min((((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 for b in others), default=500.0)
        aligned = sum(any(abs(a[k] - b[k]) <= 10 for k in (2, 3, 4)) for b in others)
        similar = sum(abs(a[5] - b[5]) <= 0.3 and abs(a[6] - b[6]) <= 0.2 for b in others)
        assert got[a[1]] == (int(near + 0.5), min(1, aligned / 4), min(1, similar / 4)), a


def test_images_with_a_repeated_or_unknown_id_are_searched(spark):
    rows = [(1, 1, 0.0, 0.0, 5.0, 0.1, 0.1), (1, 1, 0.0, 0.0, 5.0, 0.1, 0.1), (1, 2, 3.0, 4.0, 50.0, 0.1, 0.1), (2, None, 1.0, 1.0, 5.0, 0.1, 0.1), (2, 8, 1.0, 7.0, 5.0, 0.1, 0.1)]
    frame = spark.createDataFrame(rows, REGION)
    (calm,), crowded = geometry.split_crowded(frame, unique="id")
    assert calm.count() == 0 and crowded[0].count() == 5
    got = sorted((r.image_id, r.id or 0, r.isolation) for r in geometry.neighbourhood_stats(frame, "id").collect())
    assert got == [(1, 1, 0), (1, 1, 0), (1, 2, 5), (2, 0, 6), (2, 8, 6)]
