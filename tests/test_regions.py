"""The grid join of regions against every pair."""

import random

from folioquery.operators import pages


def boxes(rnd, n):
    for i in range(n):
        size = rnd.choice((0, 3, 60, 64, 700, 1e5))
        x, y = rnd.uniform(-800, 800), rnd.choice((rnd.uniform(-800, 800), 64.0, -128.0))
        yield i, x, y, x + rnd.uniform(0, size), y + rnd.choice((0, size, rnd.uniform(0, size)))


def test_regions(spark, monkeypatch):
    rnd = random.Random(9)
    shapes = [(i % 7, i, "path", [x0, y0, x1, y1]) for i, x0, y0, x1, y1 in boxes(rnd, 300)] + [(1, 900, "path", None), (1, 901, "path", [0.0, 0.0, float("nan"), 1.0])]
    areas = [(i, x1, y0, x0, y1, "z") for i, x0, y0, x1, y1 in boxes(rnd, 40)] + [(90, None, 0.0, 1.0, 1.0, "z"), (91, 0.0, 0.0, float("inf"), 1.0, "z")]
    none = {c: None for c in ("x", "y", "end_x", "end_y", "size", "rotation")}
    prims = spark.createDataFrame([(r, 0, s, k, b, *none.values()) for r, s, k, b in shapes], "doc_row long, page_index int, seq int, kind string, bbox array<double>, " + ", ".join(f"{c} double" for c in none))
    regions = spark.createDataFrame(areas, "region_id int, x0 double, y0 double, x1 double, y1 double, bbox string")
    want = sorted((s, i) for _, s, _, b in shapes[:300] for i, x1, y0, x0, y1, _ in areas[:40] if b[0] <= x1 and b[2] >= x0 and b[1] <= y1 and b[3] >= y0)
    for sent in (pages.SENT, 0):
        monkeypatch.setattr(pages, "SENT", sent)
        found = pages.in_regions(prims, regions)
        assert sorted((r["seq"], r["region_id"]) for r in found.collect()) == want
    assert pages.in_regions(prims.limit(0), regions).count() == pages.in_regions(prims, regions.limit(0)).count() == 0
