"""Page geometry: boxes, rotation, sizes and the matrix to device space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .text import key_of, with_boxes


def page_boxes(opened: DataFrame) -> DataFrame:
    """One row a page: media_box and crop_box as structs, rotation in quarter turns, size as shown."""
    media = F.coalesce(g.rect_of(F.when(F.col("media").isNotNull(), F.col("media")).otherwise(F.array(*map(F.lit, (0.0, 0.0, 612.0, 792.0))))))
    pages = opened.where("page_index is not null").withColumn("media_box", media)
    crop = g.intersect(g.rect_of(F.coalesce("crop", F.col("media"), F.array(*map(F.lit, (0.0, 0.0, 612.0, 792.0))))), F.col("media_box"))
    pages = pages.withColumn("crop_box", F.when(g.is_empty(crop), F.col("media_box")).otherwise(crop))
    pages = pages.withColumn("rotation", (F.floor(F.pmod(F.col("rotate"), F.lit(360)) / 90) * 90).cast("int"))
    turned = F.col("rotation").isin(90, 270)
    w, h = g.width(F.col("crop_box")), g.height(F.col("crop_box"))
    return pages.select("doc_row", "doc_id", "page_index", "media_box", "crop_box", "rotation", F.when(turned, h).otherwise(w).alias("width"), F.when(turned, w).otherwise(h).alias("height"))


def page_matrix(crop: Column, rotation: Column, scale: float) -> Column:
    """From page space to a y-down raster: crop corner to the origin, flip, rotate, scale."""
    at = lambda *by_turn: sum((F.when(rotation == 90 * k, v).otherwise(0.0) for k, v in enumerate(by_turn)), F.lit(0.0)) * scale
    one, none = F.lit(1.0), F.lit(0.0)
    return g.matrix(
        at(one, none, -one, none), at(none, one, none, -one), at(none, one, none, -one), at(-one, none, one, none),
        at(-crop["x0"], -crop["y0"], crop["x1"], crop["y1"]), at(crop["y1"], -crop["x0"], -crop["y0"], crop["x1"]),
    )


def likely_scanned(pages: DataFrame, glyphs: DataFrame, images: DataFrame, most_glyphs: int = 32, share: float = 0.5) -> DataFrame:
    """(doc_id, page_index, is_likely_scanned): little text, and one image over most of the page."""
    key = list(key_of(pages))
    text = glyphs.where(F.trim("text") != "").groupBy(*key).agg(F.count(F.lit(1)).alias("n_text"))
    boxes = pages.select(*key, "crop_box")
    seen = images.join(boxes, key).select(*key, (g.area(g.intersect(g.rect_of(F.col("bbox")), F.col("crop_box"))) / g.area(F.col("crop_box"))).alias("cover"))
    cover = seen.groupBy(*key).agg(F.max("cover").alias("cover"))
    all_pages = pages.select(*key, *(["doc_id"] if "doc_id" not in key else [])).join(text, key, "left").join(cover, key, "left")
    return all_pages.select("doc_id", "page_index", ((F.coalesce("n_text", F.lit(0)) <= most_glyphs) & (F.coalesce("cover", F.lit(0.0)) >= share)).alias("is_likely_scanned"))


#: Size of the finest cells, in page units; regions that are sent to all tasks; parts that primitives are dealt to where there are more.
CELL, SENT, PARTS = 64.0, 50_000, 32


def _level(box: list[Column], cell: float) -> Column:
    """The finest grid in whose cells a box spans two at most either way; each level's cells are twice as wide."""
    size = F.greatest(box[2] - box[0], box[3] - box[1], F.lit(cell))
    return F.ceil(F.log2(size / cell)).cast("int")


def _celled(df: DataFrame, box: list[Column], levels: list[int], cell: float) -> DataFrame:
    """df with a row for each cell that the box touches, on its own level and all coarser ones of `levels`."""
    df = df.withColumn("_own", _level(box, cell))
    coarser = F.filter(F.array(*map(F.lit, levels)), lambda v: v >= F.col("_own"))
    df = df.withColumn("_level", F.explode(coarser)).withColumn("_size", F.lit(cell) * F.pow(F.lit(2.0), F.col("_level")))
    first = [F.floor(b / F.col("_size")).cast("long") for b in box]
    df = df.withColumn("_cx", first[0]).withColumn("_cy", first[1])
    cells = df.withColumn("_x", F.explode(F.sequence("_cx", first[2]))).withColumn("_y", F.explode(F.sequence("_cy", first[3])))
    return cells.drop("_size")


def in_regions(primitives: DataFrame, regions: DataFrame, cell: float = CELL) -> DataFrame:
    """Primitives with region_id, a row for each region (region_id, x0, y0, x1, y1) that their bbox touches: a join on grid cells.

    A box stands in the cells it touches, four at most on a level, of every level from its own up; two boxes meet on
    the coarser one's level, and count where the first cell common to them is, so each pair comes once. Up to SENT
    regions are broadcast; more are joined by cell and part of the primitives, so that a cell that all pages
    use is spread over PARTS tasks. Regions with corners in any order; those with null or infinite corners touch nothing."""
    b = [F.col("bbox")[k] for k in range(4)]
    finite = lambda cols: F.forall(F.array(*cols), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < 1e15))
    rows = with_boxes(primitives).where(F.col("bbox").isNotNull() & finite(b))
    corners = [f(F.col(f"{c}0").cast("double"), F.col(f"{c}1").cast("double")) for f in (F.least, F.greatest) for c in "xy"]
    areas = regions.where(finite([F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])).select("region_id", *[c.alias(n) for c, n in zip(corners, ("_a", "_b", "_c", "_d"), strict=True)])
    r = [F.col(c) for c in ("_a", "_b", "_c", "_d")]
    levels = sorted({x[0] for x in areas.select(_level(r, cell)).distinct().union(rows.select(_level(b, cell)).distinct()).collect()})  # a few dozen at most
    if not levels:
        levels = [0]
    ours = _celled(rows, b, levels, cell)
    theirs = _celled(areas, r, levels, cell).select("region_id", *["_a", "_b", "_c", "_d"], F.col("_own").alias("_their"), "_level", F.col("_cx").alias("_rx"), F.col("_cy").alias("_ry"), "_x", "_y")
    on = ["_level", "_x", "_y"]
    if areas.limit(SENT + 1).count() <= SENT:
        theirs = F.broadcast(theirs)
    else:
        part = F.pmod(F.xxhash64(*key_of(rows), "seq"), F.lit(PARTS)).cast("int")
        ours, theirs, on = ours.withColumn("_part", part), theirs.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*on, "_part"]
    met = ours.join(theirs, on).where((F.col("_level") == F.greatest("_own", "_their")) & (F.col("_x") == F.greatest("_cx", "_rx")) & (F.col("_y") == F.greatest("_cy", "_ry")))
    touch = met.where((b[0] <= F.col("_c")) & (b[2] >= F.col("_a")) & (b[1] <= F.col("_d")) & (b[3] >= F.col("_b")))
    return touch.select(*rows.columns, "region_id")


def in_region(primitives: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows whose bbox (an array; of glyphs the nominal one) touches the region."""
    b = F.col("bbox")
    return with_boxes(primitives).where((b[0] <= x1) & (b[2] >= x0) & (b[1] <= y1) & (b[3] >= y0))
