"""Text assembly over glyph rows, all in windows of one page: replacement spans, word gaps, lines.

A page's runs (shown strings) or glyphs are shuffled once by file row and page and sorted once by
paint order; generated spaces, line breaks and the page text come from that order without another
exchange. Rows without text add nothing; pages without rows don't appear; rows of equal doc_ids are
files of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SAME_LINE_EM, GAP_EM, LINE_EM, TURN = 0.10, 0.12, 0.55, 0.01
#: White space as Unicode has it, for character classes, and characters that a replacement drops.
SPACE = r"\u0009-\u000D \u0085   -     　"
_DROPPED = "­​‎‏⁠﻿"


def key_of(df: DataFrame) -> tuple[str, str]:
    """What tells pages apart: rows of files, where they are known, as doc_ids may repeat or be null."""
    return ("doc_row" if "doc_row" in df.columns else "doc_id", "page_index")


def _ids(df: DataFrame) -> list[str]:
    return [c for c in ("doc_row", "doc_id") if c in df.columns]


def replacement(text: Column) -> Column:
    """A span's replacement text: layout marks dropped, white space and controls to spaces."""
    text = F.translate(F.translate(text, _DROPPED, ""), "‑", "-")
    return F.regexp_replace(text, rf"[{SPACE}\u0000-\u001F\u007F-\u009F]", " ")



def _breaks(prev: Column, x: Column, y: Column, size: Column, rotation: Column) -> Column:
    """Whether a glyph starts a new line after `prev` (x, y, size, rotation)."""
    most = F.greatest(prev["size"], size)
    dx, dy, c, s = x - prev["x"], y - prev["y"], F.cos(prev["rotation"]), F.sin(prev["rotation"])
    along, across = dx * c + dy * s, dy * c - dx * s
    moved = (F.abs(rotation - prev["rotation"]) > TURN) | (F.abs(across) > LINE_EM * most) | (along < -most)
    return F.coalesce(prev.isNotNull() & (most > 0) & moved, F.lit(False))


def assembled(glyphs: DataFrame, mine: Column | None = None) -> DataFrame:
    """Glyph or run rows with `text`, `gap` (a space is generated before it), and line breaks before the
    generated space and before the text. `mine`: which rows are such; others are kept, and looked past."""
    own = {"tx": F.col("x"), "ty": F.col("y"), "lx": F.col("x"), "ly": F.col("y"), "ey": F.col("y"), "last_text": F.col("own_text"), "starts": F.lit(True)}
    # a glyph is a run of one
    glyphs = glyphs.withColumns({c: F.coalesce(F.col(c), v) if c in glyphs.columns else v for c, v in own.items()})
    w = W.partitionBy(*key_of(glyphs)).orderBy("seq")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    in_span = F.col("span").isNotNull()
    seen = ("span", "end_x", "ey", "end_y", "size")
    if mine is None:
        prev = {c: F.lag(c).over(w) for c in seen}
    else:
        glyphs = glyphs.withColumn("_prev", F.last(F.when(mine, F.struct(*seen)), ignorenulls=True).over(before))
        prev = {c: F.col("_prev")[c] for c in seen}
    first = in_span & ~F.coalesce(prev["span"] == F.col("span"), F.lit(False))
    df = glyphs.withColumn("text", F.when(in_span, F.when(first, replacement(F.col("span_text"))).otherwise("")).otherwise(F.translate("own_text", "\u00ad", "")))
    df = df.withColumns({"_px": prev["end_x"], "_py": prev["ey"], "_pey": prev["end_y"], "_ps": prev["size"]})
    text = F.col("text")
    last = F.translate("last_text", "\u00ad", "")
    ended = F.when(in_span & (text == ""), F.lit(None)).when(in_span, text.rlike(rf"[{SPACE}]$")).otherwise(last.rlike(rf"^[{SPACE}]*$"))
    df = df.withColumn("_ended", ended).withColumn("_spaced", F.coalesce(F.last("_ended", ignorenulls=True).over(before), F.lit(False)))
    gap = F.col("starts") & (text != "") & (F.abs(F.col("y") - F.col("_py")) <= SAME_LINE_EM * F.col("_ps")) & (F.col("_ps") > 0) & (F.col("x") - F.col("_px") > GAP_EM * F.col("_ps")) & ~F.col("_spaced") & ~text.rlike(rf"^[{SPACE}]")
    df = df.withColumn("gap", F.coalesce(gap, F.lit(False)))
    at = F.struct(F.col("lx").alias("x"), F.col("ly").alias("y"), "size", "rotation")
    df = df.withColumn("_last", F.last(F.when(text != "", at), ignorenulls=True).over(before))
    space = F.struct(F.col("_px").alias("x"), F.col("_pey").alias("y"), F.col("_ps").alias("size"), F.col("rotation"))
    df = df.withColumn("break_space", F.col("gap") & _breaks(F.col("_last"), space["x"], space["y"], space["size"], space["rotation"]))
    prev = F.when(F.col("gap"), space).otherwise(F.col("_last"))
    return df.withColumn("break_glyph", (text != "") & _breaks(prev, F.col("tx"), F.col("ty"), F.col("size"), F.col("rotation")))


def page_text(glyphs: DataFrame) -> DataFrame:
    """(doc_row, doc_id, page_index, text) of the pages that have glyphs or runs, in content order."""
    line = F.lit("\n")
    piece = F.concat(F.when(F.col("break_space"), line).otherwise(""), F.when(F.col("gap"), " ").otherwise(""), F.when(F.col("break_glyph"), line).otherwise(""), "text")
    ids, key = _ids(glyphs), key_of(glyphs)
    rows = assembled(glyphs).select(*ids, "page_index", "seq", piece.alias("piece")).where("piece != ''")
    found = rows.groupBy(*key).agg(F.first("doc_id").alias("_doc"), F.expr("listagg(piece, '') within group (order by seq)").alias("text"))
    return found.select(*([key[0]] if key[0] != "doc_id" else []), F.col("_doc").alias("doc_id"), "page_index", "text")


def nominal_box(x: Column, y: Column, end_x: Column, end_y: Column, size: Column, turn: Column) -> Column:
    """The bounds of a glyph's em box: from its origin to the next, 0.2 em below and 0.8 above, turned."""
    up = (-F.sin(turn) * size, F.cos(turn) * size)
    xs = [p + up[0] * k for p in (x, end_x) for k in (-0.2, 0.8)]
    ys = [p + up[1] * k for p in (y, end_y) for k in (-0.2, 0.8)]
    return F.array(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))


def with_boxes(primitives: DataFrame) -> DataFrame:
    """Glyph rows, which have no outline here, get their nominal box as bbox."""
    box = nominal_box(*[F.col(c) for c in ("x", "y", "end_x", "end_y", "size", "rotation")])
    return primitives.withColumn("bbox", F.when(F.col("kind") == "glyph", box).otherwise(F.col("bbox"))) if "bbox" in primitives.columns else primitives.withColumn("bbox", box)


def with_spaces(primitives: DataFrame) -> DataFrame:
    """The glyph table: one row a glyph and a row before it for each generated space, which lies between
    the pen and the glyph and has the glyph's font and colour. `ord` numbers these in paint order,
    without holes, together with the paths and images among the primitives."""
    has = "kind" in primitives.columns
    ids, key = _ids(primitives), key_of(primitives)
    # all kinds go through the same windows, so that they are made, shuffled and sorted once
    df = assembled(primitives, F.col("kind") == "glyph" if has else None)
    df = df.where("kind is not null") if has else df
    order = W.partitionBy(*key).orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.withColumn("_ord", (F.row_number().over(W.partitionBy(*key).orderBy("seq")) - 1 + F.sum(F.col("gap").cast("int")).over(order)).cast("int")).where("text is not null")
    made = F.struct(
        F.lit(" ").alias("text"), F.lit(True).alias("is_generated_space"), (F.col("_ord") - 1).alias("ord"), F.col("_px").alias("x"), F.col("_pey").alias("y"), (F.col("x") - F.col("_px")).alias("advance"), F.col("_ps").alias("size"),
        F.array(F.least("_px", "x"), F.col("_py"), F.greatest("_px", "x"), F.col("_py") + F.col("_ps")).alias("bbox"),
    )
    box = nominal_box(*[F.col(c) for c in ("x", "y", "end_x", "end_y", "size", "rotation")])
    own = F.struct("text", F.lit(False).alias("is_generated_space"), F.col("_ord").alias("ord"), "x", "y", "advance", "size", box.alias("bbox"))
    rows = df.withColumn("_g", F.explode(F.when(F.col("gap"), F.array(made, own)).otherwise(F.array(own))))
    kept = [c for c in ("rotation", "mode", "code", "font_name", "base_font", "flags", "fill", "fill_alpha") if c in primitives.columns]
    return rows.select(*ids, "page_index", "_g.*", *kept)


def visible(glyphs: DataFrame) -> DataFrame:
    return glyphs.where(~F.col("mode").isin(3, 7))


def document_text(pages: DataFrame) -> DataFrame:
    """(doc_row, doc_id, text): pages in order, parted by form feeds."""
    if "doc_row" in pages.columns:
        return pages.groupBy("doc_row").agg(F.first("doc_id").alias("doc_id"), F.expr("listagg(text, '\u000C') within group (order by page_index)").alias("text"))
    return pages.groupBy("doc_id").agg(F.expr("listagg(text, '\u000C') within group (order by page_index)").alias("text"))
