"""The registered queries over PDF files, each with the SQL that states its result.

The given tables hold no PDFs, so every query first writes whole tables as PDF files, in Spark, and
then reads those files with the engine; its SQL works on the tables alone.

In all of them: a null or empty text gives a file with an empty page, which has no row where the result is
of glyphs or texts; repeated rows are files of their own; empty tables give no rows; texts of any length
and any characters are written and read whole; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import graphics
from ..operators import pages as page_ops
from ..operators import reports, text
from ..sources.pdf import RUN_COLUMNS, TEXT_COLUMNS, documents, file_primitives, open_documents, page_primitives
from ..sources.datasource import register as register_sources
from ..sources.pdf_images import image_contents
from ..sources.pdf_tables import inside
from ..sources.pdf_writer import files, in_pages, object_files, show_lines, shown, write_files
from ..sources.store import folder, stored

#: Lines of a page, and rows of a table that one task writes as files.
LINES, ROWS = 50, 4096
GLYPHS = ("glyph",)
_LINES_SQL = f"""
l AS (SELECT doc_id, string_split(replace(text, chr(173), '-'), chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, lines, unnest(range(0, greatest(1, ceil(len(lines) / {LINES}.0))::BIGINT)) AS page_index FROM l),
t AS (SELECT doc_id, page_index::INT AS page_index, array_to_string(list_filter(lines[page_index * {LINES} + 1:page_index * {LINES} + {LINES}], lambda x: x <> ''), chr(10)) AS text FROM p)"""

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """Writing and reading files is work for the CPU, and a table may come as a few row groups: its
    rows are dealt out to tasks of about ROWS rows, and to all cores at least; by `keys` where it is grouped by them after, which
    then needs no other shuffle. The count reads footers only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, -(-df.count() // ROWS)), *keys)


def _pages_of(df: DataFrame, column: str = "text", per_page: int = LINES) -> DataFrame:
    pages = F.transform(in_pages(F.split(F.col(column), "\n"), per_page), lambda p: show_lines(p))
    return df.where(F.col(column).isNotNull()).withColumn("pages", pages)


def _runs(made: DataFrame) -> DataFrame:
    """Shown strings of files, which are all that page texts need."""
    return file_primitives(made, ("run",), RUN_COLUMNS)


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as PDF files."""
    return files(_pages_of(_table(spark, sf_dir, "documents")).select("doc_id", "pages"))


def _glyphs(made: DataFrame, columns: tuple[str, ...] | None = TEXT_COLUMNS) -> DataFrame:
    return file_primitives(made, GLYPHS, columns)


@query(f"WITH {_LINES_SQL} SELECT doc_id, page_index, text FROM t WHERE text <> ''")
def pdf_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each page that has any."""
    return text.page_text(_runs(_corpus(spark, sf_dir))).select("doc_id", "page_index", "text")


@query(f"WITH {_LINES_SQL} SELECT doc_id, string_agg(text, chr(12) ORDER BY page_index) AS text FROM t WHERE text <> '' GROUP BY doc_id")
def pdf_document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages parted by form feeds."""
    return text.document_text(text.page_text(_runs(_corpus(spark, sf_dir)))).select("doc_id", "text")


@query(f"WITH {_LINES_SQL} SELECT doc_id, count(*)::INT AS page_count, false AS recovered, false AS encrypted, 0::BIGINT AS header_offset FROM t GROUP BY doc_id")
def pdf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page counts, and how each file was opened."""
    return documents(open_documents(_corpus(spark, sf_dir))).select("doc_id", "page_count", "recovered", "encrypted", "header_offset")


@query(f"WITH {_LINES_SQL} SELECT doc_id, sum(length(replace(text, chr(10), '')))::BIGINT AS n_glyphs, 0::BIGINT AS n_paths, 0::BIGINT AS n_images, 'Helvetica' AS fonts FROM t GROUP BY doc_id HAVING sum(length(text)) > 0")
def pdf_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primitives by kind, and fonts, of each document."""
    found = reports.totals(file_primitives(_corpus(spark, sf_dir), columns=("doc_row", "doc_id", "kind", "base_font")))
    return found.withColumn("fonts", F.array_join("fonts", ",")).drop("doc_row")


@query(f"WITH {_LINES_SQL}, c AS (SELECT unnest(string_split(replace(text, chr(10), ''), '')) AS glyph FROM t) SELECT glyph, count(*)::BIGINT AS n FROM c WHERE glyph <> '' GROUP BY glyph")
def pdf_glyph_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each character is shown."""
    return _glyphs(_corpus(spark, sf_dir), ("own_text",)).groupBy(F.col("own_text").alias("glyph")).agg(F.count(F.lit(1)).alias("n"))


# Advance widths of the digits and the space, in thousandths, as the oracle states them.
_ADVANCE = "sum(CASE WHEN c BETWEEN '0' AND '9' THEN 5.56 WHEN c = ' ' THEN 2.78 ELSE 2.78 END)"


@query(f"WITH d AS (SELECT o_orderkey AS doc_id, o_orderkey::VARCHAR || ' ' || o_custkey::VARCHAR AS s FROM orders), c AS (SELECT doc_id, unnest(string_split(s, '')) AS c FROM d) SELECT doc_id, round({_ADVANCE}, 3) AS advance FROM c GROUP BY doc_id")
def pdf_advances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of each order's line, from the standard widths."""
    df = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array(show_lines(F.array(F.concat_ws(" ", "o_orderkey", "o_custkey")))).alias("pages"))
    return _glyphs(files(df), ("doc_id", "advance")).groupBy("doc_id").agg(F.round(F.sum("advance"), 3).alias("advance"))


@query(
    """SELECT l_orderkey AS doc_id, string_agg(l_partkey::VARCHAR || ' ' || l_suppkey::VARCHAR || ' ' || l_returnflag || l_linestatus, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS text
FROM lineitem GROUP BY l_orderkey"""
)
def pdf_generated_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a table placed by position alone: the spaces between them are generated."""
    cell = lambda x, y, s: F.concat(F.lit(f"BT /F1 10 Tf 1 0 0 1 {x} "), y, F.lit(" Tm "), shown(s), F.lit(" ET\n"))
    keys = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    rows = _table(spark, sf_dir, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("rows"))

    def line(r, i):
        y = (F.lit(760) - 14 * i).cast("string")
        return F.concat(cell(72, y, r["l_partkey"].cast("string")), cell(200, y, r["l_suppkey"].cast("string")), cell(330, y, F.concat(r["l_returnflag"], r["l_linestatus"])))

    df = rows.select("doc_id", F.array(F.array_join(F.transform("rows", line), "")).alias("pages"))
    return text.page_text(_runs(files(df))).select("doc_id", "text")


@query("SELECT l_orderkey AS doc_id, string_agg(CASE WHEN round(l_discount * 100) * 31 > 120 THEN 'A B' ELSE 'AB' END, chr(10) ORDER BY l_linenumber, round(l_discount * 100)) AS text FROM lineitem GROUP BY l_orderkey")
def pdf_kerning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets inside a string: over 0.12 em they part words, below they are kerning."""
    rows = _table(spark, sf_dir, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.round(F.col("l_discount") * 100).cast("int").alias("d")))).alias("rows"))
    line = lambda r: F.concat(F.lit("[(A) "), (-31 * r["d"]).cast("string"), F.lit(" (B)] TJ T*\n"))
    df = rows.select("doc_id", F.array(F.concat(F.lit("BT /F1 10 Tf 14 TL 72 760 Td\n"), F.array_join(F.transform("rows", line), ""), F.lit("ET"))).alias("pages"))
    return text.page_text(_runs(files(df))).select("doc_id", "text")


@query("SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations WHERE text <> ''")
def pdf_actual_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the replacement text of a span over two mute glyphs; line feeds become spaces."""
    df = stored(_table(spark, sf_dir, "conversations").where("text <> ''").withColumn("doc_id", F.monotonically_increasing_id()), "pdf-turns")
    span = F.concat(F.lit("/Span << /ActualText <FEFF"), F.hex(F.encode("text", "UTF-16BE")), F.lit("> >> BDC BT /F1 10 Tf 72 742 Td (xy) Tj ET EMC"))
    opened = open_documents(files(df.select("doc_id", F.array(span).alias("pages"))))
    return df.select("conv_id", "turn", "doc_id").join(text.page_text(page_primitives(opened, ("run",), RUN_COLUMNS)), "doc_id").select("conv_id", "turn", "text")


@query("SELECT d.doc_id, length(replace(text, chr(10), ''))::BIGINT AS n_glyphs, CASE WHEN toxic = 1 THEN 0 ELSE length(replace(text, chr(10), '')) END::BIGINT AS n_visible FROM documents d LEFT JOIN labels USING (doc_id) WHERE length(replace(text, chr(10), '')) > 0")
def pdf_visible_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, those labelled toxic in an invisible render mode."""
    df = _pages_of(_table(spark, sf_dir, "documents")).join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"), "doc_id", "left")
    hidden = F.transform("pages", lambda p: F.concat(F.when(F.col("toxic") == 1, F.lit("3 Tr ")).otherwise(""), p))
    seen = _glyphs(files(df.select("doc_id", hidden.alias("pages"))))
    return seen.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_glyphs"), F.count_if(~F.col("mode").isin(3, 7)).alias("n_visible"))


@query("SELECT page_id AS doc_id, page_id % 3 = 0 OR (page_id % 3 = 1 AND length(url) <= 32) AS is_likely_scanned FROM pages")
def pdf_scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image over all, most or a corner of each page, with the page's address as text or without."""
    image = lambda w, h: F.lit(f"q {w} 0 0 {h} 0 0 cm BI /W 1 /H 1 /CS /G /BPC 8 ID x EI Q\n")
    label = show_lines(F.array("url"))
    page = F.when(F.col("page_id") % 3 == 0, image(612, 792)).when(F.col("page_id") % 3 == 1, F.concat(image(600, 700), label)).otherwise(F.concat(image(100, 100), label))
    opened = stored(open_documents(files(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.array(page).alias("pages")))), "pdf-opened")
    prims = page_primitives(opened, ("glyph", "image"))
    glyphs = text.assembled(prims.where("kind = 'glyph'"))
    return page_ops.likely_scanned(page_ops.page_boxes(opened), glyphs, prims.where("kind = 'image'")).select("doc_id", "is_likely_scanned")


_POLY = "SELECT vec_id AS doc_id, [round(x::DOUBLE * 100 + 300, 2) FOR x IN embedding[1:len(embedding) // 2]] AS xs, [round(x::DOUBLE * 100 + 300, 2) FOR x IN embedding[len(embedding) // 2 + 1:len(embedding) // 2 * 2]] AS ys FROM embeddings WHERE len(embedding) > 1"


@query(f"SELECT doc_id, round(list_min(xs), 2) AS x0, round(list_min(ys), 2) AS y0, round(list_max(xs), 2) AS x1, round(list_max(ys), 2) AS y1, len(xs)::INT AS n_cmds FROM ({_POLY})")
def pdf_path_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as polylines: the first half has the points' x, the second their y. One number is no point."""
    v = _table(spark, sf_dir, "embeddings").where("size(embedding) > 1").withColumn("half", F.floor(F.size("embedding") / 2).cast("int"))
    at = lambda i: F.format_string("%.2f", F.round(F.element_at("embedding", i).cast("double") * 100 + 300, 2))
    path = F.transform(F.sequence(F.lit(1), F.col("half")), lambda i: F.concat(at(i), F.lit(" "), at(i + F.col("half")), F.when(i == 1, F.lit(" m\n")).otherwise(" l\n")))
    df = v.select(F.col("vec_id").alias("doc_id"), F.array(F.concat(F.array_join(path, ""), F.lit("S"))).alias("pages"))
    b = F.col("bbox")
    return file_primitives(files(df), ("path",)).select("doc_id", *[F.round(b[i], 2).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.size("cmds").alias("n_cmds"))


@query(
    """SELECT p_partkey AS doc_id, round(CASE p_size % 3 WHEN 0 THEN p_size / 50.0 WHEN 1 THEN p_size / 50.0 ELSE (1 - p_size / 50.0) * 0.75 END, 4) AS red,
round(CASE p_size % 3 WHEN 0 THEN p_size / 50.0 WHEN 1 THEN 0.5 ELSE 0.75 END, 4) AS green, round(CASE p_size % 3 WHEN 0 THEN p_size / 50.0 WHEN 1 THEN 0.25 ELSE 0.75 END, 4) AS blue,
round(2.0 * p_size, 3) AS width FROM part"""
)
def pdf_path_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray, RGB and CMYK fills, below a scaling matrix."""
    s = F.format_string("%.4f", F.col("p_size") / 50.0)
    color = F.when(F.col("p_size") % 3 == 0, F.concat(s, F.lit(" g"))).when(F.col("p_size") % 3 == 1, F.concat(s, F.lit(" 0.5 0.25 rg"))).otherwise(F.concat(s, F.lit(" 0 0 0.25 k")))
    page = F.concat(F.lit("q 2 0 0 2 5 5 cm "), color, F.lit(" 0 0 "), F.col("p_size").cast("string"), F.lit(" 10 re f Q"))
    prims = file_primitives(files(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array(page).alias("pages"))), ("path",))
    return prims.select("doc_id", *[F.round(F.col("fill")[i], 4).alias(n) for i, n in enumerate(("red", "green", "blue"))], F.round(g.width(g.rect_of(F.col("bbox"))), 3).alias("width"))


@query(
    """WITH p AS (SELECT p_partkey AS doc_id, p_size, unnest(range(1, p_size + 1)) AS k FROM part)
SELECT doc_id, k::INT AS path, round(CASE WHEN k = 1 THEN 1.0 ELSE 2.0 + 1.5 * (k - 2) END, 3) AS x0, round(CASE WHEN k = 1 THEN 1 ELSE 1.5 END * 2.0, 3) AS width, CASE WHEN k % 2 = 0 THEN round(k / 50.0, 4) ELSE 0.0 END AS red,
CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0.0 END AS green, round(CASE WHEN k = p_size THEN 3.0 ELSE 1.0 END * CASE WHEN k = 1 THEN 1 ELSE 1.5 END, 3) AS line_width FROM p"""
)
def pdf_graphics_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames inside frames, as many as a part's size, a square painted at the end of each: on the way out every frame has
    its own matrix again, and the colour and width that were set in it or around it."""
    k = F.sequence(F.lit(1), "p_size")
    enter = F.transform(k, lambda i: F.concat(F.lit("q 1 0 0 1 1 0 cm "), F.when(i % 2 == 0, F.concat(F.format_string("%.4f", i / 50.0), F.lit(" 0.5 0 rg "))).otherwise(F.lit("0 g ")), F.when(i == 2, F.lit("1.5 0 0 1 0 0 cm ")).otherwise(""), F.when(i == F.col("p_size"), F.lit("3 w ")).otherwise("")))
    leave = F.transform(k, lambda i: F.concat(F.lit("0 0 2 2 re B "), F.lit("Q ")))
    made = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array(F.concat(F.array_join(enter, ""), F.array_join(leave, ""))).alias("pages"), "p_size")
    found = graphics.paths(graphics.states(graphics.operations(stored(open_documents(files(made.select("doc_id", "pages"))), "pdf-opened"))))
    number = F.expr("CAST(row_number() OVER (PARTITION BY doc_row ORDER BY i DESC) AS INT)")
    b = F.col("bbox")
    return found.select("doc_id", number.alias("path"), F.round(b[0], 3).alias("x0"), F.round(b[2] - b[0], 3).alias("width"), F.round(F.col("fill")[0], 4).alias("red"), F.round(F.col("fill")[1], 4).alias("green"), F.round("line_width", 3).alias("line_width"))


@query(
    """SELECT p_partkey AS doc_id, (p_size % 4 * 90)::INT AS rotation, CASE WHEN p_size % 2 = 1 THEN 500.0 ELSE 100.0 + p_size END AS width,
CASE WHEN p_size % 2 = 1 THEN 100.0 + p_size ELSE 500.0 END AS height FROM part"""
)
def pdf_page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with corners in any order and turned by multiples of 90."""
    df = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array(F.lit("")).alias("pages"), F.concat(F.lit("0 500 "), (F.col("p_size") + 100).cast("string"), F.lit(" 0")).alias("box"), (F.col("p_size") % 4 * 90 - 360).alias("rotate"))
    return page_ops.page_boxes(open_documents(files(df))).select("doc_id", "rotation", "width", "height")


def _updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as incremental updates of one page; of every other customer with cross reference streams."""
    rows = _table(spark, sf_dir, "orders", "o_custkey").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))).alias("rows"))
    pages = F.transform("rows", lambda r: F.array(show_lines(F.array(r["o_orderkey"].cast("string")))))
    return files(rows.withColumn("all", pages).select("doc_id", F.col("all")[0].alias("pages"), F.slice("all", 2, 1 << 30).alias("updates"), (F.col("doc_id") % 2 == 0).alias("as_stream")))


@query("SELECT o_custkey AS doc_id, max_by(o_orderkey, (o_orderdate, o_orderkey))::VARCHAR AS text FROM orders GROUP BY o_custkey")
def pdf_latest_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after all updates: the newest cross reference wins."""
    return text.page_text(_runs(_updated(spark, sf_dir))).select("doc_id", "text")


@query("WITH c AS (SELECT o_custkey AS doc_id, count(*) AS k FROM orders GROUP BY o_custkey) SELECT doc_id, num, 'offset' AS kind, CASE WHEN num = 5 THEN 0 ELSE k - 1 END::INT AS section FROM c, (SELECT unnest(range(1, 6)) AS num)")
def pdf_xref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object of the updated files, and how many updates back its newest version was written: the page's content in the
    last one, all else in the first."""
    return inside(_updated(spark, sf_dir).withColumnRenamed("doc_id", "doc_row")).xref.select(F.col("doc_row").alias("doc_id"), "num", "kind", "section")


@query("SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 5 > 1 AND p_size <= 32 THEN p_partkey END AS value, p_size AS hops FROM part")
def pdf_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of 1 to 50 steps, of every fifth part in a circle and of another fifth to nothing."""
    chain = F.transform(F.sequence(F.lit(1), "p_size"), lambda i: F.struct((9 + i).alias("num"), F.concat((10 + i).cast("string"), F.lit(" 0 R")).alias("body")))
    last = F.struct((F.col("p_size") + 10).alias("num"), F.when(F.col("p_partkey") % 5 == 0, F.lit("10 0 R")).when(F.col("p_partkey") % 5 == 1, F.lit("9 0 R")).otherwise(F.col("p_partkey").cast("string")).alias("body"))
    root = F.array(F.struct(F.lit(1).alias("num"), F.lit("<< /Type /Catalog >>").alias("body")))
    made = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(root, chain, F.array(last)).alias("objects"), (F.col("p_partkey") % 2 == 0).alias("packed"))
    found = inside(object_files(made).withColumnRenamed("doc_id", "doc_row"))
    steps = found.objects.where("num > 9 and start is null").groupBy("doc_row").agg((F.count(F.lit(1)) - 1).cast("int").alias("hops"))
    value = found.resolved().where("num = 10").select("doc_row", F.try_variant_get("body", "$", "long").alias("value"))
    return steps.join(value, "doc_row").select(F.col("doc_row").alias("doc_id"), "value", "hops")


@query(
    """WITH p AS (SELECT p_partkey AS doc_id, p_size, unnest(range(p_size % 20 + 1)) AS i FROM part)
SELECT doc_id, i::INT AS page_index, (i // 3 * 270 % 360)::INT AS rotate, 100.0 + p_size AS width, CASE WHEN i >= 5 THEN 50.0 ELSE 100.0 + p_size END AS crop_width, false AS truncated FROM p"""
)
def pdf_page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of 1 to 20 levels, a page and the next level on each: boxes and rotation come from the nearest level above.
    Every other file has its tree inside an object stream."""
    last = F.col("p_size") % 20
    level = lambda i: F.concat(
        F.lit("<< /Type /Pages /Kids ["), (2 * i + 3).cast("string"), F.lit(" 0 R "), F.when(i < last, F.concat((2 * i + 4).cast("string"), F.lit(" 0 R"))).otherwise(""), F.lit("]"),
        F.when(i == 0, F.concat(F.lit(" /MediaBox [0 0 "), (F.col("p_size") + 100).cast("string"), F.lit(" 500]"))).when(i == 5, F.lit(" /CropBox [50 100 0 0]")).otherwise(""),
        F.when(i % 3 == 0, F.concat(F.lit(" /Rotate "), (90 * i).cast("string"))).otherwise(""), F.lit(" >>"),
    )
    node = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.array(F.struct((2 * i + 2).alias("num"), level(i).alias("body")), F.struct((2 * i + 3).alias("num"), F.lit("<< /Type /Page >>").alias("body")))))
    root = F.array(F.struct(F.lit(1).alias("num"), F.lit("<< /Type /Catalog /Pages 2 0 R >>").alias("body")))
    made = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(root, node).alias("objects"), (F.col("p_partkey") % 2 == 0).alias("packed"))
    found = inside(object_files(made).withColumnRenamed("doc_id", "doc_row")).pages()
    wide = lambda c: F.col(c)[2] - F.col(c)[0]
    return found.select(F.col("doc_row").alias("doc_id"), "page_index", "rotate", wide("media").alias("width"), F.coalesce(wide("crop"), wide("media")).alias("crop_width"), "truncated")


@query("SELECT p_partkey AS doc_id, num, md5(CASE num WHEN 5 THEN 'logo' WHEN 6 THEN p_type ELSE p_name END) AS digest FROM part, (SELECT unnest([5, 6, 7]) AS num)")
def pdf_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three image objects in each part's file: one that all share, one of its type and one of its own, by content."""
    image = lambda s, more="": F.concat(F.lit(f"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 {more}/Length "), F.length(s).cast("string"), F.lit(" >>\nstream\n"), s, F.lit("\nendstream"))
    hexed = F.hex(F.encode("p_name", "UTF-8"))
    bodies = [(1, F.lit("<< /Type /Catalog >>")), (5, image(F.lit("logo"))), (6, image(F.col("p_type"))), (7, image(hexed, "/Filter /ASCIIHexDecode "))]
    made = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array(*[F.struct(F.lit(n).alias("num"), b.alias("body")) for n, b in bodies]).alias("objects"), F.lit(False).alias("packed"))
    held = stored(object_files(made).withColumnRenamed("doc_id", "doc_row"), "pdf-made")
    found = image_contents(held, inside(held).objects)
    return found.select(F.col("doc_row").alias("doc_id"), "num", F.md5("data").alias("digest"))


@query("SELECT (c_custkey // 1000)::VARCHAR AS file, (row_number() OVER (PARTITION BY c_custkey // 1000 ORDER BY c_custkey) - 1)::INT AS page_index, c_name AS text FROM customer")
def pdf_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each customer, a thousand to a file at most, read with the data source in splits."""
    block = F.floor(F.col("c_custkey") / 1000).cast("string").alias("file")
    rows = _table(spark, sf_dir, "customer").groupBy(block).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("rows"))
    made = files(rows.select(F.col("file").cast("long").alias("doc_id"), F.transform("rows", lambda r: show_lines(F.array(r["c_name"]))).alias("pages")))
    at = folder(spark, "pdf-files")
    write_files(made.select(F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), "content"), at)
    register_sources(spark)
    runs = spark.read.format("pdf").option("rows", "run").option("splitBytes", 1 << 16).schema("path string, page_index int, own_text string").load(at)
    return runs.select(F.regexp_extract("path", r"([^/]*)\.pdf$", 1).alias("file"), "page_index", F.col("own_text").alias("text"))


_ENCODERS = ("FlateDecode", "ASCII85Decode", "ASCIIHexDecode", "RunLengthDecode", "LZWDecode")


@query(f"WITH {_LINES_SQL}, f AS (SELECT doc_id, string_agg(text, chr(12) ORDER BY page_index) AS text FROM t WHERE text <> '' GROUP BY doc_id) SELECT doc_id, md5(text) AS digest FROM f")
def pdf_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content through each stream filter in turn."""
    df = _pages_of(_table(spark, sf_dir, "documents")).select("doc_id", "pages", F.element_at(F.array(*map(F.lit, _ENCODERS)), (F.pmod("doc_id", F.lit(5)) + 1).cast("int")).alias("encoder"))
    return text.document_text(text.page_text(_runs(files(df)))).select("doc_id", F.md5("text").alias("digest"))


@query(f"WITH {_LINES_SQL} SELECT doc_id, true AS recovered, count(*)::INT AS page_count, md5(string_agg(text, chr(12) ORDER BY page_index) FILTER (text <> '')) AS digest FROM t GROUP BY doc_id")
def pdf_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose cross references can't be found are rebuilt by scanning."""
    opened = open_documents(files(_pages_of(_table(spark, sf_dir, "documents")).select("doc_id", "pages"), broken=True))
    opened = stored(opened, "pdf-opened")
    texts = text.document_text(text.page_text(page_primitives(opened, ("run",), RUN_COLUMNS))).drop("doc_id")
    return documents(opened).join(texts, "doc_row", "left").select("doc_id", "recovered", "page_count", F.md5("text").alias("digest"))


@query("SELECT c_custkey AS doc_id, c_custkey % 3 <> 2 AS encrypted, CASE WHEN c_custkey % 3 = 2 THEN 'Password' END AS error_kind, CASE WHEN c_custkey % 3 <> 2 THEN c_name END AS text FROM customer")
def pdf_encrypted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted files read with the right password, or with a wrong one, which gives an error row."""
    df = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.array(show_lines(F.array("c_name"))).alias("pages"), F.col("c_mktsegment").alias("password"))
    wrong = F.when(F.col("doc_id") % 3 == 2, F.lit("?")).otherwise(F.col("password"))
    opened = stored(open_documents(files(df).withColumn("password", wrong)), "pdf-opened")
    found = documents(opened).join(text.page_text(page_primitives(opened, ("run",), RUN_COLUMNS)).select("doc_row", "text"), "doc_row", "left")
    return found.select("doc_id", F.coalesce("encrypted", F.lit(False)).alias("encrypted"), "error_kind", "text")


@query("WITH c AS (SELECT p_type, unnest(string_split(p_name, '')) AS c FROM part) SELECT p_type AS base_font, count(*)::BIGINT AS total, count(*) FILTER (c = 'a')::BIGINT AS unmapped, round(100.0 * count(*) FILTER (c = 'a') / count(*), 3) AS pct, round(100.0 * count(*) FILTER (c = 'a') / count(*), 3) > 5 AS marked FROM c WHERE c <> '' GROUP BY ROLLUP (p_type)")
def pdf_font_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in a font of the part's type, in which the letter a has no known meaning."""
    font = F.concat(F.lit("<< /Type /Font /Subtype /Type1 /BaseFont /"), F.replace("p_type", F.lit(" "), F.lit("#20")), F.lit(" /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [97 /mute] >> >>"))
    df = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array(show_lines(F.array("p_name"))).alias("pages"), font.alias("font"))
    return reports.font_coverage(text.with_spaces(_glyphs(files(df), None))).select("base_font", "total", "unmapped", "pct", "marked")


@query(
    """WITH c AS (SELECT p_type || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '-Bold' ELSE '-Italic' END AS base_font, p_size % 3 AS k, unnest(string_split(p_name || chr(48 + p_size % 10), '')) AS c FROM part)
SELECT base_font, 256 + CASE k WHEN 0 THEN 0 WHEN 1 THEN 128 ELSE 16 END AS flags, array_to_string(list_sort(list_distinct(list(ascii(c)) FILTER (c IN ('a', 'e', '3', '4', '5'))))[1:12], ',') AS codes FROM c WHERE c <> '' GROUP BY base_font, k"""
)
def pdf_font_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a digit in fonts of three styles that don't map two letters and three digits: styles by name, and the codes."""
    style = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, "-Bold").otherwise("-Italic")
    font = F.concat(F.lit("<< /Type /Font /Subtype /Type1 /BaseFont /"), F.replace("p_type", F.lit(" "), F.lit("#20")), style, F.lit(" /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [51 /mute /mute /mute 97 /mute 101 /mute] >> >>"))
    said = F.concat("p_name", (F.col("p_size") % 10).cast("string"))
    df = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array(show_lines(F.array(said))).alias("pages"), font.alias("font"))
    found = reports.font_coverage(text.with_spaces(_glyphs(files(df), None))).where("base_font is not null")
    return found.select("base_font", "flags", F.array_join(F.transform("codes", lambda c: c.cast("string")), ",").alias("codes"))


_WORDS = r"regexp_extract_all(lower(replace({}, chr(173), '')), '[0-9A-Za-z]+(?:[''\-][0-9A-Za-z]+)*')"
#: Every word of doc_id % 4 = 0 is kept, of the others each tenth, third or second is another one.
_ALTERED = "array_to_string(list_transform(string_split(replace(text, chr(10), ' '), ' '), lambda w, i: CASE WHEN doc_id % 4 <> 0 AND i % (CASE doc_id % 4 WHEN 1 THEN 10 WHEN 2 THEN 3 ELSE 2 END) = 0 THEN 'zzz' ELSE w END), ' ')"
_AGREED = rf"""w AS (SELECT doc_id AS id, {_WORDS.format("text")} AS r, {_WORDS.format(_ALTERED)} AS o FROM documents WHERE text IS NOT NULL),
b AS (SELECT id, r, o, list_distinct([array_to_string(r[i:i + 1], ' ') FOR i IN range(1, greatest(2, len(r)))]) AS rb, list_distinct([array_to_string(o[i:i + 1], ' ') FOR i IN range(1, greatest(2, len(o)))]) AS ob FROM w WHERE len(r) > 0),
f AS (SELECT id, len(r)::INT AS n_words, round(len(list_intersect(rb, ob)) / len(rb), 4) AS bigram_recall, round(len(list_intersect(list_distinct(r), list_distinct(o))) / len(list_distinct(list_concat(r, o))), 4) AS jaccard, round(len(o) / len(r), 4) AS length_ratio FROM b),
v AS (SELECT *, CASE WHEN n_words < 50 THEN NULL WHEN bigram_recall >= 0.80 THEN 'ok' WHEN bigram_recall >= 0.55 THEN 'WEAK' ELSE 'DIVERGENT' END AS verdict FROM f)"""


def _agreed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against files of them in which some words are others."""
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    every = F.when(F.col("doc_id") % 4 == 1, 10).when(F.col("doc_id") % 4 == 2, 3).otherwise(2)
    words = F.transform(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda w, i: F.when((F.col("doc_id") % 4 != 0) & ((i + 1) % every == 0), "zzz").otherwise(w))
    lines = F.transform(F.sequence(F.lit(0), F.floor((F.size("_words") - 1) / 12).cast("int")), lambda i: F.array_join(F.slice("_words", i * 12 + 1, 12), " "))
    made = docs.withColumn("_words", words).withColumn("_lines", lines).withColumn("pages", F.transform(in_pages(F.col("_lines"), LINES), lambda p: show_lines(p)))
    ours = text.document_text(text.page_text(_runs(files(made.select("doc_id", "pages"))))).select(F.col("doc_id").alias("id"), F.translate("text", "\f", "\n").alias("ours"))
    return reports.agreement(ours.join(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("reference")), "id")).where("n_words > 0")


@query(f"WITH {_AGREED} SELECT * FROM v")
def pdf_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram recall, word overlap and verdicts of texts that agree wholly, mostly, weakly or not."""
    return _agreed(spark, sf_dir)


@query(f"WITH {_AGREED} SELECT count(*)::BIGINT AS n_docs, round(avg(bigram_recall), 6) AS bigram_recall, round(avg(jaccard), 6) AS jaccard FROM v WHERE verdict IS NOT NULL")
def pdf_agreement_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means over documents with a verdict."""
    return reports.mean_agreement(stored(_agreed(spark, sf_dir), "pdf-agreement")).select("n_docs", *[F.round(c, 6).alias(c) for c in ("bigram_recall", "jaccard")])


@query("SELECT p_partkey AS doc_id, p_name AS text FROM part WHERE p_name <> ''")
def pdf_soft_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with soft hyphens, shown by code points: the hyphens aren't text."""
    name = F.concat(F.substring("p_name", 1, 3), F.lit("\u00ad"), F.expr("substring(p_name, 4)"), F.lit("\u00ad"))
    df = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array(show_lines(F.array(name), wide=F.lit(True))).alias("pages"))
    return text.page_text(_runs(files(df))).select("doc_id", "text")


@query("SELECT o_orderkey AS doc_id, (length(o_orderkey::VARCHAR) + length(o_custkey::VARCHAR) + 1)::BIGINT AS n, (length(o_orderkey::VARCHAR) + length(o_custkey::VARCHAR) + 1)::INT AS last, (length(o_orderkey::VARCHAR) + 1)::INT AS space_at, round(128 - 5.56 * length(o_orderkey::VARCHAR), 3) AS space_width, 10.0::DOUBLE AS space_height FROM orders")
def pdf_paint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two numbers apart, and a rectangle painted between them: the generated space comes after it."""
    cell = lambda x, s: F.concat(F.lit(f"BT /F1 10 Tf {x} 700 Td "), shown(s), F.lit(" ET\n"))
    page = F.concat(cell(72, F.col("o_orderkey").cast("string")), F.lit("0 0 5 5 re f\n"), cell(200, F.col("o_custkey").cast("string")))
    prims = file_primitives(files(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.array(page).alias("pages"))), ("glyph", "path"), (*TEXT_COLUMNS, "advance"))
    space = F.col("is_generated_space")
    at = lambda c: F.max(F.when(space, c))
    found = text.with_spaces(prims).groupBy("doc_row").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.max("ord").alias("last"), at(F.col("ord")).alias("space_at"), F.round(at(F.col("bbox")[2] - F.col("bbox")[0]), 3).alias("space_width"), at(F.col("bbox")[3] - F.col("bbox")[1]).alias("space_height"))
    return found.drop("doc_row")


@query(
    """WITH c AS (SELECT p_partkey AS doc_id, least(300.0, p_size * 10.0) AS x1, p_size * 10.0 <= 10 AS empty FROM part)
SELECT doc_id, CASE WHEN empty THEN 0.0 ELSE 10.0 END::DOUBLE AS x0, CASE WHEN empty THEN 300.0 ELSE x1 END::DOUBLE AS x1, CASE WHEN empty THEN 0.0 ELSE 20.0 END::DOUBLE AS y0, 400.0::DOUBLE AS y1 FROM c"""
)
def pdf_crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop boxes that reach beyond the page, or lie outside it."""
    df = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array(F.lit("")).alias("pages"), F.lit("0 0 300 400").alias("box"), F.concat(F.lit("10 20 "), (F.col("p_size") * 10).cast("string"), F.lit(" 500")).alias("crop"))
    return page_ops.page_boxes(open_documents(files(df))).select("doc_id", *[F.col("crop_box")[c].alias(c) for c in ("x0", "x1", "y0", "y1")])


@query(
    """WITH g AS (SELECT p_partkey, p_size, unnest(range(length(p_size::VARCHAR))) AS i FROM part), k AS (SELECT p_partkey, count(*) FILTER (p_size * 10 + 5.56 * i <= 200) AS n FROM g GROUP BY p_partkey)
SELECT p_partkey AS doc_id, n AS n_glyphs, 1::BIGINT AS n_paths FROM part JOIN k USING (p_partkey) WHERE p_size * 10 <= 200"""
)
def pdf_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of a page touches a region: numbers and squares at the place that their size says."""
    x = (F.col("p_size") * 10).cast("string")
    page = F.concat(F.lit("BT /F1 10 Tf "), x, F.lit(" 300 Td "), shown(F.col("p_size").cast("string")), F.lit(" ET "), x, F.lit(" 20 30 30 re f"))
    prims = file_primitives(files(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array(page).alias("pages"))), ("glyph", "path"))
    return reports.totals(page_ops.in_region(prims, 0, 0, 200, 400)).select("doc_id", "n_glyphs", "n_paths")


@query(
    """WITH r AS (SELECT n_nationkey AS region_id, n_nationkey * 20.0 AS x0, 15.0 AS y0, n_nationkey * 20.0 + n_nationkey * n_nationkey AS x1, 15.0 + n_nationkey AS y1 FROM nation),
s AS (SELECT p_partkey AS doc_id, p_size * 10.0 AS x0, 20.0 AS y0, p_size * 10.0 + 30 AS x1, 50.0 AS y1 FROM part UNION ALL SELECT p_partkey, 0, 0, 612, 792 FROM part WHERE p_size % 7 = 0)
SELECT region_id, doc_id, count(*) AS n FROM r JOIN s ON s.x0 <= r.x1 AND s.x1 >= r.x0 AND s.y0 <= r.y1 AND s.y1 >= r.y0 GROUP BY region_id, doc_id"""
)
def pdf_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region for each nation, of growing size, and all shapes of all pages that touch it: squares by a part's size, and page-wide ones."""
    wide = F.when(F.col("p_size") % 7 == 0, F.lit("0 0 612 792 re S ")).otherwise("")
    page = F.concat((F.col("p_size") * 10).cast("string"), F.lit(" 20 30 30 re f "), wide)
    opened = open_documents(files(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array(page).alias("pages"))))
    n = F.col("n_nationkey")
    areas = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("region_id"), (n * 20 + n * n).alias("x0"), F.lit(15).alias("y0"), (n * 20).alias("x1"), (n + 15).alias("y1"))
    found = page_ops.in_regions(page_primitives(opened, ("path",), ("doc_row", "doc_id", "page_index", "kind", "seq", "bbox", "x", "y", "end_x", "end_y", "size", "rotation")), areas)
    return found.groupBy("region_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p_partkey AS doc_id, length(p_name)::BIGINT + CASE WHEN p_size % 2 = 1 THEN 3 ELSE 0 END AS n_glyphs, (p_size % 5)::BIGINT AS n_paths, (p_size % 3)::BIGINT AS n_images,
CASE WHEN p_size % 2 = 1 THEN 'Helvetica,Wide' ELSE 'Helvetica' END AS fonts FROM part"""
)
def pdf_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of pages with text in one font or two, and as many paths and images as a part's size says."""
    times = lambda n, s: F.repeat(F.lit(s), (F.col("p_size") % n).cast("int"))
    second = F.when(F.col("p_size") % 2 == 1, shown(F.lit("αβγ"))).otherwise("")
    page = F.concat(times(5, "1 1 2 2 re f "), times(3, "q 9 0 0 9 0 0 cm BI /W 1 /H 1 /CS /G /BPC 8 ID x EI Q "), F.lit("BT /F1 10 Tf 72 700 Td "), shown(F.col("p_name")), F.lit(" 0 -14 Td "), second, F.lit(" ET"))
    found = reports.totals(file_primitives(files(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array(page).alias("pages"))), columns=("doc_row", "doc_id", "kind", "base_font")))
    return found.withColumn("fonts", F.array_join("fonts", ",")).drop("doc_row")


@query("SELECT c_custkey AS doc_id, c_name || '-' || c_mktsegment || ' x ' || 'y' || ' ' || ' ' || 'z' AS text FROM customer")
def pdf_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replacement texts with every mark that is dropped, a hyphen that doesn't break, and controls and wide spaces, which become spaces."""
    marks = F.lit("\u00ad\u200b\u200e\u200f\u2060\ufeff")
    said = F.concat(marks, "c_name", F.lit("\u2011"), "c_mktsegment", F.lit("\u2003x\u0007"), marks, F.lit("y\u3000\u0085z"), marks)
    span = F.concat(F.lit("/Span << /ActualText <FEFF"), F.hex(F.encode(said, "UTF-16BE")), F.lit("> >> BDC BT /F1 10 Tf 72 742 Td (ab) Tj ET EMC"))
    opened = open_documents(files(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.array(span).alias("pages"))))
    return text.page_text(page_primitives(opened, ("run",), RUN_COLUMNS)).select("doc_id", "text")


_M = ", ".join(f"coalesce(embedding[{i + 1}], 0)::DOUBLE AS {c}" for i, c in enumerate(("a", "b", "c", "d", "e", "f", "a2", "b2", "c2", "d2", "e2", "f2", "x", "y")))


@query(
    f"""WITH m AS (SELECT vec_id, {_M} FROM embeddings), p AS (SELECT *, a * a2 + b * c2 AS ca, a * b2 + b * d2 AS cb, c * a2 + d * c2 AS cc, c * b2 + d * d2 AS cd, e * a2 + f * c2 + e2 AS ce, e * b2 + f * d2 + f2 AS cf, a * d - b * c AS det FROM m)
SELECT vec_id, round(ca * x + cc * y + ce, 5)::DECIMAL(18,5)::DOUBLE AS px, round(cb * x + cd * y + cf, 5)::DECIMAL(18,5)::DOUBLE AS py, round(ca * x + cc * y, 5)::DECIMAL(18,5)::DOUBLE AS vx, round(cb * x + cd * y, 5)::DECIMAL(18,5)::DOUBLE AS vy,
round(least(0, ca) + least(0, cc) + ce, 5)::DECIMAL(18,5)::DOUBLE AS rx0, round(greatest(0, cb) + greatest(0, cd) + cf, 5)::DECIMAL(18,5)::DOUBLE AS ry1, round(atan2(cb, ca), 5)::DECIMAL(18,5)::DOUBLE AS turn, round(sqrt(ca * ca + cb * cb), 5)::DECIMAL(18,5)::DOUBLE AS sx, round(sqrt(cc * cc + cd * cd), 5)::DECIMAL(18,5)::DOUBLE AS sy,
CASE WHEN abs(det) >= 1e-2 THEN round((d * x - c * y + c * f - d * e) / det, 3)::DECIMAL(18,3)::DOUBLE END AS ix, round((a + 1) * 2, 5)::DECIMAL(18,5)::DOUBLE AS scaled,
round(least(a, x), 5)::DECIMAL(18,5)::DOUBLE AS ux0, round(greatest(d, b2), 5)::DECIMAL(18,5)::DOUBLE AS uy1 FROM p"""
)
def pdf_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a vector as two matrices, a point and corners: products, images, inverse, union."""
    n = dict(zip(("a", "b", "c", "d", "e", "f", "a2", "b2", "c2", "d2", "e2", "f2", "x", "y"), [F.coalesce(F.try_element_at("embedding", F.lit(i + 1)), F.lit(0)).cast("double") for i in range(14)], strict=True))
    m, m2 = g.matrix(*[n[c] for c in "abcdef"]), g.matrix(*[n[f"{c}2"] for c in "abcdef"])
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", m.alias("m"), m2.alias("m2"), n["x"].alias("x"), n["y"].alias("y"))
    df = df.withColumn("both", g.concat(F.col("m"), F.col("m2")))
    both, x, y, m = F.col("both"), F.col("x"), F.col("y"), F.col("m")
    p, v, r = g.apply(both, x, y), g.apply_vector(both, x, y), g.apply_rect(both, g.rect(0.0, 0.0, 1.0, 1.0))
    back = F.when(F.abs(m["a"] * m["d"] - m["b"] * m["c"]) >= 1e-2, g.apply(g.invert(m), x, y)["x"])
    scaled = g.apply(g.concat(g.translation(1, 0), g.scaling(2, 2)), m["a"], m["b"])["x"]
    # a corner beyond keeps both boxes from being empty
    u = g.union(g.rect(m["a"], m["b"] - 100, m["c"] + 100, m["d"]), g.rect(x, y - 100, F.col("m2")["a"] + 100, F.col("m2")["b"]))
    made = {"px": p["x"], "py": p["y"], "vx": v["x"], "vy": v["y"], "rx0": r["x0"], "ry1": r["y1"], "turn": g.rotation(both), "sx": g.x_scale(both), "sy": g.y_scale(both), "scaled": scaled}
    return df.select("vec_id", *[F.round(c, 5).alias(k) for k, c in made.items()], F.round(back, 3).alias("ix"), F.round(u["x0"], 5).alias("ux0"), F.round(u["y1"], 5).alias("uy1"))


@query(
    """WITH p AS (SELECT p_partkey AS doc_id, p_size % 4 AS k, 100.0 + p_size AS w FROM part)
SELECT doc_id, 2.0 * CASE k WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN w - 10 ELSE 480 END::DOUBLE AS x, 2.0 * CASE k WHEN 0 THEN 480 WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE w - 10 END::DOUBLE AS y FROM p"""
)
def pdf_page_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The point (10, 20) of turned pages, on a raster of two dots a unit."""
    df = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.array(F.lit("")).alias("pages"), F.concat(F.lit("0 0 "), (F.col("p_size") + 100).cast("string"), F.lit(" 500")).alias("box"), (F.col("p_size") % 4 * 90).alias("rotate"))
    boxes = page_ops.page_boxes(open_documents(files(df)))
    at = g.apply(page_ops.page_matrix(F.col("crop_box"), F.col("rotation"), 2.0), F.lit(10.0), F.lit(20.0))
    return boxes.select("doc_id", at["x"].alias("x"), at["y"].alias("y"))
