"""`spark.read.format("pdf")` and `pdf_glyphs` against files of known pages."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, Not, StringEndsWith

from folioquery.sources.datasource import BLOCK, PdfReader, _schema, register
from folioquery.sources.pdf_writer import build

PAGES = 300


def page(i):
    return b"BT /F1 10 Tf 72 700 Td (page %d) Tj ET" % i


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    register(spark)
    root = tmp_path_factory.mktemp("pdfs")
    (root / "deep").mkdir()
    (root / "large.pdf").write_bytes(build([page(i) for i in range(PAGES)]))
    (root / "deep" / "small.PDF").write_bytes(build([page(0), b""]))
    (root / "broken.pdf").write_bytes(b"not a file of pages")
    (root / "secret.pdf").write_bytes(build([page(0)], password="p"))
    (root / "notes.txt").write_bytes(b"x")
    return str(root)


def read(spark, folder, rows="page", split=1 << 30, **options):
    return spark.read.format("pdf").options(rows=rows, splitBytes=split, **options).load(folder)


def test_documents(spark, folder):
    found = {r["path"].rsplit("/", 1)[1]: (r["page_count"], r["error_kind"]) for r in read(spark, folder, "document").collect()}
    assert found == {"large.pdf": (PAGES, None), "small.PDF": (2, None), "broken.pdf": (None, "Parse"), "secret.pdf": (None, "Password")}
    assert read(spark, folder + "/secret.pdf", "document", password="p").first()["encrypted"]


def test_splits_cover_every_page_once(spark, folder):
    for split in (1 << 30, 20_000, 900):
        runs = read(spark, folder, "run", split).where(F.col("path").endswith("large.pdf"))
        assert sorted((r["page_index"], r["own_text"]) for r in runs.collect()) == [(i, f"page {i}") for i in range(PAGES)]
    assert read(spark, folder, "run", 20_000).rdd.getNumPartitions() > 3


def test_filters_reach_the_reader(spark, folder):
    pages = read(spark, folder, "page", 20_000).where("page_index > 5 and page_index <= 7 and path like '%large.pdf'").select("page_index")
    assert sorted(r[0] for r in pages.collect()) == [6, 7]
    assert pages.rdd.getNumPartitions() == 1  # one split of one file
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan pdf" in plan and "Filter (" not in plan  # nothing is left for Spark to test
    kept = read(spark, folder).where("page_index % 2 = 0 and path not like '%large%'")
    assert [r["page_index"] for r in kept.collect()] == [0]


def test_planning(folder):
    def reader(*filters, split=900):
        r = PdfReader(_schema("page"), {"path": folder, "splitBytes": str(split)})
        rest = list(r.pushFilters(list(filters)))
        return rest, [p for f in r.partitions() for p in f.parts]

    other = Not(EqualTo(("path",), "x"))
    rest, parts = reader(EqualTo(("page_index",), BLOCK * 2 + 1), StringEndsWith(("path",), "large.pdf"), other)
    assert rest == [other] and len(parts) == 1 and parts[0][1] == 2
    assert len(reader(GreaterThan(("page_index",), 5), LessThanOrEqual(("page_index",), BLOCK), StringEndsWith(("path",), "large.pdf"))[1]) == 2
    assert reader(In(("page_index",), (1, 2)), In(("page_index",), (3,)), StringEndsWith(("path",), "large.pdf"))[1] == []
    assert len({p[1] for p in reader(StringEndsWith(("path",), "large.pdf"))[1]}) == reader(StringEndsWith(("path",), "large.pdf"))[1][0][2] > BLOCK


def test_columns(spark, folder):
    some = spark.read.format("pdf").option("rows", "glyph").schema("own_text string, path string").load(folder + "/deep")
    assert some.columns == ["own_text", "path"] and "".join(r[0] for r in some.collect()) == "page 0"
    for rows in ("document", "page", "glyph", "run", "path", "image"):
        assert read(spark, folder + "/deep", rows).count() == {"document": 1, "page": 2, "glyph": 6, "run": 1, "path": 0, "image": 0}[rows]
    with pytest.raises(Exception, match="no column"):
        spark.read.format("pdf").schema("path string, size double").load(folder).collect()
    with pytest.raises(Exception, match="rows: document"):
        read(spark, folder, "word").collect()


def test_table_function(spark, folder):
    files = spark.createDataFrame([(1, bytearray(build([page(1), page(2)]))), (2, None), (3, bytearray(b"junk"))], "id int, content binary")
    files.createOrReplaceTempView("some_files")
    found = spark.sql("SELECT id, g.page_index, string_agg(own_text, '') WITHIN GROUP (ORDER BY seq) AS text FROM some_files, LATERAL pdf_glyphs(content) g GROUP BY ALL ORDER BY ALL").collect()
    assert [tuple(r) for r in found] == [(1, 0, "page 1"), (1, 1, "page 2")]


def test_an_empty_folder(spark, folder, tmp_path):
    assert read(spark, str(tmp_path)).count() == 0
