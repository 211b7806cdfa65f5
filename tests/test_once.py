"""What is the same for many files is done once, and tables are made once."""

import random

import pytest

from folioquery.functions import fonts, lexemes, page_ops
from folioquery.functions.cos import Keyword, read
from folioquery.operators import text
from folioquery.sources import pdf as sources
from folioquery.sources import pdf_file, pdf_writer
from folioquery.sources.pdf import TEXT_COLUMNS, file_primitives, open_documents, page_primitives
from folioquery.sources.pdf_images import decoded_streams, held_images
from folioquery.sources.pdf_writer import build
from folioquery.sources.store import stored


def _page(words: str) -> bytes:
    return b"BT /F1 10 Tf 72 700 Td <" + words.encode().hex().encode() + b"> Tj ET 0 0 5 5 re f"


def test_one_stage_gives_the_rows_of_two(spark):
    rng, whole = random.Random(3), build([_page("one"), _page("two words")], encoder="FlateDecode")
    held = [whole, build([_page("αβ".encode("utf-16-be").hex())], password="x"), b"", None, *[whole[:i] + bytes([rng.randrange(256)]) + whole[i + 1 :] for i in rng.sample(range(len(whole)), 60)]]
    df = spark.createDataFrame([(i, i, bytearray(c) if c is not None else None) for i, c in enumerate(held)], "doc_row long, doc_id long, content binary")
    columns = (*TEXT_COLUMNS, "advance", "bbox", "fill", "base_font", "code")
    rows = lambda found: sorted(map(repr, found.select("doc_row", *[c for c in found.columns if c != "doc_row"]).collect()))
    assert rows(file_primitives(df, columns=columns)) == rows(page_primitives(open_documents(df), columns=columns)) != []
    assert rows(file_primitives(df, ("run",))) == rows(page_primitives(open_documents(df), ("run",)))


def test_equal_fonts_and_objects_of_files_are_read_once(monkeypatch):
    loaded, parsed = [], []
    monkeypatch.setattr(sources, "load", lambda pdf, font: loaded.append(font) or fonts.load(pdf, font))
    monkeypatch.setattr(sources, "_FONTS", {})
    monkeypatch.setattr(pdf_file, "_SAME", {})
    monkeypatch.setattr(pdf_file, "read", lambda data, pos=0, *a, **k: parsed.append(pos) or read(data, pos, *a, **k))
    other = pdf_writer.HELVETICA.replace("Helvetica", "Courier")
    for font in (pdf_writer.HELVETICA, other, pdf_writer.HELVETICA, other):
        (_, given), = sources._read(build([_page("x")], font=font), None)[1]
        assert given["fonts"]["F1"]["base"] == ("Courier" if "Courier" in font else "Helvetica")
        assert given["fonts"]["F1"]["widths"][ord("i")] == (600 if "Courier" in font else 222)
    assert len(loaded) == 2
    parsed.clear()
    sources._read(build([_page("y")]), None)
    assert len(parsed) < 15  # 46 when nothing is shared


def _slowly(data: bytes):
    pos, operands = 0, []
    while pos < len(data):
        item, after = read(data, pos, refs=False)
        pos = max(after, pos + 1)
        if not isinstance(item, Keyword):
            operands.append(item)
        elif item == b"BI":
            image, pos = page_ops._inline(data, pos)
            yield b"BI", [], image
            operands = []
        elif item:
            yield bytes(item), operands, None
            operands = []


PIECES = [b"12", b"-3", b"+7", b".5", b"4.", b"--5", b"1e3", b"<4142>", b"<4>", b"<41 42>", b"<<", b">>", b"/F1", b"/A#20", b"/", b"(ab)", b"(a(b)c)", b"(\\n)", b"(a\rb)", b"[", b"]", b"[(A) -93 (B)]", b"[1 0 R]", b"[ (x)-1.5<41>]", b"[]", b"Tj", b"T*", b"'", b'"', b"BI", b"ID", b"EI", b"true", b"null", b"f*", b"re", b"endobj", b"%c\n", b"\r", b"\0", b"{", b")", b"12345678901234567890", b"5.5.5", b"-0.0", b"d0", b"'a"]


def test_usual_tokens_are_what_the_reader_says():
    rng = random.Random(5)
    kinds = lambda found: [(repr(x), [type(v) for v in x[1]]) for x in found]
    for _ in range(20000):
        data = b"".join(rng.choice(PIECES) + rng.choice([b" ", b" ", b"", b"\n"]) for _ in range(rng.randint(1, 9)))
        assert kinds(page_ops.operations(data)) == kinds(_slowly(data)), data


@pytest.mark.parametrize("line", [b"[(A) -93 (B)] TJ T*\n", b"BT /F1 10 Tf 1 0 0 1 72 760 Tm <313233> Tj ET\n"])
def test_usual_tokens_need_no_reader(monkeypatch, line):
    calls = []
    monkeypatch.setattr(page_ops, "read", lambda *a, **k: calls.append(1) or read(*a, **k))
    assert len(list(page_ops.operations(line * 40))) == 40 * len([w for w in line.split() if w in (b"TJ", b"T*", b"BT", b"Tf", b"Tm", b"Tj", b"ET")])
    assert len(calls) <= 1


def test_short_and_long_strings_are_placed_alike(monkeypatch):
    said = b"BT /F1 7 Tf 1 0.5 -0.5 1 72 700 Tm 0.3 Tc 0.7 Tw 90 Tz 2 Ts <" + b"a word, and AV".hex().encode() + b"> Tj <4142> Tj ET"
    (page, given), = sources._read(build([said]), None)[1]
    found = []
    for short in (0, 1000):
        monkeypatch.setattr(page_ops, "SHORT", short)
        one = page_ops.Page(("glyph", "run"))
        one.run(page["content"], given)
        found.append(repr([[list(map(float, r[i])) for i in (3, 4, 5)] for r in one.runs]) + repr(one.shown))
    assert found[0] == found[1]


def test_maps_of_a_wide_font_are_made_and_read_once(monkeypatch):
    made, read_maps = [], []
    pdf_writer._wide_maps.cache_clear()
    monkeypatch.setattr(pdf_writer.zlib, "compress", lambda d, f=pdf_writer.zlib.compress: made.append(1) or f(d))
    monkeypatch.setattr(sources, "_FONTS", {})
    init = fonts.CMap.__init__
    monkeypatch.setattr(fonts.CMap, "__init__", lambda self, data=b"": read_maps.append(1) or init(self, data))
    for n, word in enumerate(("αβ", "x𝐀", "γ")):
        content = b"BT /F2 10 Tf 72 700 Td <" + word.encode("utf-32-be").hex().encode() + b"> Tj ET"
        (page, given), *_ = sources._read(build([content] + [b""] * n), None)[1]
        one = page_ops.Page(("run",))
        one.run(page["content"], given)
        assert [r[1] for r in one.shown] == [word]
    assert (len(made), len(read_maps)) == (2, 2)


def test_glyph_table_with_paths_is_made_in_one_pass(spark):
    df = spark.createDataFrame([(1, bytearray(build([b"BT /F1 10 Tf 72 700 Td (a) Tj ET 0 0 5 5 re f BT /F1 10 Tf 200 700 Td (b) Tj ET"])))], "doc_id long, content binary")
    found = text.with_spaces(file_primitives(df, ("glyph", "path"), (*TEXT_COLUMNS, "advance")))
    plan = found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert (plan.count("MapInArrow"), plan.count("Exchange"), plan.count("Union")) == (1, 1, 0)
    assert [(r.text, r.is_generated_space, r.ord) for r in found.orderBy("ord").collect()] == [("a", False, 0), (" ", True, 2), ("b", False, 3)]


def test_stored_tables_are_not_broadcast_by_the_size_of_their_files(spark):
    rows = spark.range(200_000).selectExpr("id div 1000 AS k", "7 AS v")  # a few KB as Parquet
    found = stored(rows, "test").where("v = 7").join(stored(rows.groupBy("k").count(), "test"), "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert found.count() == 200_000


def test_streams_are_combined_before_they_are_shuffled(spark):
    logo = b"%PDF-1.7\n1 0 obj\n<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /Length 4 >>\nstream\nlogo\nendstream\nendobj\n"
    df = spark.createDataFrame([(i, bytearray(logo)) for i in range(3)], "doc_row long, content binary")
    digests = stored(held_images(df, spark.createDataFrame([(i, 1, 9, 9) for i in range(3)], "doc_row long, num long, offset long, start long")).select("digest"), "test")
    found = decoded_streams(df, digests)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.index("SortMergeJoin") < plan.index("partial_")
    assert [bytes(r.data) for r in found.collect()] == [b"logo"]


def test_tokens_of_equal_objects_are_read_once(monkeypatch):
    calls = []
    monkeypatch.setattr(lexemes, "_SAME", {})
    monkeypatch.setattr(lexemes, "read", lambda *a, **k: calls.append(1) or read(*a, **k))
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R << /Type /Page >>] >>", **{n: b"<< /Type /Page /N %d >>" % n for n in range(3, 20)}}
    for made in (pdf_writer.file_of(objects), pdf_writer.packed_file(objects, set(objects))):
        first, n = list(lexemes.tokens(made)), len(calls)
        calls.clear()
        assert list(lexemes.tokens(made)) == first
        assert len(calls) < n - 17
        calls.clear()
    assert len([t for t in first if t[0] == "member" and t[2] < 0]) == 1  # taken out of /Kids each time
