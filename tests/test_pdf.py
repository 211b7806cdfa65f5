"""Whole files through the readers and the window operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from folioquery.functions import geometry as g
from folioquery.operators import pages, reports, text
from folioquery.sources import pdf, pdf_writer

ONE = pdf_writer.build([b"BT /F1 12 Tf 72 720 Td (Hi) Tj ET"])


def opened(spark, contents, **options):
    rows = [(i, bytearray(c) if c is not None else None) for i, c in enumerate(contents)]
    return pdf.open_documents(spark.createDataFrame(rows, "doc_id long, content binary"), **options)


def texts(spark, streams, **options):
    o = opened(spark, [pdf_writer.build([s], **options) for s in streams])
    by = [{r["doc_id"]: r["text"] for r in text.page_text(pdf.page_primitives(o, (kind,), columns)).collect()} for kind, columns in (("glyph", pdf.TEXT_COLUMNS), ("run", pdf.RUN_COLUMNS))]
    assert by[0] == by[1]
    return [by[0].get(i) for i in range(len(streams))]


BEGIN = b"BT /F1 12 Tf 72 720 Td "
CASES = [
    (b"(Hi) Tj ET", "Hi"),
    (b"[(A) -500 (B)] TJ ET", "A B"),
    (b"[(A) -20 (B)] TJ ET", "AB"),
    (b"[(A) -190 (B)] TJ ET", "A B"),
    (b"[(A) -80 (B)] TJ ET", "AB"),
    (b"(of) Tj 0 -14 Td (the) Tj ET", "of\nthe"),
    (b"1 0 0 1 300 700 Tm (end) Tj 1 0 0 1 72 700 Tm (start) Tj ET", "end\nstart"),
    (b"(a) Tj ET BT /F1 12 Tf 300 720 Td (b) Tj ET", "a b"),
    (b"(x) Tj 4 Ts /F1 7 Tf (2) Tj ET", "x2"),
    (b"3 Tr (hid) Tj ET", "hid"),
    (b"14 TL (a) Tj (b) ' ET", "a\nb"),
    (b"(a) Tj /Span <</ActualText (fi)>> BDC (xy) Tj EMC (b) Tj ET", "afib"),
    (b"(a) Tj /Span <</ActualText ()>> BDC (xy) Tj EMC (b) Tj ET", "ab"),
    (b"/Span <</ActualText (out)>> BDC (p) Tj /Span <</ActualText (in)>> BDC (q) Tj EMC (r) Tj EMC (d) Tj ET", "outd"),
    (b"/Span <</ActualText (one\\ntwo)>> BDC (x) Tj EMC ET", "one two"),
    (b"/Unknown 12 Tf (lost) Tj ET", None),
    (b"-30 Tc (ab) Tj ET", "a\nb"),
    (b"-5 Tc (abc) Tj 0 Tc ( d) Tj [( ) -900 (e)] TJ ET", "abc d e"),
    (b"(a\\255) Tj 40 0 Td (\\255b) Tj ET", "a- -b"),
    (b"[1] 12 Tf [1] gs [1] cs [1] Do /F1 12 Tf 3000000000 Tr (on) Tj ET", "on"),
    (b"(x) Tj ET BI /W 1 /H 1 /CS [/G] /BPC 8 ID x EI BT /F1 12 Tf 80 720 Td (y) Tj", "x y"),
]


def test_page_text(spark):
    assert texts(spark, [BEGIN + c for c, _ in CASES]) == [t for _, t in CASES]


def test_glyph_table(spark):
    glyphs = text.with_spaces(pdf.page_primitives(opened(spark, [ONE, pdf_writer.build([BEGIN + b"[(A) -500 (B)] TJ ET"])]), ("glyph",)))
    rows = sorted(glyphs.collect(), key=lambda r: (r["doc_id"], r["ord"]))
    assert [(r["text"], round(r["x"], 3), r["y"], round(r["advance"], 3), r["size"]) for r in rows[:2]] == [("H", 72, 720, 8.664, 12), ("i", 80.664, 720, 2.664, 12)]
    assert [(r["text"], r["is_generated_space"]) for r in rows[2:]] == [("A", False), (" ", True), ("B", False)]
    assert round(rows[3]["advance"], 3) == 6


def test_damage(spark):
    broken = [ONE.replace(b"startxref", b"startxxxx"), b"junk" + ONE, ONE.replace(b"/Length 33", b"/Length 3"), b"nothing", None, ONE.replace(b"3 0 R", b"9 0 R")]
    o = opened(spark, broken)
    docs = {r["doc_id"]: r for r in pdf.documents(o).collect()}
    assert docs[0]["recovered"] and docs[1]["header_offset"] == 4 and not docs[1]["recovered"]
    assert docs[3]["error_kind"] == "Parse" and docs[4]["error_kind"] == "Parse" and docs[3]["page_count"] is None
    found = {r["doc_id"]: r["text"] for r in text.page_text(pdf.page_primitives(o)).collect()}
    assert found == {0: "Hi", 1: "Hi", 2: "Hi"}
    with pytest.raises(Exception, match="no header"):
        opened(spark, [b"nothing"], mode="FAILFAST").collect()


def test_every_truncation_and_mutation_gives_rows(spark):
    """Through Spark: one row a file at least, whatever its bytes."""
    made = [ONE[:i] for i in range(len(ONE))] + [ONE[:i] + bytes([b]) + ONE[i + 1 :] for i in range(len(ONE)) for b in (0, 91, 47, 255)]
    o = opened(spark, made)
    assert pdf.documents(o).select("doc_id").distinct().count() == len(made)
    assert pdf.page_primitives(o, ("glyph", "run", "path", "image")).count() > len(made)


def test_hostile_files_give_rows(spark):
    """Empty code spaces, deep and self-containing forms, numbers beyond 32 bits, null and repeated ids."""
    font = "<< /Type /Font /Subtype /Type0 /BaseFont /F /Encoding 90 0 R /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 /BaseFont /F >>] >>"
    spaces = pdf_writer.file_of({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 /Rotate 90000000000000000000 >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", 4: pdf_writer.stream(BEGIN + b"(abc) Tj ET"), 5: font.encode(), 90: pdf_writer.stream(b"1 begincodespacerange <> <> endcodespacerange")})
    forms = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /XObject << /X 10 0 R >> >> >>", 4: pdf_writer.stream(b"0 0 1 1 re f /X Do")}
    for i in range(10, 1500):
        forms[i] = pdf_writer.stream(b"0 0 1 1 re f /X Do", f"/Subtype /Form /Resources << /XObject << /X {i + 1} 0 R >> >> ")
    images = pdf_writer.build([b"BI /W 99999999999 /H 1 /CS /G /BPC 8 ID x EI 1 0 0 1 99999999999999999999999999999999999999999999 0 cm 0 0 1 1 re f"])
    rows = [(None, bytearray(spaces)), (None, bytearray(pdf_writer.file_of(forms))), (7, bytearray(images)), (7, bytearray(ONE)), (7, bytearray(pdf_writer.build([BEGIN + b"(other) Tj ET"])))]
    o = pdf.open_documents(spark.createDataFrame(rows, "doc_id long, content binary"))
    assert [r["error_kind"] for r in pdf.documents(o).collect()] == [None] * 5
    found = pdf.page_primitives(o, ("glyph", "path", "image")).collect()
    assert sum(r["kind"] == "path" and r["doc_id"] is None for r in found) == 13  # the page and 12 levels of forms
    assert sorted(r["text"] for r in text.document_text(text.page_text(pdf.page_primitives(o, ("run",), pdf.RUN_COLUMNS))).where("doc_id = 7").collect()) == ["Hi", "other"]


def test_updates_streams_and_passwords(spark):
    page = lambda s: BEGIN + b"(" + s + b") Tj ET"
    made = [
        pdf_writer.build([page(b"old")], updates=[[page(b"mid")], [page(b"new")]]),
        pdf_writer.build([page(b"old")], updates=[[page(b"new")]], as_stream=True),
        pdf_writer.build([page(b"secret")], password=""),
        pdf_writer.build([page(b"secret")], password="pw", encoder="FlateDecode"),
    ]
    o = opened(spark, made)
    found = {r["doc_id"]: r["text"] for r in text.page_text(pdf.page_primitives(o)).collect()}
    assert found == {0: "new", 1: "new", 2: "secret"}
    kinds = {r["doc_id"]: (r["encrypted"], r["error_kind"]) for r in pdf.documents(o).collect()}
    assert kinds[2] == (True, None) and kinds[3] == (None, "Password")
    again = opened(spark, made[3:], password="pw")
    assert text.page_text(pdf.page_primitives(again)).first()["text"] == "secret"


def test_paths_images_and_boxes(spark):
    streams = [b"0 0 1 rg 10 20 100 50 re f", b"q 2 0 0 2 5 5 cm 0 0 10 10 re f Q 0 0 10 10 re S", b"0 1 1 0 k 0 0 m 10 0 l 5 5 l b", b"q 100 0 0 50 10 10 cm BI /W 2 /H 2 /CS /G /BPC 8 ID abcd EI Q", b"0 0 m 10 10 l n"]
    o = opened(spark, [pdf_writer.build([s], rotate=-90, box="0 500 300 0") for s in streams])
    rows = {}
    for r in pdf.page_primitives(o).orderBy("doc_id", "seq").collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert rows[0][0]["bbox"] == [10, 20, 110, 70] and rows[0][0]["fill"] == [0, 0, 1] and rows[0][0]["stroke"] is None
    assert [r["bbox"] for r in rows[1]] == [[5, 5, 25, 25], [0, 0, 10, 10]]
    assert rows[2][0]["fill"] == [1, 0, 0] and rows[2][0]["cmds"][-1]["op"] == "Z"
    assert rows[3][0]["bbox"] == [10, 10, 110, 60] and bytes(rows[3][0]["data"]) == b"abcd" and rows[3][0]["components"] == 1
    assert 4 not in rows
    box = pages.page_boxes(o).first()
    assert (box["rotation"], box["width"], box["height"]) == (270, 500, 300)
    assert pages.in_region(pdf.page_primitives(o), 0, 0, 8, 8).count() == 3


def test_forms_and_type3(spark):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R /T3 7 0 R >> /XObject << /X 6 0 R >> /ExtGState << /G << /ca 0.5 >> >> >> >>",
        4: pdf_writer.stream(b"/G gs 1 0 0 1 10 0 cm /X Do BT /T3 10 Tf 0 0 Td (a) Tj ET"), 5: pdf_writer.HELVETICA.encode(),
        6: pdf_writer.stream(b"0 0 5 5 re f /X Do", "/Subtype /Form /Matrix [2 0 0 2 0 0] "),
        7: b"<< /Type /Font /Subtype /Type3 /FontMatrix [0.001 0 0 0.001 0 0] /Encoding << /Differences [97 /sq] >> /CharProcs << /sq 8 0 R >> /FirstChar 97 /Widths [1000] >>", 8: pdf_writer.stream(b"0 0 1000 1000 re f"),
    }
    rows = pdf.page_primitives(opened(spark, [pdf_writer.file_of(objects)])).orderBy("seq").collect()
    assert [(r["kind"], r["bbox"]) for r in rows] == [("path", [10, 0, 20, 10]), ("glyph", None), ("path", [10, 0, 20, 10])]
    assert rows[0]["fill_alpha"] == 0.5 and rows[1]["flags"] == 4


def test_geometry(spark):
    m = g.concat(g.scaling(2, 2), g.translation(10, 0))
    row = spark.range(1).select(g.apply(m, F.lit(1.0), F.lit(1.0)).alias("p"), g.apply(g.invert(m), F.lit(12.0), F.lit(2.0)).alias("q"), g.invert(g.scaling(0, 1)).alias("none"), g.apply_rect(g.matrix(0, 1, -1, 0, 0, 0), g.rect(0, 0, 2, 1)).alias("r"), g.rotation(g.matrix(0, 1, -1, 0, 0, 0)).alias("t")).first()
    assert tuple(row["p"]) == (12, 2) and tuple(row["q"]) == (1, 1) and row["none"] is None and tuple(row["r"]) == (-1, 0, 0, 2) and math.isclose(row["t"], math.pi / 2)


def fold(rows):
    """The rules of text assembly as a plain loop over (own, span, span_text, x, y, end_x, end_y, size, rotation)."""
    out, trail, spaced, spans = [], None, False, set()
    for own, span, span_text, x, y, ex, ey, size, turn in rows:
        t = own if span is None else "" if span in spans else span_text
        spans.add(span)
        if t and trail and abs(y - trail[1]) <= 0.1 * trail[3] and trail[3] > 0 and x - trail[0] > 0.12 * trail[3] and not spaced and not t[0].isspace():
            out.append((" ", trail[0], trail[2], trail[3], turn))
        if span is not None:
            spaced = t[-1].isspace() if t else spaced
        else:
            spaced = not t or t.isspace()
        out.append((t, x, y, size, turn))
        trail = (ex, y, ey, size)
    made, prev = "", None
    for t, x, y, size, turn in out:
        if not t:
            continue
        if prev:
            most = max(prev[2], size)
            dx, dy, c, s = x - prev[0], y - prev[1], math.cos(prev[3]), math.sin(prev[3])
            if most > 0 and (abs(turn - prev[3]) > 0.01 or abs(dy * c - dx * s) > 0.55 * most or dx * c + dy * s < -most):
                made += "\n"
        made, prev = made + t, (x, y, size, turn)
    return made


def test_windows_against_a_fold(spark):
    rnd, rows, wanted = random.Random(5), [], {}
    for page in range(150):
        x, y, span, one = 72.0, 700.0, 0, []
        for seq in range(rnd.randint(1, 30)):
            step = rnd.choice([0, 0, 0, 0.31, 3.3, -40])
            x, y = x + step, y - rnd.choice([0, 0, 0, 0, 0.37, 5.3, 14])
            size, turn = rnd.choice([10.0, 10.0, 7.0]), rnd.choice([0.0] * 9 + [1.5])
            own = rnd.choice(["a", "b", "", " ", "xy", "　", "c"])
            inside = rnd.random() < 0.3
            span += not inside
            st = ["", " ", "rep", "end "][span % 4] if inside else None
            adv = size * 0.5
            one.append((own, span if inside else None, st, x, y, x + adv, y, size, turn))
            rows.append((page, 0, seq * 2 + 1, *one[-1]))
            x += adv
        wanted[page] = fold(one)
    df = spark.createDataFrame(rows, "doc_id long, page_index int, seq int, own_text string, span int, span_text string, x double, y double, end_x double, end_y double, size double, rotation double")
    found = {r["doc_id"]: r["text"] for r in text.page_text(df).collect()}
    assert {k: v for k, v in wanted.items() if v} == found


def test_reports(spark):
    rows = [("F", "a", 1, 7, False), ("F", "", 2, 7, False), ("F", "", 1, 7, False), ("F", " ", 9, 7, True), ("G", "b", 3, 0, False)]
    df = spark.createDataFrame(rows, "base_font string, text string, code long, flags int, is_generated_space boolean")
    found = {r["base_font"]: (r["total"], r["unmapped"], r["codes"], r["pct"], r["marked"]) for r in reports.font_coverage(df).collect()}
    assert found == {"F": (3, 2, [1, 2], 66.667, True), "G": (1, 0, [], 0.0, False), None: (4, 2, [1, 2], 50.0, True)}
    words = " ".join(f"w{i}" for i in range(60))
    pairs = [(1, words, words), (2, "ﬁnd it", words), (3, "x", "few words"), (4, words.replace("w30", "q"), words)]
    got = {r["id"]: (r["verdict"], r["bigram_recall"]) for r in reports.agreement(spark.createDataFrame(pairs, "id long, ours string, reference string")).collect()}
    assert got[1] == ("ok", 1.0) and got[2][0] == "DIVERGENT" and got[3][0] is None and got[4] == ("ok", round(57 / 59, 4))
