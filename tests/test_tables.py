"""The inside of files as tables, against files of known structure and against the reader of single files."""

import random

import pytest
from pyspark.sql import functions as F

from folioquery.functions import lexemes
from folioquery.functions.cos import Ref
from folioquery.sources import pdf_tables
from folioquery.sources.pdf_file import ParseError, PdfFile
from folioquery.sources.pdf_writer import build, file_of, packed_file, stream

SHOW = b"BT /F1 10 Tf 72 700 Td (a) Tj ET"


class Read:
    """Rows of all tables, of files put in by name."""

    def __init__(self, spark, contents):
        self.at = {name: i for i, name in enumerate(contents)}
        rows = [(i, c, "x") for i, c in enumerate(contents.values())]
        found = pdf_tables.inside(spark.createDataFrame(rows, "doc_row long, content binary, body string").repartition(3))
        self.refs = {(r["doc_row"], r["num"]): r for r in found.xref.collect()}
        self.heads = {r["doc_row"]: r for r in found.heads.collect()}
        self.bodies = {(r["doc_row"], r["num"]): r["text"] for r in found.resolved().withColumn("text", F.col("body").cast("string")).collect()}
        self.pages = {i: [] for i in range(len(rows))}
        for r in found.pages().orderBy("page_index").collect():
            self.pages[r["doc_row"]].append(r)
        assert all([p["page_index"] for p in ps] == list(range(len(ps))) for ps in self.pages.values())


def in_turn(content):
    """Boxes and turns that the reader of single files finds."""
    try:
        return [(p["media"], p["crop"], p["rotate"]) for p in PdfFile(content or b"").pages()]
    except (ParseError, ValueError, TypeError, AttributeError, KeyError, IndexError):
        return []


def section(at, prev=None, extra="", entries=()):
    rows = b"".join(b"%d 1\n%010d 00000 n \n" % e for e in entries)
    return b"xref\n" + rows + b"trailer\n<< /Root 1 0 R %s %s >>\n" % (b"" if prev is None else b"/Prev %010d" % prev, extra.encode())


HEAD = b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog >>\nendobj\n2 0 obj\n5\nendobj\n"
FIRST, SECOND, ONE = HEAD.index(b"1 0"), HEAD.index(b"2 0"), len(HEAD)


def chains():
    """Sections that name each other in a circle, themselves, a place outside, none, and a stream beside a table."""

    def whole(body, start=ONE):
        return HEAD + body + b"startxref\n%d\n%%%%EOF" % start

    entries = ((1, FIRST), (2, SECOND))
    size = len(section(ONE, ONE, "", ((1, FIRST),)))
    table = b"xref\n1 1\n%010d 00000 n \ntrailer\n<< /Root 1 0 R /XRefStm %010d >>\n"
    rows = b"\x01\0" + bytes([SECOND]) + b"\0" + b"\x01\0\x03\0"
    packed = b"7 0 obj\n" + stream(rows, "/Type /XRef /W [1 2 1] /Index [2 1 1 1] /Root 1 0 R ") + b"\nendobj\n"
    return {
        "circle": whole(section(ONE, ONE + size, "", ((1, FIRST),)) + section(ONE + size, ONE, "", ((2, SECOND), (1, 3)))),
        "itself": whole(section(ONE, ONE, "", entries)), "outside": whole(section(ONE, 99999, "", entries)), "nowhere": whole(section(ONE, 12, "", entries)),
        "hybrid": whole(table % (FIRST, ONE + len(table % (FIRST, 0))) + packed),
        "updates": build([SHOW], updates=[[b"%d" % i] for i in range(30)]),
    }


REFERENCES = {1: b"<< /Type /Catalog >>"} | {10 + i: b"%d 0 R" % (11 + i) for i in range(40)} | {50: b"(end)", 60: b"60 0 R", 61: b"62 0 R", 62: b"61 0 R", 63: b"99 0 R", 64: b"/Name", 65: b"null"}


def trees():
    ways = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    for i in range(40):
        kids = b"[%d 0 R %d 0 R %d 0 R]" % (2 * i + 4, 2 * i + 5, 2 * i + 4)
        ways |= {2 * i + 2: b"<< /Kids %s >>" % kids, 2 * i + 3: b"<< /Kids %s >>" % kids}
    ways |= {82: b"<< /Type /Page >>", 83: b"<< /Type /Page >>"}
    cyclic = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 2 0 R] >>", 3: b"<< /Type /Pages /Kids [2 0 R] >>"}
    lone = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages >>"}
    inherit = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 2 0 R << /Type /Page /Rotate 90 >> 9 0 R << /Kids [<< /Rotate -90 >>] >>] /MediaBox 8 0 R /Rotate 450 /Resources << /A 1 >> >>", 3: b"<< /Kids [4 0 R 4 0 R 5 0 R] /CropBox [30 40 1 2] >>", 4: b"<< /Type /Page >>", 5: b"6 0 R", 6: b"7 0 R", 7: b"<< /Type /Page /MediaBox [10 10 0 0] /Rotate (x) >>", 8: b"[0 0 5 9]"}
    deep = {1: b"<< /Type /Catalog /Pages 2 0 R >>"} | {k: v for i in range(70) for k, v in ((2 * i + 2, b"<< /Kids [%d 0 R %d 0 R] >>" % (2 * i + 3, 2 * i + 4)), (2 * i + 3, b"<< /Type /Page >>"))}
    return {"deep": file_of(deep), "ways": file_of(ways), "cyclic": file_of(cyclic), "lone": file_of(lone), "empty": b"", "junk": b"junk", "null": None, "inherit": file_of(inherit), "packed": packed_file(inherit, {2, 3, 4, 8}), "shifted": b"junk before\n" + file_of(inherit)}


def damaged():
    rnd = random.Random(7)
    sound = [build([SHOW, SHOW], updates=[[b"x"], [None, b"y"]]), build([SHOW], as_stream=True, updates=[[b"z"]]), build([SHOW], broken=True)]
    sound.append(packed_file({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /MediaBox [0 0 9 9] >>", 3: b"<< /Type /Page >>", 4: b"<< /Type /Page /Rotate 90 >>"}, {2, 3, 4}))
    out = list(sound)
    for s in sound:
        out += [s[: rnd.randrange(len(s))] for _ in range(12)]
        for _ in range(25):
            b = bytearray(s)
            for _ in range(rnd.randrange(1, 4)):
                b[rnd.randrange(len(b))] = rnd.choice(b"\0[/\xff0 9<>R")
            out.append(bytes(b))
    return {f"damaged{i}": c for i, c in enumerate(out)}


CONTENTS = {**chains(), "references": file_of(REFERENCES), "references2": packed_file(REFERENCES, set(REFERENCES) - {10, 11}), **trees(), **damaged()}


@pytest.fixture(scope="module")
def found(spark):
    return Read(spark, CONTENTS)


def test_chains(found):
    names = ("circle", "itself", "outside", "nowhere", "hybrid")
    at = [found.at[n] for n in names]
    assert [found.heads[i]["recovered"] for i in at] == [False, False, False, True, False]
    assert all((found.refs[i, 1]["offset"], found.refs[i, 2]["offset"]) == (FIRST, SECOND) for i in at)
    assert [(found.refs[i, 1]["section"], found.refs[i, 2]["section"]) for i in at] == [(0, 1), (0, 0), (0, 0), (None, None), (0, 0)]


def test_the_newest_of_many_updates_wins(found):
    i = found.at["updates"]
    assert found.refs[i, 5]["section"] == 0 and found.refs[i, 4]["section"] == 30


def test_references(found):
    """0 to 40 steps, circles of one and two, and nothing at the end."""
    pdf = PdfFile(CONTENTS["references"])
    for row in (found.at["references"], found.at["references2"]):
        for num in range(10, 51):
            want = pdf.resolve(Ref(num, 0))
            assert found.bodies[row, num] == (None if want is None else f"({want.hex()}"), num
        assert found.bodies[row, 17] is None and found.bodies[row, 18] == "(656e64"
        assert [found.bodies[row, n] for n in (60, 61, 62, 63, 64, 65)] == [None, None, None, None, "/Name", None]


def test_a_page_tree_of_many_ways(found):
    """Each level names the next one twice, in two nodes: 2^40 ways lead down."""
    assert [(r["num"], r["truncated"]) for r in found.pages[found.at["ways"]]] == [(82, True), (83, True)]


def test_what_is_too_deep_is_left_out(found):
    pages = found.pages[found.at["deep"]]
    assert [(r["num"], r["truncated"]) for r in pages] == [(2 * i + 3, True) for i in range(64)] and len(in_turn(CONTENTS["deep"])) == 64


def test_trees_without_pages(found):
    for name in ("cyclic", "lone", "empty", "junk", "null"):
        assert found.pages[found.at[name]] == [] == in_turn(CONTENTS[name])


def test_inherited_values(found):
    for name in ("inherit", "packed", "shifted"):
        pages = found.pages[found.at[name]]
        direct = [(False, [0, 0, 5, 9], None, 90), (False, [0, 0, 5, 9], None, 270)]  # twice, as the reference to the root is followed once
        assert [(r["num"] > 0, r["media"], r["crop"], r["rotate"]) for r in pages] == [(True, [0, 0, 5, 9], [1, 2, 30, 40], 90), (True, [0, 0, 10, 10], [1, 2, 30, 40], 90), *direct, *direct]
        assert in_turn(CONTENTS[name]) == [(r["media"], r["crop"], r["rotate"]) for r in pages]


def test_damaged_files_as_the_single_reader_has_them(found):
    differ = []
    for name in damaged():
        got = [(r["media"], r["crop"], r["rotate"]) for r in found.pages[found.at[name]]]
        if in_turn(CONTENTS[name]) != got:
            differ.append((name, in_turn(CONTENTS[name]), got))
    assert not differ, (len(differ), differ[:3])


def test_nothing(spark):
    none = Read(spark, {})
    assert not none.refs and not none.heads and not none.bodies


@pytest.mark.parametrize(("data", "want"), [(b"", None), (b"%PDF-1", 0), (b"ab%PDF-1 startxref 0", 2)])
def test_file_tokens(data, want):
    first = next(lexemes.tokens(data))
    assert first[0] == "file" and first[4] == want and first[5] == len(data)
