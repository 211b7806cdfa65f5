"""Images by content: equal ones are decoded once, failures are rows."""

import zlib

from folioquery.sources import pdf_images
from folioquery.sources.pdf_tables import inside
from folioquery.sources.pdf_writer import file_of, stream


def image(data, entries=""):
    return stream(data, f"/Type /XObject /Subtype /Image /Width 2 /Height 2 {entries} ")


def test_images(spark):
    logo, flate = image(b"logo"), zlib.compress(b"pixels")
    root = {1: b"<< /Type /Catalog >>"}
    contents = [
        file_of(root | {2: logo, 3: image(flate, "/Filter /FlateDecode"), 4: stream(b"logo", "/Subtype /Form ")}),
        b"junk" + file_of(root | {2: logo, 7: logo, 8: image(b"JPEG", "/Filter /DCTDecode")}),
        file_of(root | {2: image(b"broken", "/Filter /FlateDecode"), 3: image(b"x", "/Filter 9 0 R"), 5: image(b"y", "/Filter /Unheard")}),
        file_of(root | {2: image(b"old")}, updates=[{2: image(b"new")}]),
        None,
        b"junk",
    ]
    files = spark.createDataFrame(list(enumerate(contents)), "doc_row long, content binary").repartition(3)
    objects = inside(files).objects
    found = {(r["doc_row"], r["num"]): r for r in pdf_images.image_contents(files, objects).collect()}
    assert {k: (r["data"] and bytes(r["data"]), r["codec"]) for k, r in found.items() if r["error"] is None and k != (2, 2)} == {
        (0, 2): (b"logo", None), (0, 3): (b"pixels", None), (1, 2): (b"logo", None), (1, 7): (b"logo", None), (1, 8): (b"JPEG", "DCTDecode"), (3, 2): (b"new", None),
    }
    assert (2, 2) in found  # of broken data what can be read
    assert found[2, 3]["error"] == "its filters are references" and "Unheard" in found[2, 5]["error"]
    assert len({bytes(found[k]["digest"]) for k in ((0, 2), (1, 2), (1, 7))}) == 1
    held = pdf_images.held_images(files, objects)
    assert pdf_images.decoded_streams(files, held).count() == len({bytes(r["digest"]) for r in held.collect()}) == 7
    some = pdf_images.image_contents(files, objects, spark.createDataFrame([(1, 8), (1, 8), (0, 4), (9, 9)], "doc_row long, num long"))
    assert [(r["doc_row"], r["num"]) for r in some.collect()] == [(1, 8)]
