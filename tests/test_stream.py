from folioquery.sources import pdf, pdf_writer
from folioquery.streaming.pdf_stream import stream_files, write_page_texts


def test_image_objects(spark):
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /XObject << /I 5 0 R /J 6 0 R >> >> >>",
        4: pdf_writer.stream(b"/I Do /J Do"), 5: pdf_writer.stream(b"ab", "/Subtype /Image /Width 2 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8 "), 6: pdf_writer.stream(b"jpg", "/Subtype /Image /Width 2 /Height 1 /Filter /DCTDecode "),
    }
    files = spark.createDataFrame([(1, bytearray(pdf_writer.file_of(objects)))], "doc_id long, content binary")
    o = pdf.open_documents(files)
    images = pdf.page_primitives(o, ("image",))
    assert sorted((r["obj_num"], bytes(r["data"]), r["codec"]) for r in pdf.image_data(files, images).collect()) == [(5, b"ab", None), (6, b"jpg", "DCTDecode")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.pdf").write_bytes(pdf_writer.build([b"BT /F1 12 Tf 72 720 Td (page %d) Tj ET" % i]))
    query = write_page_texts(stream_files(spark, f"file://{tmp_path}/in", 2), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    query.awaitTermination(120)
    assert sorted(r["text"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == ["page 0", "page 1", "page 2"]
