"""PDF files from rows: content streams are Column expressions, and a small Arrow stage frames them as
files. Used to hand extracted tables on as PDFs, and to test the readers against known contents."""

from __future__ import annotations

import base64
import functools
import hashlib
import zlib

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.crypt import _PAD, rc4

LATIN = "ISO-8859-1"


#: Characters that the one-byte font F1 hasn't; lines with such are written in F2, by code points.
WIDE = r"[^\u0020-\u007E\u00A1-\u00FF]"


def shown(line: Column, size: int = 10, wide: Column | None = None) -> Column:
    """The operators that show one line; `wide`: whether by code points, else where it must be."""
    wide = line.rlike(WIDE) if wide is None else wide
    narrow = F.concat(F.lit("<"), F.hex(F.encode(F.when(wide, "").otherwise(line), LATIN)), F.lit("> Tj"))
    return F.when(wide, F.concat(F.lit(f"/F2 {size} Tf <"), F.hex(F.encode(line, "UTF-32")), F.lit(f"> Tj /F1 {size} Tf"))).otherwise(narrow)


def show_lines(lines: Column, size: int = 10, leading: int = 14, x: int = 72, y: int = 742, wide: Column | None = None) -> Column:
    """The content stream of an array of lines, one below the other, as text."""
    body = F.transform(lines, lambda s: F.concat(shown(s, size, wide), F.lit(f" 0 -{leading} Td\n")))
    return F.concat(F.lit(f"BT /F1 {size} Tf {x} {y} Td\n"), F.array_join(body, ""), F.lit("ET"))


def in_pages(lines: Column, per_page: int = 50) -> Column:
    """An array of lines -> an array of arrays."""
    last = F.ceil(F.size(lines) / per_page).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(lines, i * per_page + 1, per_page))


def _run_length(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"


def _lzw(data: bytes) -> bytes:
    """Cleared before its codes outgrow nine bits."""
    bits = []
    for i in range(0, len(data), 200):
        bits += [256, *data[i : i + 200]]
    text = "".join(f"{b:09b}" for b in [*bits, 257])
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big")


ENCODERS = {
    "": lambda d: d,
    "FlateDecode": zlib.compress,
    "ASCII85Decode": lambda d: base64.a85encode(d) + b"~>",
    "ASCIIHexDecode": lambda d: d.hex().encode() + b">",
    "RunLengthDecode": _run_length,
    "LZWDecode": _lzw,
}
HELVETICA = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


def stream(data: bytes, entries: str = "") -> bytes:
    return f"<< /Length {len(data)} {entries}>>\nstream\n".encode() + data + b"\nendstream"


def file_of(objects: dict[int, bytes], trailer: str = "/Root 1 0 R", start: int | None = None, updates: list[dict[int, bytes]] = (), as_stream: bool = False) -> bytes:
    """A file of numbered objects, with incremental updates; `start` overrides the last startxref."""
    out, prev = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), None
    for part in (objects, *updates):
        offsets = {}
        for num, body in part.items():
            offsets[num] = len(out)
            out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
        at, size = len(out), max(objects) + 2
        before = f"/Prev {prev} " if prev is not None else ""
        if as_stream:
            rows = b"".join(b"\x01" + offsets[n].to_bytes(4, "big") + b"\0" for n in sorted(offsets))
            index = " ".join(f"{n} 1" for n in sorted(offsets))
            out += b"%d 0 obj\n" % (size + 7) + stream(zlib.compress(rows), f"/Type /XRef /W [1 4 1] /Index [{index}] /Size {size + 8} /Filter /FlateDecode {before}{trailer} ") + b"\nendobj\n"
        else:
            out += b"xref\n0 1\n0000000000 65535 f \n" + b"".join(b"%d 1\n%010d 00000 n \n" % (n, o) for n, o in sorted(offsets.items()))
            out += f"trailer\n<< /Size {size} {before}{trailer} >>\n".encode()
        prev = at
        out += b"startxref\n%d\n%%%%EOF\n" % (at if start is None else start)
    return bytes(out)


def packed_file(objects: dict[int, bytes], packed: set[int], root: int = 1) -> bytes:
    """A file with a cross reference stream, the objects in `packed` inside an object stream."""
    out, entries = bytearray(b"%PDF-1.7\n"), {}
    holder = max(objects) + 1
    names, bodies = b"", b""
    for i, num in enumerate(sorted(packed & set(objects))):
        names += b"%d %d " % (num, len(bodies))
        bodies += objects[num] + b" "
        entries[num] = b"\x02" + holder.to_bytes(4, "big") + i.to_bytes(2, "big")
    held = stream(zlib.compress(names + bodies), f"/Type /ObjStm /N {len(entries)} /First {len(names)} /Filter /FlateDecode ")
    for num, body in [*[(n, b) for n, b in objects.items() if n not in packed], (holder, held)]:
        entries[num] = b"\x01" + len(out).to_bytes(4, "big") + bytes(2)
        out += b"%d 0 obj\n" % num + body + b"\nendobj\n"
    at, rows = len(out), b"".join(entries[n] for n in sorted(entries))
    index = " ".join(f"{n} 1" for n in sorted(entries))
    out += b"%d 0 obj\n" % (holder + 1) + stream(zlib.compress(rows), f"/Type /XRef /W [1 4 2] /Index [{index}] /Size {holder + 2} /Root {root} 0 R /Filter /FlateDecode ") + b"\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % at)


def write_files(df: DataFrame, folder: str) -> int:
    """Writes content of df (name, content) as files of these names into a folder that all machines share; how many."""

    def run(batches):
        for batch in batches:
            fs, root = pa_fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pa_fs.LocalFileSystem(), folder)
            fs.create_dir(root, recursive=True)
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with fs.open_output_stream(f"{root}/{name}") as f:
                    f.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return df.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def object_files(df: DataFrame) -> DataFrame:
    """df: doc_id, objects (array of num and body) and packed, whether all go into an object stream: doc_id and content. Object 1 is the
    catalog."""

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                objects = {x["num"]: x["body"].encode("latin-1") for x in row["objects"]}
                out.append(packed_file(objects, set(objects)) if row["packed"] else file_of(objects))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "content"])

    return df.select("doc_id", "objects", "packed").mapInArrow(run, "doc_id long, content binary")


@functools.cache
def _wide_maps() -> tuple[bytes, bytes]:
    """Code spaces, and characters by code, of a font whose codes are code points in four bytes; both compressed."""
    space = b"1 begincodespacerange <00000000> <0010FFFF> endcodespacerange\n"
    ranges = [b"<00000000> <0000FFFF> <0000>"] + [b"<%08X> <%08X> <%04XDC00>" % (0x10000 + i * 0x400, 0x103FF + i * 0x400, 0xD800 + i) for i in range(0x400)]
    unicode_map = space + b"\n".join(b"%d beginbfrange\n%b\nendbfrange" % (len(ranges[i : i + 100]), b"\n".join(ranges[i : i + 100])) for i in range(0, len(ranges), 100))
    return zlib.compress(space), zlib.compress(unicode_map)


def _wide_font(num: int) -> tuple[dict[int, bytes], dict[int, bytes]]:
    """Objects and streams, from `num` on, of such a font."""
    space, unicode_map = _wide_maps()
    font = b"<< /Type /Font /Subtype /Type0 /BaseFont /Wide /Encoding %d 0 R /ToUnicode %d 0 R /DescendantFonts [<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Wide /DW 500 >>] >>" % (num + 1, num + 2)
    return {num: font}, {num + 1: space, num + 2: unicode_map}


def build(pages: list[bytes], font: str = HELVETICA, box: str = "0 0 612 792", rotate: int = 0, encoder: str = "", resources: str = "", crop: str = "", broken: bool = False, as_stream: bool = False, updates: list[list[bytes]] = (), password: str | None = None) -> bytes:
    """Objects 1 catalog, 2 page tree, 3 font, then a page and its content in turn."""
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    filters = f"/Filter /{encoder} " if encoder else ""
    streams = {5 + 2 * i: (ENCODERS[encoder](p), filters) for i, p in enumerate(pages)}
    fonts, crop = "/F1 3 0 R", f"/CropBox [{crop}] " if crop else ""
    wide: dict[int, bytes] = {}
    if any(b"/F2 " in p for p in pages) or any(b"/F2 " in p for u in updates for p in u if p is not None):
        num = 4 + 2 * len(pages)
        wide, maps = _wide_font(num)
        streams |= {n: (d, "/Filter /FlateDecode ") for n, d in maps.items()}
        fonts += f" /F2 {num} 0 R"
    objects = wide | {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} /MediaBox [{box}] {crop}/Rotate {rotate} /Resources << /Font << {fonts} >> {resources} >> >>".encode(), 3: font.encode()}
    objects |= {4 + 2 * i: f"<< /Type /Page /Parent 2 0 R /Contents {5 + 2 * i} 0 R >>".encode() for i in range(len(pages))}
    objects |= {n: stream(d, e) for n, (d, e) in streams.items()}
    later = [{5 + 2 * i: stream(ENCODERS[encoder](p), filters) for i, p in enumerate(u) if p is not None} for u in updates]
    trailer = "/Root 1 0 R"
    if password is not None:  # revision 3 of the standard handler, 128 bits, same user and owner password
        ident, perms = hashlib.md5(password.encode()).digest(), (0xFFFFFFFC).to_bytes(4, "little")
        padded = (password.encode("latin-1") + _PAD)[:32]

        def turned(key, data):
            for i in range(20):
                data = rc4(bytes(b ^ i for b in key), data)
            return data

        def many(data, n):
            for _ in range(n):
                data = hashlib.md5(data).digest()
            return data

        owner = turned(many(padded, 51), padded)
        key = many(padded + owner + perms + ident, 51)
        user = turned(key, hashlib.md5(_PAD + ident).digest()) + bytes(16)
        for num, (data, entries) in streams.items():
            objects[num] = stream(rc4(hashlib.md5(key + num.to_bytes(3, "little") + b"\0\0").digest(), data), entries)
        objects[max(objects) + 1] = f"<< /Filter /Standard /V 2 /R 3 /Length 128 /P -4 /O <{owner.hex()}> /U <{user.hex()}> >>".encode()
        trailer += f" /Encrypt {max(objects)} 0 R /ID [<{ident.hex()}> <{ident.hex()}>]"
    return file_of(objects, trailer, 3 if broken else None, later, as_stream)


def files(df: DataFrame, **fixed) -> DataFrame:
    """df: doc_id, pages (array<string> or array<binary>), and any of build's options as columns, or
    as `fixed` for all rows. Returns doc_id and content, and password if that is a column."""
    options = [c for c in df.columns if c not in ("doc_id", "pages")]
    secret = "password" in options

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pages = [p.encode("latin-1", "replace") if isinstance(p, str) else p for p in row["pages"] or []]
                given = {k: row[k] for k in options if row[k] is not None}
                if "updates" in given:
                    given["updates"] = [[p.encode("latin-1", "replace") if isinstance(p, str) else p for p in u] for u in given["updates"]]
                out.append(build(pages, **fixed, **given))
            columns = [batch.column("doc_id"), pa.array(out, pa.binary()), *([batch.column("password")] if secret else [])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "content", *["password"] * secret])

    return df.mapInArrow(run, "doc_id long, content binary" + ", password string" * secret)
