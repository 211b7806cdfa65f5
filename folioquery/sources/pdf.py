"""PDF bytes as DataFrames.

`open_documents` turns rows of bytes into one row a document and one a page; `page_primitives` turns
page rows into one row a glyph, path or image. Both are narrow Arrow stages: pages of a large file can
be dealt out between them (`spread`), so that one file doesn't hold one task. What looks at more than
one primitive is in `operators`, as windows and joins.

Damaged files give rows with an error, never a failed job; with mode="FAILFAST" they raise. Of a page
whose content breaks off, what was read until there counts. `truncated` says that a file's page tree went
beyond the limits. Null content reads as an empty file; each row is a file of its own, told apart by
`doc_row` whatever its doc_id, which may be null or repeated; an empty table gives no rows.
"""

from __future__ import annotations

import contextlib
import io
import pickle
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cos import Ref, Stream
from ..functions.crypt import PasswordError, UnsupportedEncryption
from ..functions.filters import FilterError, decode
from ..functions.fonts import load
from ..functions.page_ops import FORM_DEPTH, IDENTITY, Page, components
from .pdf_file import ParseError, PdfFile

OPENED = "doc_row long, doc_id long, page_index int, length long, header_offset long, recovered boolean, encrypted boolean, page_count int, truncated boolean, error_kind string, error_message string, media array<double>, crop array<double>, rotate int, content binary, resources binary"
PRIMITIVES = (
    "doc_row long, doc_id long, page_index int, kind string, seq int, own_text string, span int, span_text string, x double, y double, end_x double, end_y double, size double, rotation double, advance double, mode int, code long, font_name string, base_font string, flags int, "
    "fill array<double>, fill_alpha double, stroke array<double>, stroke_alpha double, line_width double, even_odd boolean, cmds array<struct<op:string,pts:array<double>>>, bbox array<double>, "
    "name string, ctm array<double>, width int, height int, is_mask boolean, bpc int, components int, obj_num long, data binary, codec string, "
    "tx double, ty double, lx double, ly double, ey double, last_text string, starts boolean, n int"
)
#: What damaged content may raise below: a file or a page of such is a row, or what was read before it.
DAMAGE = (ValueError, TypeError, KeyError, IndexError, AttributeError, ArithmeticError, RecursionError)
_KINDS = {PasswordError: "Password", UnsupportedEncryption: "UnsupportedEncryption", ParseError: "Parse"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, content) of PDF files."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")


def _closure(pdf: PdfFile, res: dict, done: dict) -> dict:
    """What a page needs of its resources, resolved; shared and self-containing forms appear once.
    Forms are taken level by level, so nesting may be of any depth; below FORM_DEPTH none is run."""
    if id(res) in done:
        return done[id(res)]
    top: dict = {}
    done[id(res)] = top
    level, depth = [(res, top)], 0
    while level and depth <= FORM_DEPTH:
        below: list[tuple[dict, dict]] = []
        for source, out in level:
            _fill(pdf, source, out, done, below)
        level, depth = below, depth + 1
    return top


def _fill(pdf: PdfFile, res: dict, out: dict, done: dict, below: list) -> None:
    get = lambda d, k: pdf.resolve(d.get(k)) if isinstance(d, dict) else None
    entries = lambda kind: (get(res, kind) or {}).items() if isinstance(get(res, kind), dict) else ()
    out["fonts"] = {}
    for k, v in entries("Font"):
        key = v if isinstance(v, Ref) else id(v)
        if key not in done and isinstance(pdf.resolve(v), dict):
            done[key] = _font(pdf, v)
        if key in done:
            out["fonts"][k] = done[key]
    out["cs"] = {k: components(v, pdf.resolve) for k, v in entries("ColorSpace")}
    out["props"] = {k: get(pdf.resolve(v), "ActualText") for k, v in entries("Properties")}
    out["gs"] = {}
    for k, v in entries("ExtGState"):
        d = pdf.resolve(v)
        g = {n: float(x) if n == "LW" else min(1.0, max(0.0, float(x))) for n in ("LW", "ca", "CA") if isinstance(x := get(d, n), (int, float))}
        font = get(d, "Font")
        if isinstance(font, list) and len(font) > 1 and isinstance(pdf.resolve(font[1]), (int, float)):
            g["size"] = float(pdf.resolve(font[1]))
        out["gs"][k] = g
    out["objects"] = {}
    for k, v in entries("XObject"):
        s = pdf.resolve(v)
        if not isinstance(s, Stream):
            continue
        num = v.num if isinstance(v, Ref) else None
        if get(s.dict, "Subtype") == "Image":
            d = {n: get(s.dict, n) for n in ("Width", "Height", "BitsPerComponent", "ImageMask")} | {"_n": components(s.dict.get("ColorSpace"), pdf.resolve)}
            out["objects"][k] = {"kind": "image", "stream": Stream(d, b""), "num": num if num is not None else -1}
        elif get(s.dict, "Subtype") == "Form":
            if (num, "form") not in done:
                m = [pdf.resolve(x) for x in get(s.dict, "Matrix") or []]
                done[num, "form"] = form = {"kind": "form", "open": False, "content": pdf.bytes_of(s), "matrix": tuple(map(float, m)) if len(m) == 6 and all(isinstance(x, (int, float)) for x in m) else IDENTITY, "resources": None}
                own = get(s.dict, "Resources")
                if isinstance(own, dict):
                    if id(own) not in done:
                        done[id(own)] = {}
                        below.append((own, done[id(own)]))
                    form["resources"] = done[id(own)]
            out["objects"][k] = done[num, "form"]


#: Fonts by all that is written of them, as the files of one writer share most of theirs: how many, of how many bytes, codes and objects.
_FONTS: dict[tuple, dict] = {}
FONTS, FONT_SIZE = 64, 1 << 16


def _written(pdf: PdfFile, obj) -> tuple | None:
    """All that an object leads to, as a tuple that is equal for equal objects only; null where there is more than FONT_SIZE of it."""
    seen: dict[int, int] = {}
    out, size, stack = [], 0, [obj]
    while stack:
        x = stack.pop()
        if isinstance(x, Ref):
            out.append(("R", seen.get(x.num)))
            if x.num not in seen:
                seen[x.num] = len(seen)
                stack.append(pdf.get(x.num))
        elif isinstance(x, Stream):
            out.append(("S", x.raw))
            size += len(x.raw)
            stack.append(x.dict)
        elif isinstance(x, dict):
            out.append(("D", len(x)))
            stack += [v for pair in x.items() for v in pair]
        elif isinstance(x, list):
            out.append(("L", len(x)))
            stack += x
        else:
            out.append((type(x).__name__, repr(x)))
            size += len(x) if isinstance(x, (str, bytes)) else 0
        size += 8
        if size > FONT_SIZE:
            return None
    return tuple(out)


def _font(pdf: PdfFile, v) -> dict:
    """`load`, of equal fonts once."""
    key = _written(pdf, v)
    if key in _FONTS:
        return _FONTS[key]
    font = load(pdf, pdf.resolve(v))
    maps = [m for m in (font.get("cmap"), font.get("unicode")) if m]
    if key is not None and len(font["widths"]) + sum(len(t) for m in maps for t in (m.texts, m.text_ranges, m.cids, m.cid_ranges)) + sum(map(len, font["procs"].values())) <= FONT_SIZE // 8:
        if len(_FONTS) >= FONTS:
            _FONTS.clear()
        _FONTS[key] = font
    return font


class _Resources(pickle.Unpickler):
    """Reads back what _closure made: plain values and the four kinds of object it holds, nothing else."""

    KNOWN = {("folioquery.functions.cos", n) for n in ("Name", "Ref", "Stream", "Keyword")} | {("folioquery.functions.fonts", "CMap")}

    def find_class(self, module: str, name: str):
        if (module, name) in self.KNOWN or module.split(".")[0] == "numpy" and name in ("_reconstruct", "ndarray", "dtype", "_frombuffer"):
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} isn't part of a page's resources")


def _read(data: bytes, password: str | None) -> tuple[PdfFile, list[tuple[dict, dict]]]:
    """An open file, and its pages with what each needs of its resources."""
    pdf, done = PdfFile(data, password), {}
    return pdf, [(p, _closure(pdf, p["resources"], done)) for p in pdf.pages()]


def _open(data: bytes, password: str | None, failfast: bool) -> list[dict]:
    row = {"length": len(data), "error_kind": None, "error_message": None}
    try:
        pdf, pages = _read(data, password)
        doc = row | {"header_offset": pdf.header_offset, "recovered": pdf.recovered, "encrypted": pdf.decryptor is not None, "page_count": len(pages), "truncated": pdf.truncated}
        rows = [doc]
        for i, (p, given) in enumerate(pages):
            rows.append({"page_index": i, "media": p["media"], "crop": p["crop"], "rotate": p["rotate"], "content": p["content"], "resources": pickle.dumps(given)})
        return rows
    except (PasswordError, UnsupportedEncryption, ParseError, *DAMAGE) as e:
        if failfast:
            raise
        return [row | {"error_kind": _KINDS.get(type(e), "Parse"), "error_message": f"{e}"}]


def open_documents(files: DataFrame, password: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """files: doc_id, content and perhaps password. One row a document (page_index null) and a page.
    `doc_row` tells rows apart where doc_ids repeat or are null; files may bring a column of that name,
    which is better where the result is read more than once without being stored."""
    if "doc_row" not in files.columns:
        files = files.withColumn("doc_row", F.monotonically_increasing_id())
    has = "password" in files.columns
    names = [x.split()[0] for x in OPENED.split(", ")]
    schema = pa.schema([("doc_row", pa.int64()), ("doc_id", pa.int64()), ("page_index", pa.int32()), ("length", pa.int64()), ("header_offset", pa.int64()), ("recovered", pa.bool_()), ("encrypted", pa.bool_()), ("page_count", pa.int32()), ("truncated", pa.bool_()), ("error_kind", pa.string()), ("error_message", pa.string()), ("media", pa.list_(pa.float64())), ("crop", pa.list_(pa.float64())), ("rotate", pa.int32()), ("content", pa.binary()), ("resources", pa.binary())])

    def run(batches):
        for batch in batches:
            ids, data, at = (batch.column(c).to_pylist() for c in ("doc_id", "content", "doc_row"))
            words = batch.column("password").to_pylist() if has else [password] * len(ids)
            for first in range(0, len(ids), 64):
                rows = []
                for i in range(first, min(len(ids), first + 64)):
                    rows += [{"doc_row": at[i], "doc_id": ids[i], **r} for r in _open(data[i] or b"", words[i], mode == "FAILFAST")]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema)

    return files.select("doc_row", "doc_id", "content", *["password"] * has).mapInArrow(run, OPENED)


def documents(opened: DataFrame) -> DataFrame:
    return opened.where("page_index is null").select("doc_row", "doc_id", "length", "header_offset", "recovered", "encrypted", "page_count", "truncated", "error_kind", "error_message")


def spread(opened: DataFrame) -> DataFrame:
    """Deals the pages out to all tasks: for inputs of few, large files."""
    return opened.repartition("doc_row", "page_index")


def _joined(parts: list, kind: pa.DataType) -> pa.Array:
    """Lists and arrays one after another."""
    if all(isinstance(p, list) for p in parts):
        return pa.array(list(chain.from_iterable(parts)), kind)
    return pa.array(np.concatenate([np.asarray(p, kind.to_pandas_dtype()) for p in parts]), kind)


def _glyph_batch(keys, pages: list[Page], names: set[str]) -> dict | None:
    runs = [(k, k[2], r) for k, p in zip(keys, pages, strict=True) for r in p.runs]
    if not runs:
        return None
    n = np.array([len(r[1]) for _, _, r in runs])
    rep = lambda values, kind=None: np.repeat(np.array(values, kind), n)
    join = lambda i, kind, cut=slice(None): _joined([r[i][cut] for _, _, r in runs], kind)
    each = lambda values, kind: pa.array(values, kind).take(pa.array(np.repeat(np.arange(len(runs)), n)))
    nan = lambda f: np.array([f(r) for _, _, r in runs], float)
    real = pa.float64()
    # each made only where it is asked for
    columns = {
        "doc_row": lambda: each([k[0] for k, _, _ in runs], pa.int64()), "doc_id": lambda: each([k[1] for k, _, _ in runs], pa.int64()), "page_index": lambda: pa.array(rep([i for _, i, _ in runs], np.int32)), "kind": lambda: each(["glyph"] * len(runs), pa.string()),
        "seq": lambda: pa.array((np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + rep([r[0] for _, _, r in runs])).astype(np.int32)), "own_text": lambda: join(2, pa.string()), "span": lambda: each([r[14][0] if r[14] else None for _, _, r in runs], pa.int32()), "span_text": lambda: each([r[14][1] if r[14] else None for _, _, r in runs], pa.string()),
        "x": lambda: join(3, real, slice(None, -1)), "y": lambda: join(4, real, slice(None, -1)), "end_x": lambda: join(3, real, slice(1, None)), "end_y": lambda: join(4, real, slice(1, None)),
        "size": lambda: pa.array(np.repeat(nan(lambda r: r[6]), n)), "rotation": lambda: pa.array(np.repeat(nan(lambda r: r[7]), n)), "advance": lambda: join(5, real), "mode": lambda: pa.array(rep([r[8] for _, _, r in runs], np.int32)),
        "code": lambda: join(1, pa.int64()), "font_name": lambda: each([r[11] for _, _, r in runs], pa.string()), "base_font": lambda: each([r[12] for _, _, r in runs], pa.string()), "flags": lambda: pa.array(rep([r[13] for _, _, r in runs], np.int32)),
        "fill": lambda: each([list(r[9]) for _, _, r in runs], pa.list_(pa.float64())), "fill_alpha": lambda: pa.array(np.repeat(nan(lambda r: r[10]), n)),
    }
    return {"": range(int(n.sum()))} | {c: made() for c, made in columns.items() if c in names}


_OUT = pa.schema([("doc_row", pa.int64()), ("doc_id", pa.int64()), ("page_index", pa.int32()), ("kind", pa.string()), ("seq", pa.int32()), ("own_text", pa.string()), ("span", pa.int32()), ("span_text", pa.string()), *[(c, pa.float64()) for c in ("x", "y", "end_x", "end_y", "size", "rotation", "advance")], ("mode", pa.int32()), ("code", pa.int64()), ("font_name", pa.string()), ("base_font", pa.string()), ("flags", pa.int32()), ("fill", pa.list_(pa.float64())), ("fill_alpha", pa.float64()), ("stroke", pa.list_(pa.float64())), ("stroke_alpha", pa.float64()), ("line_width", pa.float64()), ("even_odd", pa.bool_()), ("cmds", pa.list_(pa.struct([("op", pa.string()), ("pts", pa.list_(pa.float64()))]))), ("bbox", pa.list_(pa.float64())), ("name", pa.string()), ("ctm", pa.list_(pa.float64())), ("width", pa.int32()), ("height", pa.int32()), ("is_mask", pa.bool_()), ("bpc", pa.int32()), ("components", pa.int32()), ("obj_num", pa.int64()), ("data", pa.binary()), ("codec", pa.string()), *[(c, pa.float64()) for c in ("tx", "ty", "lx", "ly", "ey")], ("last_text", pa.string()), ("starts", pa.bool_()), ("n", pa.int32())])


def _run_batch(keys, pages: list[Page], _names: set[str]) -> dict | None:
    rows = [(*k, r) for k, p in zip(keys, pages, strict=True) for r in p.shown]
    if not rows:
        return None
    col = lambda f, kind: pa.array([f(r) for r in rows], kind)
    own = lambda i, kind: pa.array([r[3][i] for r in rows], kind)
    numbers = {c: own(i, pa.float64()) for c, i in (("x", 3), ("y", 4), ("tx", 5), ("ty", 6), ("lx", 7), ("ly", 8), ("end_x", 9), ("end_y", 10), ("ey", 11), ("size", 15), ("rotation", 16))}
    return {
        "doc_row": col(lambda r: r[0], pa.int64()), "doc_id": col(lambda r: r[1], pa.int64()), "page_index": col(lambda r: r[2], pa.int32()), "kind": pa.array(["run"] * len(rows), pa.string()), "seq": own(0, pa.int32()), "own_text": own(1, pa.string()),
        "span": col(lambda r: r[3][2] and r[3][2][0], pa.int32()), "span_text": col(lambda r: r[3][2] and r[3][2][1], pa.string()), **numbers, "last_text": own(12, pa.string()), "starts": own(13, pa.bool_()), "n": own(14, pa.int32()), "mode": own(17, pa.int32()),
    }



def _batch(columns: dict, out: pa.Schema) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in out], schema=out)


#: What text assembly reads of a glyph.
TEXT_COLUMNS = ("doc_row", "doc_id", "page_index", "kind", "seq", "own_text", "span", "span_text", "x", "y", "end_x", "end_y", "size", "rotation", "mode")
#: The same of a run, a whole shown string, which stands for its glyphs: where the first and the last
#: glyph with text are, and what the last glyph is.
RUN_COLUMNS = (*TEXT_COLUMNS, "tx", "ty", "lx", "ly", "ey", "last_text", "starts", "n")


def primitive_batches(keys: list[tuple], pages: list[Page], out: pa.Schema):
    """What pages hold, as batches of the columns in `out`; keys: (doc_row, doc_id, page_index) of each."""
    for made in (_glyph_batch(keys, pages, set(out.names)), _run_batch(keys, pages, set(out.names))):
        if made:
            yield _batch(made, out)
    rows = []
    for (at, d, i), p in zip(keys, pages, strict=True):
        for s, path, box, fill, stroke, width, odd, fa, sa in p.paths:
            rows.append({"doc_row": at, "doc_id": d, "page_index": i, "kind": "path", "seq": s, "cmds": [{"op": o, "pts": q} for o, q in path], "bbox": list(box), "fill": fill and list(fill), "stroke": stroke and list(stroke), "line_width": width, "even_odd": odd, "fill_alpha": fa, "stroke_alpha": sa})
        for s, name, ctm, box, w, h, mask, bpc, n, fill, fa, num, data, codec in p.images:
            rows.append({"doc_row": at, "doc_id": d, "page_index": i, "kind": "image", "seq": s, "name": name, "ctm": list(ctm), "bbox": list(box), "width": w, "height": h, "is_mask": mask, "bpc": bpc, "components": n, "fill": list(fill), "fill_alpha": fa, "obj_num": num, "data": data, "codec": codec})
    if rows:
        yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in out} for r in rows], out)


def _kept(columns: tuple[str, ...] | None) -> tuple[pa.Schema, str | T.StructType]:
    out = _OUT if columns is None else pa.schema([f for f in _OUT if f.name in columns])
    return out, PRIMITIVES if columns is None else T.StructType([f for f in T._parse_datatype_string(PRIMITIVES).fields if f.name in columns])


#: Pages, and bytes of their contents, whose primitives go into one batch.
PAGES, PAGE_BYTES = 512, 1 << 19


def file_primitives(files: DataFrame, want: tuple[str, ...] = ("glyph", "path", "image"), columns: tuple[str, ...] | None = None, password: str | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """`page_primitives` of `open_documents` in one stage: for small files, whose pages needn't be dealt out between the two, nor
    what they need of their resources be packed and unpacked. Files that can't be opened have no rows here."""
    if "doc_row" not in files.columns:
        files = files.withColumn("doc_row", F.monotonically_increasing_id())
    has = "password" in files.columns
    out, schema = _kept(columns)

    def run(batches):
        for batch in batches:
            ids, at = (batch.column(c).to_pylist() for c in ("doc_id", "doc_row"))
            words = batch.column("password").to_pylist() if has else [password] * len(ids)
            keys, pages, size = [], [], 0
            for i, content in enumerate(batch.column("content")):
                try:
                    found = _read(content.as_py() or b"", words[i])[1]
                except (PasswordError, UnsupportedEncryption, ParseError, *DAMAGE):
                    if mode == "FAILFAST":
                        raise
                    continue
                for k, (p, given) in enumerate(found):
                    page = Page(want)
                    with contextlib.suppress(*DAMAGE):
                        page.run(p["content"], given)
                    keys.append((at[i], ids[i], k))
                    pages.append(page)
                    size += len(p["content"])
                    if len(pages) >= PAGES or size > PAGE_BYTES:
                        yield from primitive_batches(keys, pages, out)
                        keys, pages, size = [], [], 0
            if pages:
                yield from primitive_batches(keys, pages, out)

    return files.select("doc_row", "doc_id", "content", *["password"] * has).mapInArrow(run, schema)


def page_primitives(opened: DataFrame, want: tuple[str, ...] = ("glyph", "path", "image"), columns: tuple[str, ...] | None = None) -> DataFrame:
    """Page rows -> rows of the wanted kinds, which may also be "run"; `seq` is the paint order among all kinds. `columns`
    keeps what isn't asked for from leaving the tasks, as Catalyst can't prune inside them."""
    out, schema = _kept(columns)

    def run(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 32):
                part = batch.slice(first, 32)
                keys, pages = list(zip(*[part.column(c).to_pylist() for c in ("doc_row", "doc_id", "page_index")], strict=True)), []
                for content, resources in zip(part.column("content").to_pylist(), part.column("resources").to_pylist(), strict=True):
                    page = Page(want)
                    given = _Resources(io.BytesIO(resources)).load()
                    with contextlib.suppress(*DAMAGE):
                        page.run(content or b"", given)
                    pages.append(page)
                yield from primitive_batches(keys, pages, out)

    pages = opened.where("page_index is not null").select("doc_row", "doc_id", "page_index", "content", "resources")
    return pages.mapInArrow(run, schema)


def image_data(files: DataFrame, images: DataFrame, password: str | None = None) -> DataFrame:
    """(doc_id, obj_num, data, codec) of the image objects that `images` names: pixels are read only when
    asked for, each file once. codec is null for raw samples."""
    wanted = images.where("obj_num >= 0").groupBy("doc_id").agg(F.collect_set("obj_num").alias("nums"))

    def run(batches):
        for batch in batches:
            for doc_id, content, nums in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "content", "nums")], strict=True):
                rows = []
                try:
                    pdf = PdfFile(content, password)
                except (PasswordError, UnsupportedEncryption, ParseError, *DAMAGE):
                    continue
                for num in nums:
                    s = pdf.get(num)
                    if isinstance(s, Stream):
                        try:
                            data, codec = decode(s, pdf.resolve)
                        except FilterError:
                            continue
                        rows.append({"doc_id": doc_id, "obj_num": num, "data": data, "codec": codec})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("obj_num", pa.int64()), ("data", pa.binary()), ("codec", pa.string())]))

    return files.select("doc_id", "content").join(wanted, "doc_id").mapInArrow(run, "doc_id long, obj_num long, data binary, codec string")
