"""`spark.read.format("pdf")` and the table function `pdf_glyphs`.

    register(spark)
    spark.read.format("pdf").option("rows", "run").load("/data/reports").where("page_index < 3")

Option `rows` says what a row is: document, page (the default), glyph, run, path or image. Columns that aren't in the schema
asked for (`.schema("path string, page_index int, own_text string")`) are never made.

Small files are packed into tasks of about `splitBytes`. Larger ones are split: blocks of BLOCK pages are dealt in turn to as
many tasks as the file has splits, so which task has a page follows from its number alone. Filters on `path` and `page_index` are
pushed down: files and tasks that can't match aren't planned, and
of a file's pages only those that match are decoded. A task reads its files whole: splits share out the work on pages,
not bytes.

Rows: a damaged file has one `document` row, with the error, and no others; null or unknown pages none; empty folders give no
rows. Files are found by name, `*.pdf` in any case, in folders at any depth; a file that is named itself may have any name.
"""

from __future__ import annotations

import contextlib
from collections.abc import Mapping
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.functions import udtf
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.page_ops import Page
from .pdf import _KINDS, _OUT, DAMAGE, ParseError, PasswordError, PdfFile, UnsupportedEncryption, _closure, primitive_batches

#: Pages that go to a task together, and bytes of files that a task is planned for.
BLOCK, SPLIT_BYTES = 64, 64 << 20
_PATH, _PAGE = pa.field("path", pa.string()), pa.field("page_index", pa.int32())
DOCUMENT = pa.schema([_PATH, ("length", pa.int64()), ("header_offset", pa.int64()), ("recovered", pa.bool_()), ("encrypted", pa.bool_()), ("page_count", pa.int32()), ("truncated", pa.bool_()), ("error_kind", pa.string()), ("error_message", pa.string())])
PAGE = pa.schema([_PATH, _PAGE, ("media", pa.list_(pa.float64())), ("crop", pa.list_(pa.float64())), ("rotate", pa.int32()), ("content", pa.binary())])
_OF = {
    "glyph": "seq own_text span span_text x y end_x end_y size rotation advance mode code font_name base_font flags fill fill_alpha",
    "run": "seq own_text span span_text x y end_x end_y size rotation mode tx ty lx ly ey last_text starts n",
    "path": "seq fill fill_alpha stroke stroke_alpha line_width even_odd cmds bbox",
    "image": "seq name ctm bbox width height is_mask bpc components obj_num data codec fill fill_alpha",
}
FAILURES = (PasswordError, UnsupportedEncryption, ParseError, *DAMAGE)


def _schema(rows: str) -> T.StructType:
    if rows not in ("document", "page", *_OF):
        raise ValueError(f"rows: document, page, {', '.join(_OF)}; not {rows}")
    return from_arrow_schema({"document": DOCUMENT, "page": PAGE}.get(rows) or pa.schema([_PATH, _PAGE, *[_OUT.field(c) for c in _OF[rows].split()]]))


def _open(path: str) -> tuple[pa_fs.FileSystem, str]:
    return pa_fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pa_fs.LocalFileSystem(), path)


@dataclass
class Files(InputPartition):
    """Some files, of each the split that is a task's."""

    parts: list[tuple[str, int, int]]  # path, split, splits


@dataclass(frozen=True)
class Wanted:
    """What filters leave: page numbers from `low` to `high`, or one of `pages`; tests of the path."""

    low: int = 0
    high: int = (1 << 31) - 1
    pages: frozenset | None = None
    paths: tuple = ()

    def page(self, i: int) -> bool:
        return self.low <= i <= self.high and (self.pages is None or i in self.pages)

    def path(self, path: str) -> bool:
        test = {"EqualTo": lambda v: path == v, "In": lambda v: path in v, "StringStartsWith": path.startswith, "StringEndsWith": path.endswith, "StringContains": lambda v: v in path}
        return all(test[kind](value) for kind, value in self.paths)

    def split(self, split: int, splits: int) -> bool:
        """Whether a split may have a page that is wanted."""
        if self.pages is not None:
            return any(i // BLOCK % splits == split for i in self.pages if self.page(i))
        first, last = self.low // BLOCK, self.high // BLOCK
        return first <= last and (last - first + 1 >= splits or any(b % splits == split for b in range(first, last + 1)))

    def also(self, f: Filter) -> Wanted | None:
        """With one filter more; None if it is none that pages or paths tell."""
        of, kind, value = getattr(f, "attribute", None), type(f), getattr(f, "value", None)
        if of in (("page_index",), ("path",)) and kind is IsNotNull:
            return self
        if of == ("page_index",) and kind in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and isinstance(value, int):
            low = {EqualTo: value, GreaterThanOrEqual: value, GreaterThan: value + 1}.get(kind, self.low)
            high = {EqualTo: value, LessThanOrEqual: value, LessThan: value - 1}.get(kind, self.high)
            return Wanted(max(self.low, low), min(self.high, high), self.pages, self.paths)
        if of == ("page_index",) and kind is In and all(isinstance(v, int) for v in value):
            pages = frozenset(value) if self.pages is None else self.pages & frozenset(value)
            return Wanted(self.low, self.high, pages, self.paths)
        if of == ("path",) and kind in (EqualTo, In, StringStartsWith, StringEndsWith, StringContains):
            return Wanted(self.low, self.high, self.pages, (*self.paths, (kind.__name__, tuple(value) if kind is In else value)))
        return None


class PdfReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.columns, self.rows, self.password = schema.names, options.get("rows", "page"), options.get("password")
        known = {f.name: f.dataType for f in _schema(self.rows).fields}
        for f in schema.fields:
            if known.get(f.name) != f.dataType:
                raise ValueError(f"{f.name}: {f.dataType.simpleString()} is no column of {self.rows} rows")
        self.path, self.split_bytes, self.wanted = options["path"], int(options.get("splitBytes", SPLIT_BYTES)), Wanted()

    def pushFilters(self, filters):
        for f in filters:
            more = self.wanted.also(f)
            if more is None:
                yield f
            else:
                self.wanted = more

    def _files(self) -> list[tuple[str, int]]:
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        if info.type == pa_fs.FileType.File:
            found = [info]
        elif info.type == pa_fs.FileType.Directory:
            found = [x for x in fs.get_file_info(pa_fs.FileSelector(root, recursive=True)) if x.type == pa_fs.FileType.File and x.base_name.lower().endswith(".pdf")]
        else:
            raise ValueError(f"nothing is at {self.path}")
        prefix = self.path[: len(self.path.rstrip("/")) - len(root.rstrip("/"))]
        return sorted((prefix + x.path, x.size) for x in found)

    def partitions(self):
        out, pack, filled = [], [], 0
        for path, size in self._files():
            if not self.wanted.path(path):
                continue
            splits = 1 if self.rows == "document" else max(1, -(-size // self.split_bytes))
            if splits > 1:
                out += [Files([(path, s, splits)]) for s in range(splits) if self.wanted.split(s, splits)]
                continue
            if filled + size > self.split_bytes and pack:
                out.append(Files(pack))
                pack, filled = [], 0
            pack.append((path, 0, 1))
            filled += size
        return [*out, *([Files(pack)] if pack else [])] or [Files([])]

    def read(self, partition: Files):
        for path, split, splits in partition.parts:
            fs, at = _open(path)
            with fs.open_input_stream(at) as f:
                data = f.read()
            yield from self._documents(path, data) if self.rows == "document" else self._pages(path, data, lambda i: self.wanted.page(i) and i // BLOCK % splits == split)  # noqa: B023

    def _documents(self, path: str, data: bytes):
        row = {"path": path, "length": len(data)}
        try:
            pdf = PdfFile(data, self.password)
            count = len(pdf.pages(lambda i: False))
            row |= {"header_offset": pdf.header_offset, "recovered": pdf.recovered, "encrypted": pdf.decryptor is not None, "page_count": count, "truncated": pdf.truncated}
        except FAILURES as e:
            row |= {"error_kind": _KINDS.get(type(e), "Parse"), "error_message": f"{e}"}
        yield tuple(row.get(c) for c in self.columns)

    def _pages(self, path: str, data: bytes, wanted):
        try:
            pdf = PdfFile(data, self.password)
            pages, done = pdf.pages(wanted), {}
        except FAILURES:
            return
        if self.rows == "page":
            for i, p in enumerate(pages):
                if wanted(i):
                    row = {"path": path, "page_index": i, "media": p["media"], "crop": p["crop"], "rotate": p["rotate"], "content": p["content"]}
                    yield tuple(row[c] for c in self.columns)
            return
        out = pa.schema([f for f in _OUT if f.name in self.columns])
        for i, p in enumerate(pages):
            if wanted(i):
                page = Page((self.rows,))
                with contextlib.suppress(*DAMAGE):
                    page.run(p["content"], _closure(pdf, p["resources"], done))
                for batch in primitive_batches([(0, None, i)], [page], out):
                    own = {"path": pa.array([path] * batch.num_rows, pa.string()), **dict(zip(batch.schema.names, batch.columns, strict=True))}
                    yield pa.RecordBatch.from_arrays([own[c] for c in self.columns], self.columns)


class PdfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> T.StructType:
        return _schema(self.options.get("rows", "page"))

    def reader(self, schema: T.StructType) -> PdfReader:
        return PdfReader(schema, self.options)


@udtf(returnType="page_index int, seq int, own_text string, x double, y double, size double, font_name string")
class PdfGlyphs:
    """The glyphs of a file's bytes: `FROM files, LATERAL pdf_glyphs(content)`. Null or damaged bytes give none."""

    def eval(self, content: bytes):
        names = ("page_index", "seq", "own_text", "x", "y", "size", "font_name")
        try:
            pdf = PdfFile(bytes(content or b""))
            pages, done = pdf.pages(), {}
        except FAILURES:
            return
        out = pa.schema([f for f in _OUT if f.name in names])
        for i, p in enumerate(pages):
            page = Page(("glyph",))
            with contextlib.suppress(*DAMAGE):
                page.run(p["content"], _closure(pdf, p["resources"], done))
            for batch in primitive_batches([(0, None, i)], [page], out):
                yield from zip(*[batch.column(c).to_pylist() for c in names], strict=True)


def register(spark: SparkSession) -> None:
    """Makes both known to a session, and lets it push filters into Python sources, without which the reader is refused."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PdfSource)
    spark.udtf.register("pdf_glyphs", PdfGlyphs)
