"""The image objects of files by content: equal streams of all files are decoded once.

Two narrow passes over the files. The first says which objects are images and the digest of each one's stream and entries; what
`pdf_tables.objects` names, and what is asked for, is left by joins over these few bytes. The second has the streams of
the digests left, of each one copy; tasks combine theirs before the shuffle, and files themselves are never shuffled. A stream is
decoded in one task, and its pixels join the images that hold it.

Rows: every image that is asked for has a row. What can't be decoded has an error and no data; so have images whose filters are
references. Image formats stay as they are, with their codec. Null content and damaged files have no images; streams of encrypted files
come as they are written. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexemes
from ..functions.cos import Name, Stream
from ..functions.filters import FilterError, decode
from .store import stored

HELD = "doc_row long, offset long, digest binary"
RAW = "digest binary, entries string, raw binary"
DECODED = "digest binary, data binary, codec string, error string"
_FILTERS = ("Filter", "F", "DecodeParms", "DP")


def _images(content: bytes):
    header = max(0, content.find(b"%PDF-"))
    for kind, at, _, _, start, stop, body in lexemes.tokens(content):
        if kind == "object" and start is not None and '"/Image"' in body and json.loads(body).get("Subtype") == "/Image":
            raw = content[header + start : header + stop]
            yield at, hashlib.sha256(len(body).to_bytes(8, "big") + body.encode() + raw).digest(), body, raw


def _passed(raw: bool):
    def run(batches):
        for batch in batches:
            for row, content in zip(batch.column("doc_row").to_pylist(), batch.column("content"), strict=True):
                found = list(_images(content.as_py() or b""))
                if raw:
                    columns = [pa.array([x[i] for x in found], k) for i, k in ((1, pa.binary()), (2, pa.string()), (3, pa.binary()))]
                    yield pa.RecordBatch.from_arrays(columns, ["digest", "entries", "raw"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.binary())], ["doc_row", "offset", "digest"])

    return run


def _value(v):
    """A value of a body's JSON as the decoders take it."""
    if isinstance(v, str):
        return Name(v[1:]) if v[:1] == "/" else bytes.fromhex(v[1:]) if v[:1] == "(" else None
    if isinstance(v, list):
        return [_value(x) for x in v]
    return {k: _value(x) for k, x in v.items()} if isinstance(v, dict) else v


def _far(v) -> bool:
    """Whether a value holds a reference."""
    return v[:1] == "R" if isinstance(v, str) else any(map(_far, v.values() if isinstance(v, dict) else v)) if isinstance(v, (dict, list)) else False


def _decode(batches):
    for batch in batches:
        out = []
        for entries, raw in zip(batch.column("entries").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            d = json.loads(entries)
            if any(_far(d.get(k)) for k in _FILTERS):
                out.append((None, None, "its filters are references"))
                continue
            try:
                out.append((*decode(Stream(_value(d), raw), lambda v: v), None))
            except (FilterError, ValueError, TypeError, KeyError, IndexError, AttributeError) as e:
                out.append((None, None, f"{type(e).__name__}: {e}"))
        columns = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.binary(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("digest"), *columns], ["digest", "data", "codec", "error"])


def held_images(files: DataFrame, objects: DataFrame) -> DataFrame:
    """(doc_row, num, digest): the images among `pdf_tables.objects` of the files."""
    found = files.select("doc_row", "content").mapInArrow(_passed(False), HELD)
    return objects.where("start is not null and num >= 0").select("doc_row", "num", "offset").join(found, ["doc_row", "offset"]).select("doc_row", "num", "digest")


def decoded_streams(files: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, data, codec, error) of the streams with these digests, each once."""
    raw = files.select("doc_row", "content").mapInArrow(_passed(True), RAW)
    # combined first, so that of each stream one copy a task is shuffled, and none again for the join; a semi join would be pushed below
    one = raw.groupBy("digest").agg(F.any_value("entries").alias("entries"), F.any_value("raw").alias("raw"))
    return one.join(digests.select("digest").distinct(), "digest").select("digest", "entries", "raw").mapInArrow(_decode, DECODED)


def image_contents(files: DataFrame, objects: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_row, num, digest, data, codec, error) of all images, or of those that `wanted` (doc_row, num) names."""
    held = held_images(files, objects)
    if wanted is not None:
        held = held.join(wanted.select("doc_row", "num").distinct(), ["doc_row", "num"], "left_semi")
    held = stored(held, "pdf-images")
    return held.join(stored(decoded_streams(files, held), "pdf-streams"), "digest")
