"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A shard file is a sequence of records

    u64 length | u32 masked crc32 of those 8 bytes | payload | u32 masked crc32 of the payload

and a payload is one document: i64 doc_id, u8 whether it has an id, u8 bytes an id takes (2 or 4),
u32 count, then the ids; all little-endian. Beside each shard lies an index file, of one u64 offset
and one u64 count of tokens before it for each record, so that a reader can take any records in any
order. Shards are ranges of doc_id in order: their concatenation is the corpus in ascending doc_id.

A task writes its shard under a name of its own attempt and renames it when complete; attempts write
the same bytes, so a lost executor or a second attempt does no harm. Files lie in the shared work
folder or any folder that `pyarrow.fs` can open by URI.

Rows: null text encodes as empty and so is one end id; a null doc_id comes first and reads back null;
equal doc_ids are all written, ordered by text hash and text; an empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, sliced, stored, table, work_dir

END = 2
#: Pieces of a generation that a worker remembers the ids of, at about 200 bytes each; pieces that are
#: looked up together, and new ones that are encoded together.
CACHE_PIECES, STRETCH, TOGETHER = 600_000, 120_000, 1000
#: Characters of texts that are cut together; longer texts are cut alone, in stretches.
CUT_CHARS = 2 << 20
#: About how many bytes of records one read takes, where no single record is longer.
READ_BYTES = 8 << 20
_MARKS = frozenset(".,;:!?")
_MASK_DELTA = 0xA282EAD8
#: White space other than single spaces and line feeds between other characters; texts that have it
#: are cut by the library itself.
_RUNS = ("  ", "\n\n", " \n", "\n ", "\x00")
_OTHER_SPACE = re.compile(r"[\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK_DELTA) & 0xFFFFFFFF


class Encoder:
    """Whole texts -> id bytes. The vocabulary's pattern always cuts a text before a space or a line
    feed that stands alone. The distinct pieces between that aren't remembered are encoded together
    in one call of the library, and its tokens are dealt to them by their lengths in bytes; texts with
    other white space, or with a special token's string, are encoded whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.cuts = '"ByteLevel"' in self.tokenizer.pre_tokenizer.__getstate__().decode() if self.tokenizer.pre_tokenizer else False
        self.pieces: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.remember = CACHE_PIECES
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.length = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # of a token, in bytes
        for token, i in vocab.items():
            self.length[i] = len(token)

    def _simple(self, text: str) -> bool:
        return self.cuts and not any(r in text for r in _RUNS) and not any(s in text for s in self.special) and not _OTHER_SPACE.search(text)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Remembers the ids of all the pieces. There are two generations: when the young one is full it
        becomes the old one, whose pieces are forgotten unless they come again."""
        if len(self.pieces) > self.remember:
            self.old, self.pieces = self.pieces, {}
        known, old = self.pieces, self.old
        missing = []
        for p in pieces.difference(known):
            ids = old.get(p)
            if ids is None:
                missing.append(p)
            else:
                known[p] = ids
        # the pattern cuts between a letter and a mark
        marked = {p: core for p in missing if p[-1:] in _MARKS and (core := p.rstrip(".,;:!?"))[-1:].isalpha()}
        new = [p for p in {*marked.values(), *(p[len(c) :] for p, c in marked.items()), *(p for p in missing if p not in marked)} if p not in known]
        alone = [p for p in new if p in ("", " ", "\n")]
        known.update((p, self._whole(p)) for p in alone)
        new = [p for p in new if p not in ("", " ", "\n")]
        for a in range(0, len(new), TOGETHER):
            self._encode(new[a : a + TOGETHER])
        known.update((p, known[c] + known[p[len(c) :]]) for p, c in marked.items())

    def _encode(self, pieces: list[str]) -> None:
        """Remembers these; one without a space before it is put after a line feed, whose token isn't its own."""
        bare = np.array([p[0] != " " for p in pieces])
        text = "".join([("\n" + p if b else p) for p, b in zip(pieces, bare.tolist(), strict=True)])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.cumsum(self.length[ids])
        size = np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces))
        stop = np.searchsorted(ends, np.cumsum(size + bare)) + 1
        start = np.concatenate([[0], stop[:-1]]) + bare
        data, w = ids.tobytes(), self.dtype.itemsize
        self.pieces.update((p, data[a:b]) for p, a, b in zip(pieces, (start * w).tolist(), (stop * w).tolist(), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        cuts = [i for i, t in enumerate(texts) if t and self._simple(t)]
        group: list[int] = []
        count = 0
        for i in cuts:
            if len(texts[i]) > CUT_CHARS:
                out[i] = self._stretches(texts[i])
                continue
            if count + len(texts[i]) > CUT_CHARS:
                self._together(group, texts, out)
                group, count = [], 0
            group.append(i)
            count += len(texts[i])
        self._together(group, texts, out)
        cut = set(cuts)
        for i, t in enumerate(texts):
            if t and i not in cut:
                out[i] = self._whole(t)
        return out

    def _together(self, group: list[int], texts: list[str], out: list[bytes]) -> None:
        """Cuts these texts and numbers their distinct pieces with Arrow kernels, looks each distinct piece up once, and
        gathers the ids by number."""
        if not group:
            return
        cut = pa.array([texts[i] for i in group], pa.large_string())
        for mark, cuts in (("\n", "\0\n\0"), (" ", "\0 ")):
            cut = pc.replace_substring(cut, mark, cuts)
        cut = pc.split_pattern(cut, "\0")
        ends, numbered = cut.offsets.to_numpy(), cut.flatten().dictionary_encode()
        pieces = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        self._learn(set(pieces))
        found = list(map(self.pieces.__getitem__, pieces))
        ids, length = np.frombuffer(b"".join(found), self.dtype), np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        number = numbered.indices.to_numpy()
        size = length[number]
        stop = np.cumsum(size)
        data = ids[np.arange(size.sum()) + np.repeat((np.cumsum(length) - length)[number] - (stop - size), size)].tobytes()
        bounds = (np.concatenate([[0], stop])[ends] * self.dtype.itemsize).tolist()
        for i, a, b in zip(group, bounds[:-1], bounds[1:], strict=True):
            out[i] = data[a:b]

    def _stretches(self, text: str) -> bytes:
        pieces, done = text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0"), []
        for a in range(0, len(pieces), STRETCH):
            some = pieces[a : a + STRETCH]
            self._learn(set(some))
            done.append(b"".join(map(self.pieces.__getitem__, some)))
        return b"".join(done)

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, remember: int | None = None) -> Encoder:
    """The worker's encoder for a vocabulary, which from now on remembers so many pieces."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].remember = remember or CACHE_PIECES
    return _ENCODERS[path]


def frame(doc_id: int | None, ids: bytes, width: int) -> bytes:
    payload = struct.pack("<qBBI", doc_id or 0, doc_id is not None, width, len(ids) // width) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def parse(data: memoryview):
    """(doc_id, ids) of the records in data; raises ValueError where a checksum fails."""
    at = 0
    while at < len(data):
        length = bytes(data[at : at + 8])
        if struct.unpack_from("<I", data, at + 8)[0] != masked_crc(length):
            raise ValueError(f"bad length checksum at byte {at}")
        n = struct.unpack("<Q", length)[0]
        payload = data[at + 12 : at + 12 + n]
        if struct.unpack_from("<I", data, at + 12 + n)[0] != masked_crc(payload):
            raise ValueError(f"bad record checksum at byte {at}")
        doc_id, known, width, count = struct.unpack_from("<qBBI", payload)
        ids = np.frombuffer(payload, f"<u{width}", count, struct.calcsize("<qBBI"))
        yield (doc_id if known else None), ids
        at += 16 + n


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _place(store, attempt: str, name: str) -> None:
    """Gives a complete file its name. Where another attempt, which wrote the same bytes, was first and
    the file system doesn't replace files, this one goes."""
    try:
        store.move(attempt, name)
    except OSError:
        from pyarrow import fs

        if store.get_file_info(name).type != fs.FileType.File:
            raise
        store.delete_file(attempt)


def _writer(root: str, tokenizer: str, end: int | None, remember: int):
    def run(batches):
        context = TaskContext.get()
        shard = context.partitionId()
        store, base = _filesystem(root)
        name = f"{base}/part-{shard:06d}"
        attempt = f"{name}.attempt-{context.taskAttemptId()}"
        enc, offset, tokens, index = encoder(tokenizer, remember), 0, 0, []
        stop = b"" if end is None else np.array([end], enc.dtype).tobytes()
        with store.open_output_stream(f"{attempt}.rec") as out:
            for batch in sliced(batches):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for doc_id, data in zip(ids, enc.encode_all(texts), strict=True):
                    data += stop
                    record = frame(doc_id, data, enc.dtype.itemsize)
                    out.write(record)
                    index += (offset, tokens)
                    offset += len(record)
                    tokens += len(data) // enc.dtype.itemsize
        with store.open_output_stream(f"{attempt}.idx") as out:
            out.write(np.array(index, "<u8").tobytes())
        for kind in ("idx", "rec"):
            _place(store, f"{attempt}.{kind}", f"{name}.{kind}")
        if index:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "records": [len(index) // 2], "tokens": [tokens], "bytes": [offset]})

    return run


def write_records(docs: DataFrame, root: str, tokenizer: str | None = None, end: int | None = END, shards: int | None = None, remember: int = CACHE_PIECES) -> DataFrame:
    """Writes docs (doc_id, text) below the URI root; returns the stored manifest: shard, records,
    tokens, bytes and start, the tokens of all shards before. `remember`: pieces of text that a worker
    remembers the ids of; fewer cost time, more memory."""
    spark = docs.sparkSession
    store, base = _filesystem(root)
    store.create_dir(base, recursive=True)
    n = shards or partitions(spark)
    rows = docs.select("doc_id", "text").withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text")
    manifest = stored(rows.mapInArrow(_writer(root, tokenizer or default_tokenizer(), end, remember), "shard int, records long, tokens long, bytes long"), "records-manifest")
    # a row a shard
    return manifest.withColumn("start", F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("tokens"))


def _reader(root: str, with_ids: bool):
    """Of each (shard, first, last): the records that begin in those bytes, some at a time."""

    def run(batches):
        store, base = _filesystem(root)
        for batch in batches:
            for shard, start, size, first, last in zip(*[batch.column(c).to_pylist() for c in ("shard", "start", "bytes", "first", "last")], strict=True):
                name = f"{base}/part-{shard:06d}"
                with store.open_input_file(f"{name}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
                a, b = np.searchsorted(index[:, 0], [first, last]).tolist()
                if a == b:
                    continue
                begin, stop = int(index[a, 0]), int(index[b, 0]) if b < len(index) else size
                with store.open_input_file(f"{name}.rec") as f:
                    data = memoryview(f.read_at(stop - begin, begin))
                out = {"doc_id": [], "shard": [], "record": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                for i, (doc_id, ids) in enumerate(parse(data), a):
                    wide = ids.astype("<u4")
                    out["doc_id"].append(doc_id)
                    out["shard"].append(shard)
                    out["record"].append(i)
                    out["start"].append(start + int(index[i, 1]))
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(wide.tobytes()))
                    out["ids"].append(wide.astype(np.int32) if with_ids else None)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return run


def read_records(manifest: DataFrame, root: str, with_ids: bool = False, chunk: int = READ_BYTES) -> DataFrame:
    """doc_id, shard, record, start, n_tokens, ids_crc32 and, if asked for, ids: ranges of about
    `chunk` bytes, whose records are found through the index, are dealt out to all tasks."""
    chunks = manifest.where("records > 0").select("shard", "start", "bytes", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / chunk).cast("int"))).alias("c"))
    chunks = chunks.select("shard", "start", "bytes", (F.col("c").cast("long") * chunk).alias("first"), ((F.col("c").cast("long") + 1) * chunk).alias("last"))
    n = 4 * partitions(manifest.sparkSession)
    return chunks.repartition(n).mapInArrow(_reader(root, with_ids), "doc_id long, shard int, record long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_dir(spark, "token-records")
    manifest = write_records(table(spark, sf_dir, "documents"), root)
    return read_records(manifest, root).select("doc_id", "start", "n_tokens", "ids_crc32")
