r"""Substring dedup with a sparse suffix array over byte texts.

Every byte covered by a `WINDOW`-byte string that also starts anywhere else is removed. A suffix array
of all suffixes would ship each text WINDOW times over; this one holds the suffixes at content-defined
places and loses nothing:

1. Each window is owned by the leftmost of its `LEAD`-byte strings that has the least hash, its anchor, so
   equal windows have anchors with equal leading bytes at the same place in the window. About one
   position in seventy is an anchor. Anchors whose leading bytes hash like no other's are left: an
   equi-join with the counted hashes, whose other side has one row a hash, so AQE can split a hot one.
2. The remaining suffixes, as far as their windows reach, are range-partitioned by their leading bytes;
   Spark samples the splitters. A salt behind the leading bytes lets a splitter fall inside a
   group of any size, so buckets are even.
3. A bucket sorts its suffixes by multikey quicksort over 8-byte tokens, and a second time by what stands
   before them, read backwards. Neighbours' common lengths in both orders say, for each place
   of the anchor in the window, which windows are equal: runs of neighbours share enough
   behind the anchor, runs of the other order enough before it.
4. Across boundaries: groups at a bucket's edges may go on in the next. Of each of their distinct windows
   a 128-bit digest leaves the bucket once, with its place if it has no equal inside; digests
   met from two buckets settle these.
5. What is covered is cut out of the texts.

A context is a few hundred bytes, a bucket about BUCKET_BYTES of them: nothing grows with a group.

Rows: null texts are empty; texts shorter than WINDOW bytes lose nothing; rows are told apart by a key of
their own, so null and repeated doc_ids and repeated rows each count as texts of their own (and repeated rows
remove each other, if long enough); overlapping repeats inside one text count; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, mix64, narrow_to, partitions, sliced, stored, table, texts_of

WINDOW, LEAD = 200, 64
#: Places that an anchor may have in its window.
PLACES = WINDOW - LEAD + 1
#: Bytes of contexts in a bucket.
BUCKET_BYTES = 8 << 20
ANCHORS = "hash long, row long, pos int, before int, behind int"
CONTEXTS = "row long, pos int, before binary, behind binary"
#: start and stop of covered bytes, or, with a digest, of one window of a group at a bucket's edge; row is null where it needs no answer.
FOUND = "row long, start int, stop int, digest binary"
_MUL = np.uint64(0x9E3779B97F4A7C15)


def lead_hashes(data: np.ndarray) -> np.ndarray:
    """Of all LEAD-byte strings, by doubling widths; never 0."""
    h, p, width = data.astype(np.uint64) + np.uint64(1), int(_MUL), 1
    while width < LEAD:
        h = h[:-width] * np.uint64(p) + h[width:]
        p, width = p * p & (1 << 64) - 1, 2 * width
    return np.maximum(mix64(h), np.uint64(1))


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        x, have = pick(x[:-step], x[step:]), have + step
    return x


def anchors_of(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: anchors, their hashes, and the first and last window that each owns."""
    none = np.empty(0, np.int64)
    if len(data) < WINDOW:
        return none, none.astype(np.uint64), none, none
    h = lead_hashes(data)
    least = _sliding(h, PLACES, np.minimum)
    ends = np.cumsum(sizes)
    outside = np.zeros(len(data) + 1, np.int64)  # windows that reach over a text's end
    np.add.at(outside, np.maximum(ends - WINDOW + 1, ends - sizes), 1)
    np.add.at(outside, ends, -1)
    least[np.cumsum(outside[: len(least)]) > 0] = 0
    edge = np.zeros(PLACES - 1, np.uint64)
    most = _sliding(np.concatenate([edge, least, edge]), PLACES, np.maximum)
    at = np.flatnonzero(h == most)  # least in some window that lies in a text
    if not len(at):
        return none, none.astype(np.uint64), none, none
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], len(least)) - 1
    run_of = least[first] > 0
    first, last = first[run_of], last[run_of]
    _, ids = np.unique(np.concatenate([h[at], least[first]]), return_inverse=True)
    mine, theirs, scale = ids[: len(at)], ids[len(at) :], len(data) + 1
    runs = theirs * scale + last
    order = np.argsort(runs)
    run = order[np.searchsorted(runs[order], mine * scale + np.maximum(at - PLACES + 1, 0))]
    low, high = np.maximum(first[run], at - PLACES + 1), np.minimum(last[run], at)
    order = np.lexsort((at, mine))  # of equal leads in a window the leftmost owns it
    a, m = at[order], mine[order]
    before = np.where(m[1:] == m[:-1], a[:-1] + 1, 0)
    low[order[1:]] = np.maximum(low[order[1:]], before)
    own = low <= high
    return at[own], h[at[own]], low[own], high[own]


def _anchors(batches):
    for batch in sliced(batches):
        texts = texts_of(batch)
        sizes = np.array([len(t) for t in texts], np.int64)
        at, h, low, high = anchors_of(np.frombuffer(b"".join(texts), np.uint8), sizes)
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, at, "right")
        rows = batch.column("row").to_numpy()[doc]
        columns = [pa.array(h.view(np.int64)), pa.array(rows, pa.int64()), *[pa.array(x.astype(np.int32)) for x in (at - (ends - sizes)[doc], at - low, high + WINDOW - at)]]
        yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in ANCHORS.split(", ")])


def _contexts(batches):
    names = [x.split()[0] for x in CONTEXTS.split(", ")]
    for batch in sliced(batches):
        rows, places, before, behind = [], [], [], []
        for row, text, anchors in zip(batch.column("row").to_pylist(), texts_of(batch), batch.column("anchors").to_pylist(), strict=True):
            for x in anchors:
                at = x["pos"]
                rows.append(row)
                places.append(at)
                before.append(text[at - x["before"] : at])
                behind.append(text[at : at + x["behind"]])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(places, pa.int32()), pa.array(before, pa.binary()), pa.array(behind, pa.binary())], names)


def _matrix(column, width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary column as rows of `width`, filled up with zeros, and their lengths."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(b"".join(column.to_pylist()) or b"\0", np.uint8)
    starts, out, i = np.cumsum(sizes) - sizes, np.zeros((len(sizes), width), np.uint8), np.arange(width)
    for a in range(0, len(sizes), 1 << 12):
        first, n = starts[a : a + (1 << 12), None], sizes[a : a + (1 << 12), None]
        at = first + n - 1 - i if backwards else first + i
        out[a : a + (1 << 12)] = np.where(i < n, data[np.where(i < n, at, 0)], 0)
    return out, sizes


def multikey_order(tokens: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of rows by group, then token by token: what a token tells apart isn't looked at again."""
    order = np.argsort(group, kind="stable")
    part = group[order]
    for k in range(tokens.shape[1]):
        same = part[1:] == part[:-1]
        open_ = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
        if not len(open_):
            break
        keys = tokens[order[open_], k]
        by = np.lexsort((keys, part[open_]))
        order[open_], keys = order[open_][by], keys[by]
        new = np.zeros(len(part), np.int64)
        new[open_[1:]] = (keys[1:] != keys[:-1]) & (part[open_][1:] == part[open_][:-1])
        new[1:] += ~same
        part = np.cumsum(new)
    return order


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row in order has in common with the one before; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for a in range(1, len(order), 1 << 14):
        b = min(len(order), a + (1 << 14))
        differ = rows[order[a:b]] != rows[order[a - 1 : b - 1]]
        out[a:b] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return out


def repeated_in(behind: np.ndarray, behind_size: np.ndarray, before: np.ndarray, before_size: np.ndarray):
    """Of contexts of one bucket: group of equal leads, numbered in their order; and an iterator over places
    (place, rows that own a window there, number of equals of each, whether it is the first of these)."""
    n = len(behind)
    by_behind = multikey_order(behind.view(">u8"), np.zeros(n, np.int64))
    shared = _common(behind, by_behind)
    group = np.empty(n, np.int64)
    group[by_behind] = np.cumsum(np.concatenate([[0], shared[1:] < LEAD])) if n else group
    by_before = multikey_order(before.view(">u8"), group)
    shared_before = _common(before, by_before)
    g = group[by_before]
    shared_before[1:][g[1:] != g[:-1]] = -1
    right, left = np.empty(n, np.int64), np.empty(n, np.int64)

    def places():
        for place in range(PLACES):
            own = np.flatnonzero((before_size >= place) & (behind_size >= WINDOW - place))
            if len(own):
                right[by_behind] = np.cumsum(shared < WINDOW - place)
                left[by_before] = np.cumsum(shared_before < place)
                _, first, which, count = np.unique(right[own] * (n + 1) + left[own], return_index=True, return_inverse=True, return_counts=True)
                lead = np.zeros(len(own), bool)
                lead[first] = True
                yield place, own, count[which], lead

    return group, places()


def _bucket(batches):
    """All contexts of one bucket."""
    found = [b for b in batches if b.num_rows]
    names = [x.split()[0] for x in FOUND.split(", ")]
    if not found:
        return
    data = pa.Table.from_batches(found).combine_chunks()
    rows, pos = (data.column(c).to_numpy() for c in ("row", "pos"))
    behind, behind_size = _matrix(data.column("behind"), WINDOW, False)
    before, before_size = _matrix(data.column("before"), PLACES - 1, True)
    group, places = repeated_in(behind, behind_size, before, before_size)
    edge = (group == 0) | (group == group.max())
    low, high = np.full(len(rows), PLACES), np.full(len(rows), -1)
    for place, own, count, lead in places:
        again = own[count > 1]
        low[again], high[again] = np.minimum(low[again], place), place
        to_ask = np.flatnonzero(edge[own] & lead)
        if len(to_ask):
            at = own[to_ask]
            whole = np.concatenate([before[at, :place][:, ::-1], behind[at, : WINDOW - place]], 1)
            digests = [xxhash.xxh3_128_digest(w) for w in whole]
            alone = pa.array(count[to_ask] == 1)
            columns = [pc.if_else(alone, pa.array(rows[at], pa.int64()), None), pa.array((pos[at] - place).astype(np.int32)), pa.array((pos[at] - place + WINDOW).astype(np.int32)), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)
    # every window holds its anchor, so what the windows of one anchor cover is one run
    has = np.flatnonzero(high >= 0)
    columns = [pa.array(rows[has], pa.int64()), pa.array((pos[has] - high[has]).astype(np.int32)), pa.array((pos[has] - low[has] + WINDOW).astype(np.int32)), pa.nulls(len(has), pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names)


def _cut(batches):
    for batch in sliced(batches):
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        for text, spans in zip(texts_of(batch), batch.column("spans").to_pylist(), strict=True):
            at, parts, n = 0, [], 0
            stop = -1
            for x in sorted(spans, key=lambda x: x["start"]):
                if x["start"] > stop:
                    n += 1
                    parts.append(text[max(at, 0) : x["start"]])
                stop = max(stop, x["stop"])
                at = stop
            kept = b"".join([*parts, text[at:]])
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(n)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("row"), *[pa.array(c, k) for c, k in zip(out.values(), kinds, strict=True)]], ["row", *out])


def covered(rows: DataFrame) -> DataFrame:
    """rows: row (distinct), text. (row, spans): what repeats, as runs that may overlap, of the rows that have such."""
    spark = rows.sparkSession
    anchors = stored(rows.mapInArrow(_anchors, ANCHORS), "suffix-anchors")
    # stored, so that the join has a shuffle of its own on either side and AQE can split a hot hash
    again = stored(anchors.groupBy("hash").count().where("count > 1").select("hash"), "suffix-hashes")
    of_row = F.collect_list(F.struct("pos", "before", "behind")).alias("anchors")
    held = stored(anchors.join(again, "hash").groupBy("row").agg(of_row, F.sum(F.col("before") + F.col("behind")).alias("bytes")), "suffix-rows")
    size = held.agg(F.sum("bytes")).first()[0] or 0
    contexts = narrow_to(rows, held, "row").join(held.drop("bytes"), "row").mapInArrow(_contexts, CONTEXTS)
    buckets = max(partitions(spark), -(-size // BUCKET_BYTES))
    dealt = contexts.repartitionByRange(buckets, F.substring("behind", 1, LEAD), F.xxhash64("row", "pos"))
    found = stored(dealt.mapInArrow(_bucket, FOUND), "suffix-found")
    met = found.where("digest is not null")
    twice = met.groupBy("digest").count().where("count > 1").select("digest")
    across = met.where("row is not null").join(twice, "digest")
    spans = found.where("digest is null").unionByName(across).groupBy("row")
    return stored(spans.agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "suffix-spans")


CUT = "row long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut_out(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of `covered`, with what is left of their texts."""
    return narrow_to(rows, spans, "row").join(spans, "row").mapInArrow(_cut, CUT)


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = keyed(docs.select("doc_id", "text"), "row", "suffix-texts")
    texts = rows.select("row", "text")
    changed = stored(cut_out(texts, covered(texts)).drop("kept"), "suffix-cut")
    text = F.coalesce("text", F.lit(""))
    whole = rows.select("row", "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha256"))
    both = whole.join(changed.select("row", "n_removed", "n_spans", "kept_sha256"), "row", "left")
    none = F.lit(0).cast("long")
    return both.select("doc_id", "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def op12_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, base, substr(h, 2 * base + 1, 2000 + {2 * WINDOW - 2}) AS part FROM (SELECT doc_id, h, 1000 * unnest(range(0, (len(h) // 2 - {WINDOW} + 1000) // 1000)) AS base FROM d)),
w AS (SELECT doc_id, base + i AS i, md5_number(substr(part, 2 * i + 1, {2 * WINDOW})) AS k FROM (SELECT doc_id, base, part, unnest(range(0, least(1000, len(part) // 2 - {WINDOW - 1}))) AS i FROM b)),
m AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
f AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + {WINDOW} AS starts FROM w JOIN m USING (k)),
s AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS b FROM (SELECT doc_id, i, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM f) GROUP BY doc_id, island),
e AS (SELECT doc_id, a, b FROM s UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM d),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM e),
k AS (SELECT doc_id, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a, b) AS kept, sum(b - a) AS n_removed, count(*) - 1 AS n_spans FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (len(h) // 2)::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k USING (doc_id)
"""
