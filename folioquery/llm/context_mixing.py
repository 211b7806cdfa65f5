r"""Language-model scores by logistic context mixing over bits.

A text is read as one run of bytes. A byte becomes its rank after the two bytes before it, and the rank's code word (a prefix code of the corpus) is a path
of binary decisions, two or three a byte. Each of the predictors looks up, by the hash of its own context
(the last 3 and 4 bytes, whatever they are; all of the piece so far; the same with the piece before;
a piece is a run of bytes with the space or line feed after it) and the place in the code, how often either bit
followed in the training documents. Their log odds are combined with weights chosen by a gate (place
in the piece and in the code); the weights start from fixed ones and are refined in each document on its own, by all
decisions: after the first 8, and each time that these have doubled, up to every STEP. The bits of all decisions give the text's probability.

All that a training document itself has added to the bits' counts is taken out of them before it is scored, so training and
held-out documents are scored alike, as texts not seen before. The code, which is made of the triples of all training
documents, stays as it is: in a small corpus a document that holds much of some triples has shorter code words for them. Counts
beyond MOST are scaled down and a document's own are not, which is of no weight among so many.

1. One pass counts words, and triples of bytes, of the training documents; words are summed per hash
   bucket. 2. One pass fills the count tables: a fixed number of slots, of which a task sends its
   sums once. 3. One pass scores. The commonest words (at most HEAD) are broadcast for the base score;
   the others' counts are looked up bucket by bucket. All broadcasts are of fixed size.

Rows: null and empty texts hold only the end of text; zero bytes cost eight bits each; texts of any
length are scored whole; repeated rows each get a row; rows with a null doc_id count as training.
Without training documents all counts are 0 and every bit costs one bit. Extra columns are not read.
"""

from __future__ import annotations

import functools
import heapq
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_words, mix64, partitions, sliced, stored, table, texts_of
from .repeats import _cells, bucket_of, pack, unpack

#: Slots (as powers of two) of the predictors: the piece so far with the one before, the piece so far, 4 and 3 bytes. Larger
#: ones come first, so that each one's first slot is a multiple of its size.
SLOT_BITS = (21, 20, 20, 19)
FIRST_SLOT = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])])
PREDICTORS = len(SLOT_BITS)
#: Weights that every document starts with, learning rate, prior count of a bit.
START = np.array([0.30, 0.30, 0.25, 0.25], np.float32)
LEARN, PRIOR = 0.02, 0.2
#: Decisions after which the weights are refined, at first and at most.
FIRST_STEP, STEP = 8, 128
#: Bytes of texts whose words are counted, or looked up, together.
TEXTS = 8 << 20
#: About how many bytes of documents are mixed side by side, and looked up together; most documents side by side, whose weights
#: and decisions of a step are to stay in the processor's cache.
TOGETHER, PART, MANY = 1 << 20, 1 << 15, 256
#: Longer texts are taken in segments of about TOGETHER bytes.
LONG = 1 << 22
#: Zero bytes before a document; a base of hashes of bytes, and its inverse.
PAD, BASE = b"\0" * 4, 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: A slot's counts are scaled down to fit 16 bits each.
MOST = 60_000
_LOG = np.log(np.arange(1 << 16) + PRIOR).astype(np.float32)
GATES = 8 * 16
#: Most decisions that a task sums before it sends the sums.
MOST_SEEN = 1 << 31
#: Most words whose counts are broadcast; words of the end of a text.
HEAD, END_WORD, END_BYTE = 1 << 18, b"\0end", b"\xff"
#: Slots a row of partial sums has.
BLOCK_SLOTS = 1 << 14


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def pieces_of(text: bytes) -> list[bytes]:
    """Without zero bytes, and with the end of text."""
    parts = text.replace(b" ", b" \0").replace(b"\n", b"\n\0").split(b"\0")
    parts[-1] += END_BYTE
    return parts


def stream_of(texts: list[bytes], ended: bool = True) -> np.ndarray:
    """The bytes of texts one after another, with zero bytes around each, and with their ends if `ended`."""
    end = END_BYTE + PAD if ended else PAD
    return np.frombuffer(PAD + b"".join([t.replace(b"\0", b"") + end for t in texts]), np.uint8)


def segments_of(text: bytes):
    """(bytes, how many of these only give the context, whether the text ends) of the segments of a long
    text. They are cut between pieces; only a piece longer than a segment is cut, and starts anew."""
    text = text.replace(b"\0", b"")
    cut_after = lambda low, high: 1 + max(text.rfind(b" ", low, high), text.rfind(b"\n", low, high))
    begin = 0
    while begin < len(text) or not begin:
        end = min(begin + TOGETHER, len(text))
        if end < len(text):
            end = cut_after(begin, end) or end
        # the piece before, and four bytes at least
        low = max(0, begin - TOGETHER)
        context = cut_after(low, max(low, begin - len(PAD)))
        context = context if context and begin else low
        yield text[context:end], begin - context, end == len(text)
        begin = max(end, 1)


def groups_of(texts: list[bytes], most: int | None = None, many: int | None = None):
    """Slices of about `most` (TOGETHER) bytes, and of `many` texts at most."""
    first, size, most = 0, 0, most or TOGETHER
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= most or i + 1 - first == many:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _edges(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of equal values."""
    if not len(x):
        return [], []
    cut = (np.flatnonzero(x[1:] != x[:-1]) + 1).tolist()
    return [0, *cut], [*cut, len(x)]


# --- the code -----------------------------------------------------------------------------------


@dataclass
class Code:
    """rank[two bytes before, byte]; path[rank] and bits[rank] of the code, and its length; `ways`
    has (node * 2 + bit) of all code words one after another, that of rank r from first[r] on; `turns` has what leads from a
    context's cells (a column a predictor) to those of a way. The commoner eight nodes of a context are side by side in memory."""

    rank: np.ndarray
    path: np.ndarray
    bits: np.ndarray
    length: np.ndarray

    def __post_init__(self):
        self.first = np.cumsum(self.length) - self.length
        inside = np.arange(self.path.shape[1]) < self.length[:, None]
        self.ways = (self.path.astype(np.uint16) * 2 + self.bits)[inside]
        way = np.arange(512, dtype=np.uint32)
        node = way >> np.uint32(1)
        far = (node >> np.uint32(4)) * np.uint32(0x9E3779B1)
        turns = [(((far >> np.uint32(36 - b)) << np.uint32(4) | node & np.uint32(15)) << np.uint32(1)) | way & np.uint32(1) for b in SLOT_BITS]
        self.turns = np.stack(turns, axis=1)


def make_code(triples: np.ndarray, counts: np.ndarray) -> Code:
    """From the triples of bytes, as numbers of 24 bits in order, and their counts. Bytes rank by how
    often they followed the two before, then by value."""
    rank = np.empty((65536, 256), np.uint8)
    rank[:] = np.arange(256, dtype=np.uint8)
    weight = np.zeros(256)
    order = np.lexsort((triples & 0xFF, -counts, triples >> 8))
    before, byte, n = triples[order] >> 8, triples[order] & 0xFF, counts[order]
    for a, b in zip(*_edges(before), strict=True):
        seen = byte[a:b]
        rank[before[a], seen] = np.arange(b - a)
        rank[before[a], np.setdiff1d(np.arange(256), seen, assume_unique=True)] = np.arange(b - a, 256)
        weight[: b - a] += n[a:b]
    weight += 0.01
    heap = [(w, i, i) for i, w in enumerate(weight)]  # weight, tie, tree
    heapq.heapify(heap)
    tie = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], tie, (a, b)))
        tie += 1
    words: dict[int, list[tuple[int, int]]] = {}
    todo, nodes = [(-heap[0][0], -heap[0][1], heap[0][2], [])], 0
    while todo:  # heavier nodes get smaller numbers
        *_, tree, way = heapq.heappop(todo)
        if isinstance(tree, int):
            words[tree] = way
            continue
        node, nodes = nodes, nodes + 1
        for bit, (w, t, below) in enumerate(tree):
            heapq.heappush(todo, (-w, -t, below, [*way, (node, bit)]))
    most = max(map(len, words.values()))
    path, bits = np.zeros((256, most), np.uint8), np.zeros((256, most), np.uint8)
    for r, way in words.items():
        for i, (n, b) in enumerate(way):
            path[r, i], bits[r, i] = n, b
    return Code(rank, path, bits, np.array([len(words[r]) for r in range(256)], np.int64))


@dataclass
class Decisions:
    """Of a list of texts, one after another: cells (slot * 2 + bit, a column a predictor), bits, gates, and how
    many each text has."""

    cells: np.ndarray
    bits: np.ndarray
    gates: np.ndarray
    counts: np.ndarray

    @property
    def slots(self) -> np.ndarray:
        return (self.cells >> np.uint32(1)).view(np.int32)


@functools.lru_cache(maxsize=2)
def _powers_once(base: int) -> np.ndarray:
    return _powers(base, 2 * PART)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _powers_of(base: int, n: int) -> np.ndarray:
    once = _powers_once(base)
    return once[:n] if n <= len(once) else _powers(base, n)


def _mix32(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 32-bit values, in place; its high bits are the better ones."""
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0x9E3779B1)
    return x


def _folded(x: np.ndarray) -> np.ndarray:
    """64 bits as 32."""
    halves = x.view(np.uint32)
    return halves[::2] ^ halves[1::2]


def decide(texts: list[bytes], code: Code, skip: int = 0, ended: bool = True) -> Decisions:
    """Of all bytes but the first `skip`, which only give the context, and of the texts' ends if `ended`."""
    data = stream_of(texts, ended)
    n = len(data) - len(PAD)
    wide, byte = data.astype(np.uint32), data[len(PAD) :]
    p1, p2, p3, p4 = (wide[len(PAD) - i :][:n] for i in range(1, 5))
    two = p1 | (p2 << np.uint32(8))
    three = two | (p3 << np.uint32(16))
    four = three | (p4 << np.uint32(24))
    # hashes of the piece so far, and of the piece before, from prefix sums
    begins = (p1 == 0x20) | (p1 == 0x0A) | (p1 == 0)
    first = np.flatnonzero(begins)
    piece = np.cumsum(begins)
    piece -= 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((byte.astype(np.uint64) + np.uint64(1)) * _powers_of(BASE, n), out=sums[1:])
    back, until = _powers_of(INVERSE, n)[first], sums[first]
    so_far = (sums[:-1] - until.take(piece)) * back.take(piece)
    before = np.zeros(len(first), np.uint64)
    before[1:] = (until[1:] - until[:-1]) * back[:-1]
    before[p1[first] == 0] = 0
    both = so_far + mix64(before + np.uint64(1)).take(piece)
    rank = code.rank.reshape(-1).take((two.astype(np.intp) << 8) | byte)
    size = code.length.take(rank)
    size[byte == 0] = 0
    size[:skip] = 0
    ends = np.cumsum(size)
    total = int(ends[-1]) if n else 0
    cells = np.empty((n, PREDICTORS), np.uint32)
    for k, context in enumerate((_folded(both), _folded(so_far), four, three)):
        context += np.uint32(k + 1)
        h = _mix32(context)
        h >>= np.uint32(32 - SLOT_BITS[k])
        h += np.uint32(FIRST_SLOT[k])
        np.left_shift(h, np.uint32(1), out=cells[:, k])
    at = np.repeat(np.arange(n), size)
    way = code.ways.take(np.arange(total) + (code.first.take(rank) - (ends - size)).take(at))
    # rows are gathered as one number of 16 bytes
    of = cells.view(np.complex128).reshape(-1).take(at).view(np.uint32)
    of ^= code.turns.view(np.complex128).reshape(-1).take(way).view(np.uint32)
    place = (np.minimum(np.arange(n) - first.take(piece), 7) * 16).astype(np.uint8)
    gates = place.take(at)
    gates += np.minimum(way >> np.uint16(1), np.uint16(15)).astype(np.uint8)
    counts = np.diff(ends[byte == END_BYTE[0]], prepend=0) if ended else np.array([total])
    return Decisions(of.reshape(-1, PREDICTORS), (way & np.uint16(1)).astype(np.uint8), gates, counts)


def all_decisions(texts: list[bytes], code: Code):
    """The decisions of the texts, a part at a time."""
    short = [t for t in texts if len(t) <= LONG]
    for a, b in groups_of(short, PART):
        yield decide(short[a:b], code)
    for t in texts:
        if len(t) > LONG:
            for part, skip, ended in segments_of(t):
                yield decide([part], code, skip, ended)


# --- training -----------------------------------------------------------------------------------


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct lower-cased words of texts; of each word its text's number, and its hash's."""
    # taken whole: some kernels read a slice from the start of the array below it
    own = pc.take(pc.fill_null(texts, ""), pa.array(np.arange(len(texts))))
    split = pc.ascii_split_whitespace(pc.ascii_lower(own))
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    encoded = pc.list_flatten(split).dictionary_encode()
    names, word = encoded.dictionary.cast(pa.binary()), encoded.indices.to_numpy(zero_copy_only=False)
    some = pc.greater(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)  # white space around a text leaves empty ones
    hashes = hash_words(names.to_numpy(zero_copy_only=False).tolist())
    if not some.all():
        keep = some[word]
        doc, word, hashes = doc[keep], (np.cumsum(some) - 1)[word[keep]], hashes[some]
    return hashes, doc, word.astype(np.int64)


def _count(buckets: int):
    """Rows (bucket, hashes, counts): words of training documents; buckets below 0 have triples of bytes."""

    def run(batches):
        triples = np.zeros(1 << 24, np.int64)
        for batch in sliced(batches, most=TEXTS):
            texts = texts_of(batch)
            keys, _, word = words_of(batch.column("text"))
            keys = np.concatenate([keys, hash_words([END_WORD])])
            counts = np.append(np.bincount(word, minlength=len(keys) - 1), batch.num_rows).astype(np.int64)
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            short = [t for t in texts if len(t) <= LONG]
            parts = [(short[a:b], 0, True) for a, b in groups_of(short, PART)]
            for some, skip, ended in chain(parts, (([part], *rest) for t in texts if len(t) > LONG for part, *rest in segments_of(t))):
                data = stream_of(some, ended).astype(np.intp)
                key = ((data[2:-2] << 8 | data[3:-1]) << 8) | data[4:]
                # numpy's `at` is many times slower where a value isn't of the array's type
                np.add.at(triples, key[skip:][data[4 + skip :] > 0], np.int64(1))
            rows = [(b, pack(keys[c]), pack(counts[c])) for b, c in _cells(bucket_of(keys, buckets))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "hashes", "counts"])
        keys = np.flatnonzero(triples).astype(np.uint64)
        counts = triples[keys.astype(np.int64)]
        to = bucket_of(mix64(keys + np.uint64(1)), buckets)
        order = np.argsort(to, kind="stable")
        keys, counts = keys[order], counts[order]
        rows = [(-1 - b, pack(keys[c]), pack(counts[c])) for b, c in _cells(to[order])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["bucket", "hashes", "counts"])

    return run


def _add(data: pa.Table) -> pa.Table:
    bucket = data.column("bucket")[0].as_py()
    counts = [unpack(c, np.int64) for c in data.column("counts").to_pylist()]
    k, where = np.unique(np.concatenate([unpack(h) for h in data.column("hashes").to_pylist()]), return_inverse=True)
    keys, total = pack(k), np.bincount(where, np.concatenate(counts), len(k)).astype(np.int64)
    sizes = np.bincount(np.log2(np.maximum(total, 1)).astype(np.int64), minlength=48) if bucket >= 0 else np.zeros(48, np.int64)
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "hashes": pa.array([keys], pa.binary()), "counts": pa.array([pack(total)], pa.binary()), "tokens": pa.array([int(total.sum()) if bucket >= 0 else 0], pa.int64()), "types": pa.array([len(total) if bucket >= 0 else 0], pa.int64()), "sizes": pa.array([sizes.tolist()], pa.list_(pa.int64()))})


VOCAB = "bucket int, hashes binary, counts binary, tokens long, types long, sizes array<long>"


def _fill(code: Code):
    """A task's sums of (bit 0, bit 1) by slot, in blocks."""

    def run(batches):
        # sent before a number can run over
        flat, one = np.zeros(2 * int(FIRST_SLOT[-1]), np.uint32), np.uint32(1)
        seen = 0

        def blocks():
            sums = [pack(b.astype(np.int64)) for b in flat.reshape(-1, BLOCK_SLOTS * 2)]
            flat[:] = 0
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums, pa.binary())], ["block", "counts"])

        for batch in sliced(batches):
            for d in all_decisions(texts_of(batch), code):
                if seen + len(d.bits) > MOST_SEEN:
                    yield blocks()
                    seen = 0
                seen += len(d.bits)
                for k in range(PREDICTORS):
                    np.add.at(flat, d.cells[:, k].astype(np.intp), one)
        if seen:
            yield blocks()

    return run


def _add_blocks(data: pa.Table) -> pa.Table:
    """A block's sums, scaled down to fit 16 bits each where they don't."""
    total = sum(unpack(c, np.int64) for c in data.column("counts").to_pylist()).reshape(-1, 2)
    small = np.ceil(total / np.maximum(1, total.max(axis=1) / MOST)[:, None]).astype(np.uint32)
    return pa.table({"block": data.column("block")[:1], "counts": pa.array([pack(small[:, 0] | (small[:, 1] << np.uint32(16)))], pa.binary())})


@dataclass
class Model:
    buckets: int
    tokens: int
    types: int
    code: Code
    counts: np.ndarray
    head: np.ndarray
    head_counts: np.ndarray


def train(docs: DataFrame, buckets: int) -> tuple[Model, DataFrame]:
    """The model of the training documents (doc_id, text), and their words' counts by bucket."""
    rows = docs.select("text")
    vocab = stored(rows.mapInArrow(_count(buckets), "bucket int, hashes binary, counts binary").groupBy("bucket").applyInArrow(_add, VOCAB), "lm-words")
    tokens, types = vocab.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    sizes = np.array(vocab.agg(*[F.coalesce(F.sum(F.col("sizes")[i]), F.lit(0)) for i in range(48)]).first())
    triples = vocab.where("bucket < 0").select("hashes", "counts").collect()  # one row a bucket, 2^24 entries together at most
    code = make_code(*(np.concatenate([np.empty(0, np.int64), *[unpack(r[c], np.int64) for r in triples]]) for c in ("hashes", "counts")))
    fits = np.flatnonzero(np.cumsum(sizes[::-1])[::-1] <= HEAD)
    least = 1 << int(fits[0]) if len(fits) else 1 << 62

    def frequent(batches):
        for batch in batches:
            for h, c in zip(batch.column("hashes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                k, n = unpack(h), unpack(c, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([pack(k[n >= least])], pa.binary()), pa.array([pack(n[n >= least])], pa.binary())], ["hashes", "counts"])

    top = vocab.where("bucket >= 0").select("hashes", "counts").mapInArrow(frequent, "hashes binary, counts binary").collect()
    head = np.concatenate([np.empty(0, np.uint64), *[unpack(r["hashes"]) for r in top]])
    head_counts = np.concatenate([np.empty(0, np.int64), *[unpack(r["counts"], np.int64) for r in top]])
    order = np.argsort(head)
    blocks = rows.mapInArrow(_fill(code), "block int, counts binary").groupBy("block").applyInArrow(_add_blocks, "block int, counts binary")
    counts = np.zeros((int(FIRST_SLOT[-1]) // BLOCK_SLOTS, BLOCK_SLOTS), np.uint32)
    for r in blocks.collect():  # as many rows as there are blocks of slots
        counts[r["block"]] = unpack(r["counts"], np.uint32)
    return Model(buckets, tokens, types, code, counts.reshape(-1), head[order], head_counts[order]), vocab


# --- scoring ------------------------------------------------------------------------------------


def mix(x: np.ndarray, bits: np.ndarray, gates: np.ndarray, counts: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log2 probabilities of the bits of documents that have `counts` decisions, from the predictors'
    log odds, and the weights at the end, a row a document and gate. Documents are taken side by side."""
    n = len(counts)
    order = np.argsort(-counts, kind="stable")
    first, left = (np.cumsum(counts) - counts)[order], counts[order]
    weights = np.tile(start.astype(np.float32), (n, 1))
    total, sign = np.zeros(n), np.float32(1) - np.float32(2) * bits
    # rows are gathered as one number of 16 bytes, and pairs are summed as complex numbers: numpy has fast loops for these
    rows, cells = np.ascontiguousarray(x).view(np.complex128).reshape(-1), weights.view(np.complex128).reshape(-1)
    pairs, ones = weights.view(np.complex64), np.ones(PREDICTORS, np.float32)
    done, most = 0, int(left[0]) if n else 0
    while done < most:
        step = min(max(done, FIRST_STEP), STEP)
        active = int(np.searchsorted(-left, -done, side="left"))  # those with more decisions than done
        take = np.minimum(left[:active] - done, step)
        begin = np.cumsum(take) - take
        at = np.arange(begin[-1] + take[-1]) + np.repeat(first[:active] + done - begin, take)
        cell = np.repeat(np.arange(active) * GATES, take) + gates[at]
        xs, s = rows[at].view(np.float32).reshape(-1, PREDICTORS), sign[at]
        e = (xs * cells[cell].view(np.float32).reshape(-1, PREDICTORS)) @ ones
        e *= s
        np.minimum(e, np.float32(60), out=e)
        np.exp(e, out=e)  # odds against what came
        more = 1 + e
        e /= more
        total[:active] += np.add.reduceat(np.log(more, out=more), begin, dtype=np.float64)
        e *= np.float32(-LEARN) * s
        for k in range(PREDICTORS):
            xs[:, k] *= e
        for k in range(PREDICTORS // 2):
            np.add.at(pairs[:, k], cell, xs.view(np.complex64)[:, k])
        done += step
    out = np.empty(n)
    out[order] = -total / np.log(2)
    return out, weights


def mix_bits(x: np.ndarray, bits: np.ndarray, gates: np.ndarray) -> float:
    """log2 probability of one document's bits."""
    return float(mix(x, bits, gates, np.array([len(bits)]), np.tile(START, (GATES, 1)))[0][0])


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Log odds of bit 1 of slots."""
    return _LOG[counts >> np.uint32(16)] - _LOG[counts & np.uint32(0xFFFF)]


def _ratio(n: np.ndarray) -> np.ndarray:
    """Log odds of bit 1 from counts of bit 0 and bit 1, one after another, which it overwrites."""
    np.maximum(n, 0, out=n)
    n += np.float32(PRIOR)
    odds = n[1::2] / n[::2]
    return np.log(odds, out=odds)


class Scorer:
    def __init__(self, model: Model):
        self.m = model
        self.all = log_odds(model.counts)
        self.left = model.counts.view(np.uint16).astype(np.float32)  # bit 0 and bit 1 of each slot, less what the document at hand has added: whole numbers below 2^24
        self.mine = np.zeros(len(self.left), np.int32)  # what that is, for a long one; zeros between documents
        self.start = np.tile(START, (GATES, 1))
        self.x, self.bits, self.gates = np.empty((0, PREDICTORS), np.float32), np.empty(0, np.uint8), np.empty(0, np.uint8)

    def reserve(self, n: int, used: int) -> None:
        """Room for the log odds, bits and gates of n decisions, of which the first `used` are there."""
        if n > len(self.bits):
            for name in ("x", "bits", "gates"):
                old = getattr(self, name)
                new = np.empty((n + n // 4, *old.shape[1:]), old.dtype)
                new[:used] = old[:used]
                setattr(self, name, new)

    def odds(self, d: Decisions) -> np.ndarray:
        """Log odds of bit 1."""
        x = np.empty(d.cells.shape, np.float32)
        for k in range(PREDICTORS):
            x[:, k] = self.all.take((d.cells[:, k] >> np.uint32(1)).astype(np.intp))
        return x

    def add(self, d: Decisions) -> None:
        # numpy's `at` is many times slower where a value isn't of the array's type
        np.add.at(self.mine, d.cells.reshape(-1).astype(np.intp), np.int32(1))

    def other_odds(self, d: Decisions) -> np.ndarray:
        """Log odds of bit 1, without what `mine` holds."""
        at = d.slots.reshape(-1)
        left = self.left.view(np.int64).take(at).view(np.float32) - self.mine.view(np.int64).take(at).view(np.int32)
        return _ratio(left.astype(np.float32)).reshape(-1, PREDICTORS)

    def own_odds(self, d: Decisions) -> np.ndarray:
        """Log odds of bit 1 for training documents, each without its own counts. One predictor after another, so that a
        document's cells stay in the processor's cache between the three visits."""
        x = np.empty(d.cells.shape, np.float32)
        left, one = self.left.view(np.int64), np.float32(1)
        ends, got = np.cumsum(d.counts).tolist(), np.empty(len(d.bits), np.int64)
        for k in range(PREDICTORS):
            cells = d.cells[:, k].astype(np.intp)
            slots, a = cells >> 1, 0
            for b in ends:
                mine = cells[a:b]
                np.subtract.at(self.left, mine, one)
                left.take(slots[a:b], out=got[a:b], mode="clip")
                np.add.at(self.left, mine, one)
                a = b
            x[:, k] = _ratio(got.view(np.float32))
        return x

    def log10(self, texts: list[bytes], own: bool) -> np.ndarray:
        out = np.zeros(len(texts))
        # texts of like lengths together, so that few steps have few texts
        short = sorted((i for i, t in enumerate(texts) if len(t) <= LONG), key=lambda i: len(texts[i]))
        for a, b in groups_of([texts[i] for i in short], many=MANY):
            counts, n = [], 0
            for d in all_decisions([texts[i] for i in short[a:b]], self.m.code):
                end = n + len(d.bits)
                self.reserve(end, n)
                self.x[n:end], self.bits[n:end], self.gates[n:end] = self.own_odds(d) if own else self.odds(d), d.bits, d.gates
                counts.append(d.counts)
                n = end
            out[short[a:b]] = mix(self.x[:n], self.bits[:n], self.gates[:n], np.concatenate(counts), self.start)[0]
        for i, t in enumerate(texts):
            if len(t) > LONG:
                for part, skip, ended in segments_of(t) if own else ():
                    self.add(decide([part], self.m.code, skip, ended))
                weights = self.start
                for part, skip, ended in segments_of(t):
                    d = decide([part], self.m.code, skip, ended)
                    bits, weights = mix(self.other_odds(d) if own else self.odds(d), d.bits, d.gates, d.counts, weights)
                    out[i] += bits[0]
                self.mine[:] = 0
        return out * np.log10(2)


DOC, REQUEST = 0, 1
SCORED = "kind int, bucket int, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, hashes binary, rows binary, counts binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]


def _score(sent):
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(batches):
        model: Model = sent.value
        scorer, row = Scorer(model), TaskContext.get().partitionId() << 40
        end = hash_words([END_WORD])
        for batch in sliced(batches, most=TEXTS):
            texts, held = texts_of(batch), batch.column("held_out").to_pylist()
            scores = np.zeros(len(texts))
            for own in (False, True):
                some = [i for i, h in enumerate(held) if h != own]
                if some:
                    scores[some] = scorer.log10([texts[i] for i in some], own)
            hashes, doc, word = words_of(batch.column("text"))
            hashes = np.concatenate([hashes, end])
            # each text's distinct words in order of texts, and how often
            ends = np.arange(len(texts)) * len(hashes) + len(hashes) - 1
            pairs, tf = np.unique(np.concatenate([doc * len(hashes) + word, ends]), return_counts=True)
            doc, word = np.divmod(pairs, len(hashes))
            at = np.minimum(np.searchsorted(model.head, hashes), max(0, len(model.head) - 1))
            frequent = model.head[at] == hashes if len(model.head) else np.zeros(len(hashes), bool)
            logs = np.log10(model.head_counts[at] + 1.0) if len(model.head) else np.zeros(len(hashes))
            known = frequent[word]
            per = lambda values, some: np.bincount(doc[some], values[some], len(texts))
            n_tokens, n_known = (per(tf, some).astype(np.int64).tolist() for some in (slice(None), known))
            base = per(tf * logs[word], known).tolist()
            ids = batch.column("doc_id").to_pylist()
            lost = np.array([8 * t.count(b"\0") * np.log10(2) for t in texts])
            rows = [(DOC, -1, row + i, ids[i], held[i], n_tokens[i], n_known[i], base[i], s, None, None, None) for i, s in enumerate((scores - lost).tolist())]
            h, r, t = hashes[word[~known]], row + doc[~known], tf[~known]
            row += len(texts)
            to = bucket_of(h, model.buckets)
            order = np.argsort(to, kind="stable")
            h, r, t = h[order], r[order], t[order].astype(np.int64)
            rows += [(REQUEST, b, None, None, None, None, None, None, None, pack(h[c]), pack(r[c]), pack(t[c])) for b, c in _cells(to[order])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)

    return run


def _look_up(data: pa.Table) -> pa.Table:
    """One bucket: its words' counts and the requests for them; (row, base, n_known)."""
    rows = data.to_pylist()
    keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for r in rows:
        if r["rows"] is None:
            keys, counts = unpack(r["hashes"]), unpack(r["counts"], np.int64)
    asks = [r for r in rows if r["rows"] is not None]
    out = {"row": np.empty(0, np.int64), "base": np.empty(0), "n_known": np.empty(0, np.int64)}
    if asks and len(keys):
        h = np.concatenate([unpack(r["hashes"]) for r in asks])
        ref = np.concatenate([unpack(r["rows"], np.int64) for r in asks])
        tf = np.concatenate([unpack(r["counts"], np.int64) for r in asks])
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        ok = keys[at] == h
        u, where = np.unique(ref[ok], return_inverse=True)
        out = {"row": u, "base": np.bincount(where, tf[ok] * np.log10(counts[at[ok]] + 1.0), len(u)).astype(float), "n_known": np.bincount(where, tf[ok], len(u)).astype(np.int64)}
    return pa.table(out)


def language_scores(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, and bits_per_byte's parts."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    model, vocab = train(docs.where("not held_out"), 4 * partitions(spark))
    sent = spark.sparkContext.broadcast(model)
    scored = stored(docs.mapInArrow(_score(sent), SCORED), "lm-scored")
    asks = scored.where(F.col("kind") == REQUEST).select("bucket", "hashes", "rows", "counts")
    words = vocab.where("bucket >= 0").select("bucket", "hashes", F.lit(None).cast("binary").alias("rows"), "counts")
    tail = asks.unionAll(words).groupBy("bucket").applyInArrow(_look_up, "row long, base double, n_known long")
    tail = tail.groupBy("row").agg(F.sum("base").alias("tail_base"), F.sum("n_known").alias("tail_known"))
    out = scored.where(F.col("kind") == DOC).select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score").join(tail, "row", "left")
    unit = float(np.log10(model.tokens + model.types + 1))
    base = F.col("base") + F.coalesce("tail_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"))
