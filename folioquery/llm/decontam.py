"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of benchmark items. For each pattern length a shift table, indexed by the
hash of a block of words, says how far a scan may move on when it sees that block; only where the
shift is zero do the buckets, by the hashes of a window's last block and of its first, name patterns,
which are then compared word by word.

The patterns are a stated query set: they are broadcast in groups of at most `PATTERN_BYTES` of text,
each of which makes one pass over the documents and is collected when its pass begins, so no
broadcast exceeds that bound, and a worker holds about seven times as much.

Rows: a null or empty text has no words and hits nothing; null item texts have no windows and null
item ids name nothing: `contamination` leaves their items out, as its SQL does, and `uncontaminated`,
which names no items, searches their windows too; items with equal texts all count; repeated documents each get a row; empty
tables give rows without hits, or no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_words, mix64, sliced, stored, table, texts_of

WINDOW = 10
#: Words of a block, and entries of a shift table (a power of two).
BLOCK, SHIFTS = 2, 1 << 18
#: Most bytes of benchmark text that one pass searches for.
PATTERN_BYTES = 8 << 20
#: Cursors that go over a slice of text side by side.
LANES = 1024

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` on bytes: these become spaces, A-Z lower case.
_SEPARATORS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
_FOLD = bytes.maketrans(_SEPARATORS, b" " * len(_SEPARATORS))
SUMMED = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string"
HITS = "doc_id long, n_words long, spans binary, items array<string>"


def bench_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).lower().split()


class _Length:
    """Tables for the patterns of one length m: windows of the items' words, by where they start."""

    def __init__(self, m: int, words: np.ndarray, starts: np.ndarray):
        self.m, self.block = m, min(BLOCK, m)
        self.shift = np.full(SHIFTS, m - self.block + 1, np.int32)
        for end in range(self.block, m + 1):
            np.minimum.at(self.shift, self._slot(words, starts + end - 1), m - end)
        keys = self._bucket(words, starts)
        order = np.argsort(keys, kind="stable")
        self.keys, self.starts = keys[order], starts[order]

    def _block(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the blocks whose last words are at `ends`."""
        h = words[ends].copy()
        for back in range(1, self.block):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[ends - back]
        return mix64(h)

    def _slot(self, words, ends):
        return (self._block(words, ends) & np.uint64(SHIFTS - 1)).astype(np.int64)

    def _bucket(self, words, starts):
        """By the hashes of a window's last block and of its first."""
        return self._block(words, starts + self.m - 1) * np.uint64(0x2545F4914F6CDD1D) + self._block(words, starts + self.block - 1)

    def find(self, words: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows may begin in words, and in the items. LANES cursors go over as many parts of
        the text side by side, each as far as the shift of the block it sees allows."""
        n = len(words) - self.m + 1
        if n <= 0 or not len(self.starts):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lanes = min(LANES, n)
        edge = self.m - 1 + np.arange(lanes + 1) * n // lanes
        at, stop, zero = edge[:-1].copy(), edge[1:], []
        while len(at):
            step = self.shift[self._slot(words, at)]
            hit = step == 0
            if hit.any():
                zero.append(at[hit] - self.m + 1)
                step[hit] = 1
            at += step
            going = at < stop
            at, stop = at[going], stop[going]
        if not zero:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        begin = np.sort(np.concatenate(zero))
        keys = self._bucket(words, begin)
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, side="right")
        count = high - low
        begin = np.repeat(begin, count)
        pattern = self.starts[np.repeat(low, count) + np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)]
        same = np.ones(len(begin), bool)
        for i in range(self.m):
            same &= words[begin + i] == items[pattern + i]
        return begin[same], pattern[same]


class Searcher:
    """Finds the windows of items (id, words) in texts. What it holds is arrays: about seven bytes for
    each byte of the items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.names = [i for i, _ in items]
        sizes = np.array([len(w) for _, w in items], np.int64)
        self.first = np.cumsum(sizes) - sizes  # of each item's words
        parts = [hash_words(w) for _, w in items]
        self.words = np.concatenate([np.empty(0, np.uint64), *parts])
        self.text = b"".join(b" ".join(w) + b" " for _, w in items if w)
        self.ends = np.cumsum([0, *(len(x) + 1 for _, w in items for x in w)])  # bytes before each word
        starts: dict[int, list[np.ndarray]] = defaultdict(list)
        for a, n in zip(self.first.tolist(), sizes.tolist(), strict=True):
            if n:
                starts[min(window, n)].append(np.arange(a, a + max(1, n - window + 1)))
        self.lengths = [_Length(m, self.words, np.concatenate(s)) for m, s in sorted(starts.items())]

    def search_all(self, texts: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], set[str | None]]]:
        """Of each text (its words): spans [start, end) of occurrences, and the items they are from."""
        gap = np.zeros(1, np.uint64)  # a word that no item has stands between texts
        words = np.concatenate([gap, *[x for t in texts for x in (hash_words(t), gap)]])
        first = np.cumsum([1, *[len(t) + 1 for t in texts]])
        found: list[tuple[list[tuple[int, int]], set[str | None]]] = [([], set()) for _ in texts]
        for length in self.lengths:
            begin, pattern = length.find(words, self.words)
            doc = np.searchsorted(first, begin, side="right") - 1
            item = np.searchsorted(self.first, pattern, side="right") - 1
            for b, p, d, i in zip(begin.tolist(), pattern.tolist(), doc.tolist(), item.tolist(), strict=True):
                a = b - int(first[d])
                # the words themselves
                if b" ".join(texts[d][a : a + length.m]) == self.text[self.ends[p] : self.ends[p + length.m] - 1]:
                    found[d][0].append((a, a + length.m))
                    found[d][1].add(self.names[i])
        return found


def _search_all(sent, window):
    def run(batches):
        searcher = Searcher([(i, bench_words(t.encode())) for i, t in sent.value], window)
        for batch in sliced(batches):
            texts = [bench_words(t) for t in texts_of(batch)]
            found = searcher.search_all(texts)
            counts, spans, items = [len(t) for t in texts], [np.asarray(sorted(set(s)), np.int32).tobytes() for s, _ in found], [sorted(f) for _, f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])

    return run


def _summed(batches):
    for batch in batches:
        out = {"n_hit": [], "n_items": [], "items_sha256": []}
        for parts, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            spans = np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2)
            hit, end = 0, 0
            for a, b in sorted(map(tuple, spans.tolist())):
                hit, end = hit + max(0, b - max(a, end)), max(end, b)
            ids = sorted({i for part in items for i in part})
            out["n_hit"].append(hit)
            out["n_items"].append(len(ids))
            out["items_sha256"].append(hashlib.sha256(",".join(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(out["n_hit"], pa.int64()), pa.array(out["n_items"], pa.int64()), pa.array(out["items_sha256"])], ["doc_id", "n_words", *out])


def pattern_groups(benchmark: DataFrame, pattern_bytes: int = PATTERN_BYTES, unnamed: bool = False) -> tuple[int, Callable[[int], Broadcast]]:
    """How many groups of about pattern_bytes at most the items make, at least one, and a function that
    broadcasts the items (id, text) of a group, one group at a time; `unnamed`: with those whose id is null."""
    items = benchmark.where("text is not null" if unnamed else "item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    rounds = max(1, -(-size // pattern_bytes))

    def group(r: int) -> Broadcast:
        found = items.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r).collect()
        return benchmark.sparkSession.sparkContext.broadcast([tuple(x) for x in found])

    return rounds, group


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rounds, group = pattern_groups(benchmark, pattern_bytes)
    rows = docs.select("doc_id", "text")
    if rounds == 1:
        found = rows.mapInArrow(_search_all(group(0), window), HITS)
        found = found.select("doc_id", "n_words", F.array("spans").alias("spans"), F.array("items").alias("items"))
        out = found.mapInArrow(_summed, SUMMED)
    else:  # a key tells repeated rows apart when the passes are put together; hits alone are stored
        rows = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "decontam-rows")
        found = None
        for r in range(rounds):
            part = rows.select(F.col("_row").alias("doc_id"), "text").mapInArrow(_search_all(group(r), window), HITS)
            part = stored(part if r == 0 else part.where(F.size("items") > 0), "decontam-hits")
            found = part if found is None else found.unionAll(part)
        found = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
        out = found.mapInArrow(_summed, SUMMED).withColumnRenamed("doc_id", "_row").join(rows.select("doc_id", "_row"), "_row")
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """The rows of docs, whole and unchanged, in which no window of the benchmark occurs: a narrow
    stage for each group of patterns."""

    def without(sent):
        def run(batches):
            searcher = Searcher([(i, bench_words(t.encode())) for i, t in sent.value], window)
            for batch in sliced(batches):
                found = searcher.search_all([bench_words(t) for t in texts_of(batch)])
                yield batch.filter(pa.array([not spans for spans, _ in found], pa.bool_()))

        return run

    rounds, group = pattern_groups(benchmark, pattern_bytes, unnamed=True)
    for r in range(rounds):
        docs = docs.mapInArrow(without(group(r)), docs.schema)
        if r + 1 < rounds:
            docs = stored(docs, "decontam-left")
    return docs


def op6_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, least({WINDOW}, len(w)) AS m, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM bw),
ms AS (SELECT DISTINCT m FROM p),
dw AS (SELECT doc_id, w, ms.m AS m, unnest(range(1, len(w) - ms.m + 2)) AS i FROM d, ms WHERE len(w) >= ms.m),
o AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM dw),
hits AS (SELECT doc_id, i, m, item_id FROM o JOIN p USING (m, k)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM (SELECT DISTINCT doc_id, i, m FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
