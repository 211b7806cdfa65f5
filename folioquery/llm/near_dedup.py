r"""Near-duplicates by SetSketch registers.

A document's set is its distinct k-word shingles. Each of M registers holds the exponentially spaced,
truncated minimum of one hash over the set: floor(1 - log_b(x / A)), x an exponential variable, cut to
[0, Q + 1]. Registers of a union are the larger ones of the parts, so sketches merge, and two sets
agree in a register with about the probability of their similarity.

1. Documents with equal sets form a class (hash of the sorted set); one stands for all.
2. Bands of ROWS registers are bucket keys. Every member of a bucket meets the bucket's smallest
   member: links in number of members, not pairs.
3. Of each such pair the similarity is estimated jointly by maximum likelihood from the numbers of
   larger, smaller and equal registers and both set sizes; pairs far below the threshold are left.
4. The others are confirmed on the full sets; components are taken of what is confirmed.
5. Exact way for the rest: groups of documents that meet in buckets, directly or over others, and
   are not in one component by then are cut into blocks. Block against block, all intersections are
   counted exactly, and one link is reported for any two components that have one. So every pair that
   shares a bucket is linked if it should be, whatever the bucket's size, and no list of pairs is made.

With t the threshold, a linked pair misses all bands with probability (1 - t^ROWS)^(M / ROWS): about
4e-7 at 0.85 and 5e-5 at 0.8; pairs of similarity 0.3 meet with probability 0.06.

Rows: null and empty texts, and those without words, have empty sets and are linked with nothing;
texts of fewer than k words are one shingle; equal texts are one class whatever their number; equal
doc_ids count as one document when linking and each get a row; a null doc_id gets a row of its own
without links. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gram_hashes, hash_words, mix64, narrow_to, signed, sliced, stored, table, texts_of
from .graph import connected_components

M, ROWS = 125, 5
B, A, Q = 1.001, 20.0, 65534
#: Standard deviations below the threshold at which an estimate still counts as possible.
SLACK = 5.5
#: Most members, and about as many elements, of a block.
BLOCK, BLOCK_ELEMENTS = 1024, 1 << 21
_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 1 << 32, M, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, M, dtype=np.uint64).astype(np.uint32)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a text."""
    words = hash_words(text.lower().split())
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < k:
        return gram_hashes(words, len(words), seed=0xC2B2AE3D27D4EB4F + len(words))
    return np.unique(gram_hashes(words, k))


def registers(elements: np.ndarray) -> np.ndarray:
    """The SetSketch of a non-empty set of hashes."""
    x = (elements >> np.uint64(32)).astype(np.uint32)
    least = np.full(M, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[None, i : i + 1024] * _MUL[:, None] + _ADD[:, None]).min(axis=1), out=least)
    rate = -np.log1p(-(least + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(rate / A) / np.log(B)), 0, Q + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    rows = regs.reshape(-1, ROWS).astype(np.uint64)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(ROWS):
        key = mix64(key + rows[:, i])
    return key


def _log_p(x: np.ndarray) -> np.ndarray:
    """log of p_b(x) = -log_b(1 - x (b - 1) / b)."""
    return np.log(np.maximum(-np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B), 1e-12))


_GRID = np.linspace(0, 1, 201)


def similarity(more: np.ndarray, less: np.ndarray, n_u: np.ndarray, n_v: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimates from the numbers of registers that are larger and smaller
    in u than in v, for sets of n_u and n_v elements."""
    u = (n_u / (n_u + n_v))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = _GRID[None, :] * top
    up, down = np.exp(_log_p(u - v * j)), np.exp(_log_p(v - u * j))
    same = np.log(np.maximum(1 - up - down, 1e-12))
    like = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (M - more - less)[:, None] * same
    return _GRID[like.argmax(axis=1)] * top[:, 0]


def may_link(ru: np.ndarray, rv: np.ndarray, nu: np.ndarray, nv: np.ndarray, percent: int) -> np.ndarray:
    """Which of the pairs of sketches may have the similarity asked for."""
    t = percent / 100
    ok = 100 * np.minimum(nu, nv) >= percent * np.maximum(nu, nv)
    at = np.flatnonzero(ok)
    if len(at):
        more, less = (ru[at] > rv[at]).sum(axis=1), (ru[at] < rv[at]).sum(axis=1)
        ok[at] = similarity(more, less, nu[at].astype(float), nv[at].astype(float)) >= t - SLACK * np.sqrt(t * (1 - t) / M)
    return ok


def _sketch(k: int):
    def run(batches):
        for batch in sliced(batches):
            n, hi, lo, regs, bands = [], [], [], [], []
            for text in texts_of(batch):
                s = shingle_set(text, k)
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                hi.append(digest >> 64)
                lo.append(digest & ((1 << 64) - 1))
                r = registers(s) if len(s) else None
                regs.append(None if r is None else r.tobytes())
                bands.append([] if r is None else signed(band_keys(r)))
            u64 = lambda x: pa.array(signed(np.array(x, np.uint64)), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), u64(hi), u64(lo), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "hi", "lo", "regs", "bands"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shingle_set(t, k).tobytes() for t in texts_of(batch)], pa.binary())], ["doc_id", "elements"])

    return run


def _regs(batch, column):
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), np.uint16).reshape(-1, M)


def _possible(percent: int):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ok = may_link(_regs(batch, "ra"), _regs(batch, "rb"), *[batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb")], percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            keep, last, right = [], None, None
            for b, x, y in zip(*[batch.column(c).to_pylist() for c in ("b", "ea", "eb")], strict=True):
                if b != last:
                    last, right = b, np.frombuffer(y, np.uint64)
                left = np.frombuffer(x, np.uint64)
                small, large = (left, right) if len(left) < len(right) else (right, left)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(100 * both >= percent * (len(left) + len(right) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def common_elements(left: list[np.ndarray], right: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Intersection sizes of all left sets with all right ones, by products of 0/1 matrices over a few
    thousand elements at a time."""
    ids = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    order = np.argsort(ids, kind="stable")
    ids, owner = ids[order], owner[order]
    new = np.concatenate([[True], ids[1:] != ids[:-1]])
    alone = new & np.concatenate([new[1:], [True]])  # an element of one set only is in no intersection
    column = np.cumsum(new[~alone]) - 1
    owner = owner[~alone]
    out = np.zeros((len(left), len(right)), np.float32)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(column, column[first] + columns))
        cells = np.zeros((len(left) + len(right), int(column[last - 1] - column[first]) + 1), np.float32)
        cells[owner[first:last], column[first:last] - column[first]] = 1
        out += cells[: len(left)] @ cells[len(left) :].T
        first = last
    return out


def _block_links(percent: int):
    """Of two blocks of a group: one link between any two labels that have links."""

    def run(data: pa.Table) -> pa.Table:
        data = data.combine_chunks()
        node, label, part = (data.column(c).to_numpy() for c in ("node", "label", "part"))
        sets = [np.frombuffer(x, np.uint64) for x in data.column("elements").to_pylist()]
        i, j = data.column("i")[0].as_py(), data.column("j")[0].as_py()
        rows, cols = np.flatnonzero(part == i), np.flatnonzero(part == j)
        found: dict[tuple[int, int], tuple[int, int]] = {}
        if len(rows) and len(cols):
            both = common_elements([sets[r] for r in rows], [sets[c] for c in cols])
            n = np.array([len(x) for x in sets], np.float32)
            linked = (100 * both >= percent * (n[rows][:, None] + n[cols][None, :] - both)) & (label[rows][:, None] != label[cols][None, :])
            for r, c in zip(*np.nonzero(linked), strict=True):
                a, b = rows[r], cols[c]
                found[min(label[a], label[b]), max(label[a], label[b])] = (int(max(node[a], node[b])), int(min(node[a], node[b])))
        return pa.table({"a": pa.array([x for x, _ in found.values()], pa.int64()), "b": pa.array([y for _, y in found.values()], pa.int64())})

    return run


def confirm(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets have the similarity. Only texts that are in
    a pair are moved; their sets are stored once."""
    pairs = stored(pairs, "near-pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = narrow_to(docs.select("doc_id", "text"), ids).mapInArrow(_sets(k), "doc_id long, elements binary")
    sets = stored(sets, "near-sets").dropDuplicates(["doc_id"])
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb")), "b")
    return stored(both.select("a", "b", "ea", "eb").mapInArrow(_confirmed(percent), "a long, b long"), "near-links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept. Documents are linked
    where 100 * intersection >= percent * union."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = stored(docs.mapInArrow(_sketch(k), "doc_id long, n long, hi long, lo long, regs binary, bands array<long>"), "near-sketches")
    full = sk.where("n > 0 and doc_id is not null")
    # equal sets have equal sketches: any of them will do
    classes = full.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    reps = full.join(classes.select(F.col("rep").alias("doc_id"), F.col("hi").alias("h"), F.col("lo").alias("l")), "doc_id").where("hi = h and lo = l")
    reps = stored(reps.select(F.col("doc_id").alias("rep"), "n", "regs", "bands").dropDuplicates(["rep"]), "near-reps")
    bands = reps.select("rep", F.explode("bands").alias("key"))
    buckets = stored(bands.groupBy("key").agg(F.min("rep").alias("first"), F.count(F.lit(1)).alias("members")).where("members > 1"), "near-buckets")
    firsts = bands.join(buckets, "key").where("rep != first").select(F.col("rep").alias("a"), F.col("first").alias("b")).distinct()
    firsts = stored(firsts, "near-firsts")
    sketch = lambda c, r, n: reps.select(F.col("rep").alias(c), F.col("regs").alias(r), F.col("n").alias(n))
    met = firsts.join(sketch("a", "ra", "na"), "a").join(sketch("b", "rb", "nb"), "b")
    links = confirm(met.mapInArrow(_possible(percent), "a long, b long"), docs, k, percent)
    labels = stored(connected_components(links), "near-labels")

    # groups of documents that meet in buckets, directly or not, and are in several components by now
    groups = stored(connected_components(firsts), "near-groups").join(reps.select(F.col("rep").alias("node"), "n"), "node")
    groups = groups.withColumnRenamed("label", "group").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = stored(groups, "near-members")
    mixed = groups.groupBy("group").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("elements"))
    mixed = mixed.where("least != most and members > 2").select("group", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("elements") / BLOCK_ELEMENTS)).cast("int").alias("parts"))
    rest = stored(groups.select("node", "group", "label").join(mixed, "group"), "near-rest")
    if not rest.isEmpty():
        sets = narrow_to(docs, rest.select(F.col("node").alias("doc_id"))).mapInArrow(_sets(k), "doc_id long, elements binary").dropDuplicates(["doc_id"])
        rest = rest.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).join(sets.withColumnRenamed("doc_id", "node"), "node")
        rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rest = rest.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other")).select("group", "i", "j", "node", "label", "part", "elements")
        more = stored(rest.groupBy("group", "i", "j").applyInArrow(_block_links(percent), "a long, b long"), "near-more")
        labels = stored(connected_components(links.unionAll(more)), "near-labels")

    # classes that need no label or have no copies stay out of the joins
    named = classes.join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left").where("copies > 1 or label is not null")
    named = named.select(F.col("hi").alias("h"), F.col("lo").alias("l"), F.coalesce("label", "rep").alias("component"))
    out = sk.select("doc_id", "n", "hi", "lo").join(named, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM d
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(c) AS component_id, s.doc_id = min(c) AS kept
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id, sh
"""
