r"""Importance resampling towards a target corpus, by hashed word runs.

Features are all runs of one and two consecutive words; each falls into one of BUCKETS by its CRC. A bucket's
gain says how much commoner it is in the target than in the corpus, a document's weight is the mean gain
of its features, and the documents with the highest weight plus Gumbel noise are drawn, which is sampling
without replacement in proportion to the exponential of the weights.

1. In a task, Arrow kernels lower-case, split, flatten and dictionary-encode some megabytes of whole texts.
   Dictionary indices, shifted by one, make pairs; each distinct word and pair is hashed once and its
   bucket taken back to all places. A task sends BUCKETS counts at most, whatever it read.
2. Counts are summed by Spark; the gains, BUCKETS integers, go with the second pass's tasks, where
   segments of gains are summed a document.
3. The cut is found from counted scores: integers between bounds that the logarithms set, below 200,000 values for
   any corpus. Only what reaches the cut is range-partitioned and sorted; a row's rank is its place plus
   the rows of the ranges before. No window spans all rows.

Rows: null and empty texts have no words, no features and weight 0; texts of fewer than LEAST words are scored
but never drawn; rows with equal doc_ids get the same noise and each a row and a rank; the noise of a null id is that of an empty
one, and it comes after all ids in a tie; an empty corpus gives no rows, an empty target gains from
the corpus alone; target rows may repeat. Extra columns are not read.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, partitions, sliced, stored, table

BUCKETS, LEAST, PERCENT, SEED = 10_000, 20, 25, 7
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCORED = "_row long, doc_id long, n_words long, n_features long, weight long"


def features(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word its document and bucket; of each pair of words its document and bucket."""
    # taken whole: some kernels read a slice from the start of the array below it
    own = pc.take(pc.fill_null(texts, ""), pa.array(np.arange(len(texts)))).cast(pa.large_string())
    split = pc.split_pattern_regex(pc.ascii_lower(own), pattern=_BETWEEN)
    words = pc.list_flatten(split)
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    some = pc.not_equal(words, "")
    encoded = pc.dictionary_encode(words.filter(some))
    doc = doc[some.to_numpy(zero_copy_only=False)]
    at = encoded.indices.to_numpy().astype(np.int64)
    known = encoded.dictionary.cast(pa.large_binary()).to_pylist()
    of_word = np.array([zlib.crc32(w) for w in known], np.int64)
    after_space = [zlib.crc32(w + b" ") for w in known]
    inside = doc[1:] == doc[:-1]
    pairs, where = np.unique(at[:-1][inside] * max(1, len(known)) + at[1:][inside], return_inverse=True)
    first, second = np.divmod(pairs, max(1, len(known)))
    of_pair = np.array([zlib.crc32(known[b], after_space[a]) for a, b in zip(first.tolist(), second.tolist(), strict=True)], np.int64)
    return doc, of_word[at] % buckets, doc[1:][inside], of_pair[where] % buckets


def _counts(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches):
            _, words, _, pairs = features(batch.column("text"), buckets)
            total += np.bincount(words, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    rows = docs.select("text").mapInArrow(_counts(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much commoner a bucket is in the target, floored."""
    s, t = float(corpus.sum() + len(corpus)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((b + 1) * s / ((a + 1) * t))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _sums(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Segment sums of values whose documents ascend."""
    out = np.zeros(n, np.int64)
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[first]] = np.add.reduceat(values, first)
    return out


def _weights(gain: np.ndarray):
    def run(batches):
        for batch in sliced(batches):
            n = batch.num_rows
            doc, words, doc2, pairs = features(batch.column("text"), len(gain))
            n_words, n_pairs = np.bincount(doc, minlength=n), np.bincount(doc2, minlength=n)
            total, count = _sums(doc, gain.take(words), n) + _sums(doc2, gain.take(pairs), n), n_words + n_pairs
            weight = np.floor_divide(total, np.maximum(count, 1))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in (n_words, count, weight)]], [x.split()[0] for x in SCORED.split(", ")])

    return run


def scored(rows: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """rows: _row, doc_id, text. With n_words, n_features, weight and score, weight plus noise by doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    found = rows.select("_row", "doc_id", "text").mapInArrow(_weights(gain), SCORED)
    return found.withColumn("score", (F.col("weight") + noise).cast("long"))


def ranked(found: DataFrame, least: int = LEAST, percent: int = PERCENT) -> DataFrame:
    """The scored rows, of which those of at least `least` words are drawn by score: `percent` of a hundred,
    rounded down, with rank; the others' is null."""
    found = stored(found, "resample-scores")
    able = F.col("n_words") >= least
    by_score = found.where(able).groupBy("score").count().orderBy(F.desc("score")).collect()
    most = percent * sum(r["count"] for r in by_score) // 100
    cut, have = None, 0
    for r in by_score:
        if have < most:
            cut, have = r["score"], have + r["count"]
    if cut is None:
        return found.withColumn("rank", F.lit(None).cast("long"))
    reach = able & (F.col("score") >= cut)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    dealt = found.where(reach).repartitionByRange(partitions(found.sparkSession), *order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id()), "resample-drawn")
    part = F.shiftright("_at", 33)
    sizes = dict(dealt.groupBy(part.alias("part")).count().collect())  # as many as there are partitions
    before, start = [], 0
    for p in sorted(sizes):
        before.append((p, start))
        start += sizes[p]
    starts = found.sparkSession.createDataFrame(before, "_part long, _before long")
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    drawn = dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", F.when(rank <= most, rank))
    return found.where(~reach).withColumn("rank", F.lit(None).cast("long")).unionByName(drawn.select(*found.columns, "rank"))


def importance(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Per row of docs: _row (see `resampled`), doc_id, n_words, n_features, weight, score, rank."""
    gain = gains(bucket_counts(docs), bucket_counts(target))
    return ranked(scored(keyed(docs.select("doc_id", "text"), "_row", "resample-rows"), gain))


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The drawn rows of docs, with all their columns."""
    rows = keyed(docs, "_resample_row", "resample-rows")
    gain = gains(bucket_counts(docs), bucket_counts(target))
    drawn = ranked(scored(rows.select(F.col("_resample_row").alias("_row"), "doc_id", "text"), gain)).where("rank is not null")
    return rows.join(drawn.select(F.col("_row").alias("_resample_row")), "_resample_row", "left_semi").select(*docs.columns)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_HEX = "instr('0123456789ABCDEF', substr(h, 2 * i + {}, 1)) - 1"
ORACLE_SQL = f"""
WITH RECURSIVE bits AS (SELECT n, list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM (SELECT unnest(range(256))::BIGINT AS n)),
w AS (SELECT true AS ours, doc_id, {_WORDS} AS w FROM documents UNION ALL SELECT false, NULL, {_WORDS} FROM benchmark),
x AS (SELECT ours, doc_id, f, count(*) AS n FROM (SELECT ours, doc_id, unnest(list_concat(w, [w[i] || ' ' || w[i + 1] FOR i IN range(1, greatest(1, len(w)))])) AS f FROM w) GROUP BY ALL),
e AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM x)),
r AS (SELECT f, h, 0 AS i, 4294967295::BIGINT AS c FROM e UNION ALL SELECT f, h, i + 1, xor(c >> 8, v) FROM r JOIN bits ON n = xor(c & 255, 16 * ({_HEX.format(1)}) + {_HEX.format(2)}) WHERE 2 * i < len(h)),
k AS (SELECT f, xor(c, 4294967295) % {BUCKETS} AS b FROM r WHERE 2 * i = len(h)),
c AS (SELECT b, coalesce(sum(n) FILTER (ours), 0) AS s, coalesce(sum(n) FILTER (NOT ours), 0) AS t FROM x JOIN k USING (f) GROUP BY b),
g AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM c) + {BUCKETS})::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM c) + {BUCKETS})::DOUBLE))) AS gain FROM c),
d AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM x JOIN k USING (f) JOIN g USING (b) WHERE ours GROUP BY doc_id),
h AS (SELECT doc_id, len(w) AS n_words, sha256('{SEED}:' || doc_id) AS z FROM w WHERE ours),
p AS (SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(z, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h LEFT JOIN d USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM p WHERE n_words >= {LEAST})
SELECT p.doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * n // 100 THEN rank END::BIGINT AS rank FROM p LEFT JOIN o USING (doc_id)
"""
