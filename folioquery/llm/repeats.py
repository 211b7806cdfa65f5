r"""Substring dedup with a log-structured index of window fingerprints.

Every run of `WINDOW` words is fingerprinted by the least hash of its `GRAM`-word runs, so windows
side by side mostly share a fingerprint and the index has about a fifth of an entry a word, yet equal
windows always have equal fingerprints.

1. Batch by batch, fingerprints are flushed as an immutable run: per bucket (a range of hashes) one
   sorted block, in a table bucketed by it. The new run is merge-joined with each earlier one, bucket by
   bucket, without moving these; whoever holds a fingerprint that another document holds too becomes a
   participant. When FANOUT runs of one size stand side by side, one compacted run takes their place.
   The index lies in one folder and can be opened again.
2. Verification: participants alone are read again, and what loses words once more. Of their windows with a shared fingerprint the
   full window is hashed anew, twice, and the smallest doc_id of each pair of hashes is found, bucket by bucket.
3. Words covered by a window that starts in a smaller doc_id are removed.

Map-side, equal fingerprints of TOGETHER bytes of documents are combined before the shuffle: one posting each,
so a passage that a third of all documents share costs one entry for these, not one a document. Buckets
grow with `spark.sql.shuffle.partitions`; arrays travel as byte planes, which compress well.

Rows: null and empty texts and those of fewer than `WINDOW` words lose nothing; repeats inside one
document stay; rows with equal doc_ids never remove each other's words and each get a row; a null
doc_id neither removes nor loses anything; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gram_hashes, hash_words, mix64, narrow_to, partitions, sliced, stored, table, texts_of, work_dir
from .quality import covered_by

WINDOW, GRAM = 13, 6
#: Runs of one size that are merged into one.
FANOUT = 4
#: Bytes of texts whose equal keys are combined before the shuffle: bounds a task's arrays.
TOGETHER = 8 << 20
_POSTINGS, _HOLDERS = 0, 1
RUN = "bucket int, kind int, keys binary, docs binary, shared binary"
#: Of holders, `bucket` is a group of documents; of postings, a range of hashes. A run's table is
#: bucketed by `at`, the range of hashes of either.
RUN_AT = f"{RUN}, at int"
_FIELDS = [x.split()[0] for x in RUN.split(", ")]


def pack(x: np.ndarray) -> bytes:
    """64-bit values as byte planes."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(kind)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, so what is sorted by hash is sorted by bucket."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def fingerprints(words: np.ndarray) -> np.ndarray:
    """One for each window of the hashed words."""
    grams = gram_hashes(words, GRAM)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least, have = grams, 1  # minima over doubling widths
    width = WINDOW - GRAM + 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least[:n]


def _least_by_key(keys: np.ndarray, docs: np.ndarray, check: np.ndarray | None = None):
    """Sorted distinct keys with their least docs, how many entries each has, and, for the entries in
    order of key, their order and group. With `check`, keys are pairs of both."""
    order = np.argsort(keys, kind="stable") if check is None else np.lexsort((check, keys))
    k = keys[order]
    new = k[1:] != k[:-1]
    if check is not None:
        new |= check[order][1:] != check[order][:-1]
    first = np.flatnonzero(np.concatenate([[True], new])) if len(k) else np.empty(0, np.int64)
    least = np.minimum.reduceat(docs[order], first) if len(k) else docs
    count = np.diff(np.append(first, len(k)))
    return k[first], least, count, order, np.repeat(np.arange(len(first)), count)


def _cells(bucket: np.ndarray):
    """(bucket, slice) of each run of equal values."""
    if len(bucket):
        edge = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            yield int(bucket[a]), slice(int(a), int(b))


def _run_rows(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "kind", "keys", "docs", "shared"])


def _by_doc(docs: np.ndarray, buckets: int) -> np.ndarray:
    """Groups of documents, half as many as buckets."""
    mixed = docs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return bucket_of(mixed ^ (mixed >> np.uint64(29)), max(1, buckets // 2))


def _holder_rows(keys: np.ndarray, docs: np.ndarray, buckets: int):
    to = _by_doc(docs, buckets)
    order = np.argsort(to, kind="stable")
    keys, docs = keys[order], docs[order]
    for b, cut in _cells(to[order]):
        yield b, _HOLDERS, pack(keys[cut]), pack(docs[cut]), b""


def _flush(buckets: int):
    def run(batches):
        for batch in sliced(batches, most=TOGETHER):
            keys, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                words = text.split()
                if len(words) >= WINDOW:
                    keys.append(np.unique(fingerprints(hash_words(words))))
                    docs.append(np.full(len(keys[-1]), doc_id, np.int64))
            keys, docs = np.concatenate(keys), np.concatenate(docs)
            k, least, count, order, group = _least_by_key(keys, docs)
            shared = (count > 1).astype(np.uint8)
            rows = [(b, _POSTINGS, pack(k[c]), pack(least[c]), shared[c].tobytes()) for b, c in _cells(bucket_of(k, buckets))]
            held = order[shared[group] > 0]
            made = _run_rows(rows + list(_holder_rows(keys[held], docs[held], buckets)))
            yield pa.RecordBatch.from_arrays([*made.columns, made.column("bucket")], [*made.schema.names, "at"])

    return run


def _gather(buckets: int):
    """One bucket of a batch, from all its tasks: a sorted block of postings, and holders."""

    def run(data: pa.Table) -> pa.Table:
        rows = data.to_pylist()
        posts = [r for r in rows if r["kind"] == _POSTINGS]
        out = [(r["bucket"], _HOLDERS, r["keys"], r["docs"], b"") for r in rows if r["kind"] == _HOLDERS]
        if posts:
            keys = np.concatenate([unpack(r["keys"]) for r in posts])
            docs = np.concatenate([unpack(r["docs"], np.int64) for r in posts])
            flag = np.concatenate([np.frombuffer(r["shared"], np.uint8) for r in posts])
            k, least, count, order, group = _least_by_key(keys, docs)
            found = order[(count[group] > 1) & (flag[order] == 0)]
            out += _holder_rows(keys[found], docs[found], buckets)
            out.append((rows[0]["at"], _POSTINGS, pack(k), pack(least), b""))
        made = pa.Table.from_batches([_run_rows(out)])
        return made.append_column("at", pa.array([rows[0]["at"]] * made.num_rows, pa.int32()))

    return run


def _meet(buckets: int):
    """Rows with the sorted blocks of one bucket of two runs: holders of what is in both."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ours, theirs = unpack(row["keys"]), unpack(row["old_keys"])
                at = np.minimum(np.searchsorted(theirs, ours), max(0, len(theirs) - 1))
                both = theirs[at] == ours if len(theirs) else np.zeros(len(ours), bool)
                k = ours[both]
                docs = np.concatenate([unpack(row["docs"], np.int64)[both], unpack(row["old_docs"], np.int64)[at[both]]])
                yield _run_rows(list(_holder_rows(np.concatenate([k, k]), docs, buckets)))

    return run


def _compacted(batches):
    """Rows with one bucket's sorted blocks of some runs: one block."""
    for batch in batches:
        for row in batch.to_pylist():
            keys = np.concatenate([unpack(k) for k in row["all_keys"]])
            docs = np.concatenate([unpack(d, np.int64) for d in row["all_docs"]])
            k, least, *_ = _least_by_key(keys, docs)
            block = _run_rows([(row["at"], _POSTINGS, pack(k), pack(least), b"")])
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array([row["at"]], pa.int32())], [*block.schema.names, "at"])


class FingerprintIndex:
    """Immutable runs below one folder, in Spark tables bucketed by range of hashes, so that a new batch is
    merge-joined with each of them where they lie. `postings=<first>-<last>` holds batches first to last;
    `holders=<batch>` who shares a fingerprint with whom; a folder counts once Spark's success marker is
    in it. So the index can be opened again, and what broke off is written anew."""

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def _complete(self, kind: str) -> list[str]:
        fs, path = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{kind}=") and fs.exists(self._fs(f"{self.root}/{n}/_SUCCESS")[1]))

    def runs(self) -> list[tuple[int, int]]:
        """First and last batch of the runs that no wider one has taken in."""
        found = [tuple(map(int, n.split("-"))) for n in self._complete("postings")]
        return sorted(r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found))

    def _table(self, path: str) -> DataFrame:
        """A run's table, known to this session by a name from its path."""
        name = f"fingerprints_{hashlib.md5(path.encode()).hexdigest()}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({RUN_AT}) USING parquet CLUSTERED BY (at) SORTED BY (at) INTO {self.buckets} BUCKETS LOCATION '{path}'")
        return self.spark.table(name)

    def _save(self, rows: DataFrame, path: str) -> None:
        """Rows that lie in as many partitions by `at` as there are buckets: one file each."""
        name = f"writing_{uuid.uuid4().hex}"
        rows.write.mode("overwrite").format("parquet").bucketBy(self.buckets, "at").sortBy("at").option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    def postings(self, run: tuple[int, int]) -> DataFrame:
        return self._table(f"{self.root}/postings={run[0]}-{run[1]}").where(F.col("kind") == _POSTINGS)

    def append(self, docs: DataFrame, batch: int) -> FingerprintIndex:
        """Takes in the documents (doc_id, text) of a batch, whose number is one above the last; a batch that
        is in already is left alone."""
        if str(batch) in self._complete("holders"):
            return self
        earlier = [r for r in self.runs() if r[1] < batch]
        flushed = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(_flush(self.buckets), RUN_AT)
        path = f"{self.root}/postings={batch}-{batch}"
        self._save(flushed.repartition(self.buckets, "at").groupBy("at").applyInArrow(_gather(self.buckets), RUN_AT), path)
        held = self._table(path).where(F.col("kind") == _HOLDERS).select(*_FIELDS)
        for run in earlier:
            old = self.postings(run).select("at", F.col("keys").alias("old_keys"), F.col("docs").alias("old_docs"))
            held = held.unionAll(self.postings((batch, batch)).join(old, "at").mapInArrow(_meet(self.buckets), RUN))
        held.write.mode("overwrite").parquet(f"{self.root}/holders={batch}")
        self._compact()
        return self

    def _compact(self) -> None:
        """Size-tiered: when FANOUT runs of one size stand side by side, one takes their place."""
        runs = self.runs()
        size = lambda r: r[1] - r[0] + 1
        last = runs[-FANOUT:]
        while len(last) == FANOUT and len({size(r) for r in last}) == 1:
            both = None
            for i, r in enumerate(last):
                one = self.postings(r).select("at", F.col("keys").alias(f"k{i}"), F.col("docs").alias(f"d{i}"))
                both = one if both is None else both.join(one, "at", "full")
            merged = both.select("at", *[F.array_compact(F.array(*[f"{c}{i}" for i in range(FANOUT)])).alias(n) for c, n in (("k", "all_keys"), ("d", "all_docs"))])
            self._save(merged.mapInArrow(_compacted, RUN_AT).repartition(self.buckets, "at"), f"{self.root}/postings={last[0][0]}-{last[-1][1]}")
            last = self.runs()[-FANOUT:]

    def participants(self) -> DataFrame:
        """(doc_id, keys): documents with their shared fingerprints."""
        held = self.spark.read.schema(RUN).parquet(*[f"{self.root}/holders={b}" for b in self._complete("holders")])
        return held.groupBy("bucket").applyInArrow(_per_doc, "doc_id long, keys binary")


def _per_doc(data: pa.Table) -> pa.Table:
    """Of one group of documents: the distinct keys of each."""
    rows = data.to_pylist()
    keys = np.concatenate([np.empty(0, np.uint64), *[unpack(r["keys"]) for r in rows]])
    docs = np.concatenate([np.empty(0, np.int64), *[unpack(r["docs"], np.int64) for r in rows]])
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.concatenate([[True], (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])]) if len(docs) else np.empty(0, bool)
    keys, docs = keys[new], docs[new]
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.empty(0, np.int64)
    parts = [pack(keys[a:b]) for a, b in zip(first, np.append(first[1:], len(docs)), strict=True)]
    return pa.table({"doc_id": pa.array(docs[first], pa.int64()), "keys": pa.array(parts, pa.binary())})


def _isin(x: np.ndarray, among: np.ndarray) -> np.ndarray:
    """among: sorted and distinct."""
    if not len(among) or not len(x):
        return np.zeros(len(x), bool)
    return among[np.minimum(np.searchsorted(among, x), len(among) - 1)] == x


def window_hashes(words: np.ndarray) -> np.ndarray:
    return gram_hashes(words, WINDOW, seed=0xA0761D6478BD642F)


def window_checks(words: np.ndarray) -> np.ndarray:
    """A second hash of the windows: together with the first, 128 bits are compared."""
    return gram_hashes(mix64(words), WINDOW, seed=0xE7037ED1A0B428DB)


def _windows(buckets: int):
    """Postings of the windows to verify; of windows that a smaller document of the same slice
    has too, the holder at once."""

    def run(batches):
        for batch in sliced(batches, most=TOGETHER):
            keys, checks, docs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for doc_id, text, parts in zip(batch.column("doc_id").to_pylist(), texts_of(batch), batch.column("keys").to_pylist(), strict=True):
                words = hash_words(text.split())
                at = _isin(fingerprints(words), unpack(parts))
                own, first = np.unique(window_hashes(words)[at], return_index=True)
                keys.append(own)
                checks.append(window_checks(words)[at][first])
                docs.append(np.full(len(own), doc_id, np.int64))
            keys, checks, docs = np.concatenate(keys), np.concatenate(checks), np.concatenate(docs)
            k, least, count, order, group = _least_by_key(keys, docs, checks)
            check = checks[order][np.cumsum(count) - 1] if len(k) else checks
            rows = [(b, _POSTINGS, pack(k[c]), pack(least[c]), pack(check[c])) for b, c in _cells(bucket_of(k, buckets))]
            later = order[docs[order] > least[group]]
            yield _run_rows(rows + list(_holder_rows(keys[later], docs[later], buckets)))

    return run


def _judge(buckets: int):
    """Of one bucket: holders of windows that start in a smaller document."""

    def run(data: pa.Table) -> pa.Table:
        rows = data.to_pylist()
        out = [(r["bucket"], _HOLDERS, r["keys"], r["docs"], b"") for r in rows if r["kind"] == _HOLDERS]
        posts = [r for r in rows if r["kind"] == _POSTINGS]
        if posts:
            keys = np.concatenate([unpack(r["keys"]) for r in posts])
            docs = np.concatenate([unpack(r["docs"], np.int64) for r in posts])
            _, least, _, order, group = _least_by_key(keys, docs, np.concatenate([unpack(r["shared"]) for r in posts]))
            later = order[docs[order] > least[group]]
            out += _holder_rows(keys[later], docs[later], buckets)
        return pa.Table.from_batches([_run_rows(out)])

    return run


def _rewrite(batches):
    for batch in sliced(batches):
        out = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        for text, parts in zip(texts_of(batch), batch.column("windows").to_pylist(), strict=True):
            words = text.split()
            gone = np.zeros(len(words), bool)
            if parts:
                starts = np.flatnonzero(_isin(window_hashes(hash_words(words)), unpack(parts)))
                gone = covered_by(starts, WINDOW, len(words))
            kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
            out["n_words"].append(len(words))
            out["n_removed"].append(int(gone.sum()))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept_text"].append(kept.decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"]), pa.array(out["kept_text"], pa.string())], ["doc_id", *out])


def _digest(batches):
    for batch in sliced(batches):
        counts, digests = [], []
        for text in texts_of(batch):
            words = text.split()
            counts.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array([0] * len(counts), pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def repeated_windows(docs: DataFrame, index: FingerprintIndex) -> DataFrame:
    """(doc_id, keys): the documents that lose words, with the hashes of the windows to remove."""
    parts = stored(index.participants(), "repeat-participants")
    held = narrow_to(docs.select("doc_id", "text"), parts).join(parts, "doc_id")
    gone = held.mapInArrow(_windows(index.buckets), RUN).groupBy("bucket").applyInArrow(_judge(index.buckets), RUN)
    gone = gone.where(F.col("kind") == _HOLDERS).groupBy("bucket").applyInArrow(_per_doc, "doc_id long, keys binary")
    return stored(gone, "repeat-windows")


def rewritten(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents of repeated_windows: doc_id, n_words, n_removed, kept_sha256, kept_text."""
    rows = narrow_to(docs.select("doc_id", "text"), gone).join(gone.withColumnRenamed("keys", "windows"), "doc_id")
    return rows.mapInArrow(_rewrite, OUT)


def remove_repeats(docs: DataFrame, batches: int = 2) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256. The documents enter the index in
    `batches` ranges of doc_id."""
    index = FingerprintIndex(docs.sparkSession, work_dir(docs.sparkSession, "fingerprint-index"), 2 * partitions(docs.sparkSession))
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02) if batches > 1 else []
    edges = [None, *[int(c) for c in cuts], None]
    for number, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        part = docs if low is None else docs.where(F.col("doc_id") > low)
        index.append(part if high is None else part.where(F.col("doc_id") <= high), number)
    changed = stored(rewritten(docs, repeated_windows(docs, index)).drop("kept_text"), "repeat-rewritten")
    clean = docs.select("doc_id", "text").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return clean.join(changed.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(changed)


def op9_substring_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
m AS (SELECT k, min(doc_id) AS least FROM x GROUP BY k HAVING count(DISTINCT doc_id) > 1),
f AS (SELECT doc_id, i FROM x JOIN m USING (k) WHERE least < doc_id),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM f),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
r AS (SELECT t.doc_id, count(c.j) AS n_removed, string_agg(word, ' ' ORDER BY t.j) FILTER (c.j IS NULL) AS kept FROM t LEFT JOIN c ON c.doc_id = t.doc_id AND c.j = t.j GROUP BY t.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
