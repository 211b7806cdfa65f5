"""Helpers shared by the corpus operators: tables, shared work folders, word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[^\x20\x09-\x0D]+`, the words of most contracts, as a Java pattern.
WORD = r"[^ \t-\r]+"
#: Slots of the id filter that `narrow_to` broadcasts; at 8 bytes each this bounds the broadcast.
ID_SLOTS = 1 << 20
#: Entries of a worker's word cache; it is emptied when full.
CACHE_WORDS = 100_000
#: Bytes of text that a worker takes at once, where no single text is longer.
TEXT_BYTES = 2 << 20
M64 = (1 << 64) - 1
#: Most files whose names `keyed` collects and broadcasts.
FILES = 20_000


#: Settings of the Arrow stages that replace Spark's defaults, if the session has these: a batch that
#: goes to a worker is bounded by a few megabytes.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def small_batches(spark: SparkSession) -> None:
    for key, (default, ours) in ARROW.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below the session's `spark.checkpoint.dir`, which all machines share. Where that
    is unset a session with a local master gets a temporary folder once; any other raises, as its
    executors would each write a disk of their own."""
    small_batches(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("folioquery.work.dir", None)
    if not root:
        if spark.conf.get("spark.master", "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("folioquery.work.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet into the shared work folder and reads it back: lineage ends there, and a
    lost executor costs no recomputation."""
    path = work_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scans_files(docs: DataFrame) -> bool:
    """Whether docs are rows of files, each once: projections and filters over one relation."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias") and plan.children().size() == 1:
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation" or plan.nodeName().startswith("Relation")


def keyed(docs: DataFrame, column: str, tag: str) -> DataFrame:
    """docs with a column of distinct longs, the same at every reading. Of the rows of at most FILES files it is made of
    the file's number and the row's place in it, without copying them; others, and rows of joins,
    explodes and unions, are stored first."""
    try:
        files = docs.select("_metadata.file_path").distinct().limit(FILES + 1).collect() if _scans_files(docs) else []
    except AnalysisException:
        files = []
    if not 0 < len(files) <= FILES:
        return stored(docs.withColumn(column, F.monotonically_increasing_id()), tag)
    numbers = [(path, i) for i, path in enumerate(sorted(r[0] for r in files))]
    number = docs.sparkSession.createDataFrame(numbers, "_keyed_path string, _keyed_file long")
    rows = docs.select("*", F.col("_metadata.file_path").alias("_keyed_path"), F.col("_metadata.row_index").alias("_keyed_at"))
    key = F.shiftleft("_keyed_file", 40) + F.col("_keyed_at")
    return rows.join(F.broadcast(number), "_keyed_path").select(*docs.columns, key.alias(column))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def narrow_to(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of docs whose key is in ids. A broadcast set of at most ID_SLOTS hashed slots drops most
    other rows before the exact semi join shuffles what is left; once ids fill all slots it passes
    everything on and the join alone decides, so its size never grows with the data."""
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(ID_SLOTS)).cast("int")
    ids = ids.select(F.col(key)).distinct()
    slots = ids.select(slot.alias("_slot")).distinct()
    near = docs.withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left_semi").drop("_slot")
    return near.join(ids, key, "left_semi")


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = value
        return value


_HASHES = WordHashes()


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, k: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of k words: a polynomial in an odd base, then mixed."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64((seed * 2 + 1) & M64)
    acc = words[:n].copy()
    for i in range(1, k):
        acc *= base
        acc += words[i : i + n]
    return mix64(acc ^ np.uint64(seed))


def sliced(batches, column: str = "text", most: int = TEXT_BYTES):
    """The rows of the batches in order, cut so that a slice has about `most` bytes of text, or one
    text that is longer: what a worker holds depends on bytes, not on the rows of a batch."""
    for batch in batches:
        if batch.num_rows:
            sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
            ends = np.cumsum(sizes)
            part = (ends - sizes) // most
            part += np.cumsum(sizes > most)  # a long text starts a slice of its own
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield batch.slice(a, b - a)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.uint64).view(np.int64)
