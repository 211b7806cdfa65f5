"""Token counts as delta-maintained rollups.

The totals by source, language and tokenizer version are additive, so each change is a signed delta:
an insert adds one document and its tokens, a delete takes them away, a revised count adds the
difference of its tokens and no document. A batch's deltas are summed by key and committed as one
folder named by the batch; a folder counts once Spark's writer has put its success marker there. A
batch that is committed already is left alone and a batch that broke off is written anew, so commits
may be repeated at will. Totals are the sum over committed folders; `compact` sums them into one.

Rows: a null text has no tokens and is still one document; null sources and languages are keys of
their own; repeated rows each count; keys whose documents and tokens all went are not reported; an
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, stored, table, work_dir

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: A run of letters and digits, or one mark.
_MARKED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]"


def _matches(pattern: str) -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long")


def tokenizers() -> dict[str, Column]:
    """Counters by tokenizer version, all native."""
    return {"words-1": _matches(WORD), "marks-2": _matches(_MARKED)}


def inserted(counts: DataFrame) -> DataFrame:
    """Deltas of new rows (source, lang, tokenizer, n_tokens)."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Deltas of rows that go."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).cast("long").alias("n_tokens"))


def revised(counts: DataFrame, old: str = "old_tokens") -> DataFrame:
    """Deltas of rows whose count was `old` and now is n_tokens."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col("n_tokens") - F.col(old)).cast("long").alias("n_tokens"))


@dataclass
class TokenRollup:
    """The committed batches below one folder."""

    spark: SparkSession
    root: str

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self.spark._jsc.hadoopConfiguration()), jpath

    def batches(self) -> list[str]:
        fs, path = self._fs(self.root)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return sorted(n for n in names if self.committed(n.removeprefix("batch=")))

    def committed(self, batch: str) -> bool:
        fs, path = self._fs(f"{self.root}/batch={batch}/_SUCCESS")
        return fs.exists(path)

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds the deltas as a batch; False, and no change, if that batch is in already."""
        if self.committed(batch):
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.write.mode("overwrite").parquet(f"{self.root}/batch={batch}")
        return True

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*[f"{self.root}/{n}" for n in names])

    def totals(self) -> DataFrame:
        sums = self._read(self.batches()).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 or n_tokens != 0")

    def compact(self, root: str) -> TokenRollup:
        """One rollup of the same totals below another folder. It keeps an empty marker for every
        batch, so what was committed here stays committed there."""
        done = self.batches()
        out = TokenRollup(self.spark, root)
        out.commit("compacted", self._read(done))
        for name in done:
            if name != "batch=compacted":
                out.commit(name.removeprefix("batch="), self.spark.createDataFrame([], DELTA))
        return out


def maintained_counts(docs: DataFrame, root: str) -> DataFrame:
    """The life of a corpus in four batches over all of docs: every document enters with an estimate
    of its tokens and is then counted; a second tokenizer version is added; exact copies of a
    document with a smaller doc_id are deleted. The revision is committed twice, as after a lost
    acknowledgement."""
    text_key = F.struct(F.sha2("text", 256).alias("sha"), F.length("text").alias("n")).alias("key")
    estimate = F.coalesce(F.ceil(F.length("text") / 4), F.lit(0)).cast("long")
    versions = tokenizers()
    counted = stored(docs.select("doc_id", "source", "lang", F.when(F.col("text").isNotNull(), text_key).alias("key"), estimate.alias("estimate"), *[c.alias(v) for v, c in versions.items()]), "token-counts")
    rows = lambda df, v, n="n_tokens": df.withColumn("tokenizer", F.lit(v)).withColumn(n, F.col(f"`{v}`"))
    first, second = versions
    rollup = TokenRollup(docs.sparkSession, root)
    rollup.commit("1-ingest", inserted(counted.withColumn("tokenizer", F.lit(first)).withColumn("n_tokens", F.col("estimate"))))
    for _ in range(2):
        rollup.commit("2-revise", revised(rows(counted, first), "estimate"))
    rollup.commit("3-second-version", inserted(rows(counted, second)))
    keepers = counted.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = counted.join(keepers, "key").where("doc_id > first_id")
    rollup.commit("4-copies", deleted(rows(copies, first)).unionAll(deleted(rows(copies, second))))
    return rollup.totals()


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintained_counts(table(spark, sf_dir, "documents"), work_dir(spark, "token-rollup"))


ORACLE_SQL = rf"""
WITH k AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents),
d AS (SELECT source, lang, text FROM k WHERE text IS NULL OR doc_id IS NULL OR doc_id <= first_id),
c AS (
  SELECT source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM d
  UNION ALL SELECT source, lang, 'marks-2', coalesce(len(regexp_extract_all(text, '{_MARKED}')), 0) FROM d
)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM c GROUP BY source, lang, tokenizer
"""
