"""The corpus pipeline: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Toxic documents go, then all but one document of each near-duplicate group, then documents that hold
a passage of the benchmark; the rest is mixed to its source targets by whole documents, which may
repeat, and written as token records. Rows with null or repeated ids, null or empty texts and
repeated rows each count as rows of their own in all stages; an empty table gives an empty result. All stages but the last return the columns of documents. Each
stage's result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm.common import keyed, stored, table, work_dir
from folioquery.llm.decontam import uncontaminated
from folioquery.llm.mixing import whole_copies
from folioquery.llm.near_dedup import near_duplicates
from folioquery.llm.token_records import read_records, write_records
from folioquery.llm.toxicity import score_texts, train


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose calibrated chance of being toxic is 0.5 or more."""
    model = train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return score_texts(docs, model, "_toxicity").where("_toxicity < 0.5").drop("_toxicity")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, of the smallest doc_id, of each group of near-duplicates (five-word shingles, 0.8);
    all rows without words. Rows are told apart by a key of their own, so null and repeated ids are
    judged row by row; among rows of one group a null id counts as the largest."""
    rows = keyed(docs, "_dedup_row", "pipeline-dedup-rows")
    found = near_duplicates(rows.select(F.col("_dedup_row").alias("doc_id"), "text"), k=5, percent=80)
    found = found.select(F.col("doc_id").alias("_dedup_row"), F.col("component_id").alias("_group"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col("_dedup_row").alias("at"))
    members = stored(rows.select("_dedup_row", order.alias("_order")).join(found, "_dedup_row"), "pipeline-dedup-groups")
    first = members.groupBy("_group").agg(F.min("_order").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    gone = members.join(first, "_group").where("_order != _first").select("_dedup_row")
    return rows.join(stored(gone, "pipeline-copies"), "_dedup_row", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of the benchmark occurs."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops whole documents by the words that the mix takes of them, to the nearest
    number of copies; a document without words isn't taken. Rows are told apart by a key of their own,
    so null and repeated ids are mixed row by row."""
    return whole_copies(keyed(docs, "_mix_row", "pipeline-mix-rows"), "_mix_row").select(*docs.columns)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the corpus as token records and reports what is read back from them."""
    root = work_dir(spark, "pipeline-records")
    return read_records(write_records(docs, root, remember=100_000), root).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("token_records", token_records)]
#: The classifier can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
