"""Files that arrive over time: the same narrow stages on a stream of PDF bytes, and page texts that are
complete within each micro-batch, as a file's pages all come from its one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import text
from ..sources.pdf import RUN_COLUMNS, open_documents, page_primitives


def stream_files(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """(doc_id, path, content) of the PDF files that appear in a folder."""
    found = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", files_per_trigger)
    found = found.schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return found.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def write_page_texts(files: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends (batch, doc_id, page_index, text) as Parquet; a batch that is run again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        glyphs = page_primitives(open_documents(batch.select("doc_id", "content")), ("run",), RUN_COLUMNS)
        text.page_text(glyphs).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
