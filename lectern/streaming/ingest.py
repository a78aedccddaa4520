"""New article files since the last run, as a file stream that ends when all are taken up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import from_xml
from ..sources.xml_corpus import local_name


def new_articles(spark: SparkSession, folder: str, files_per_batch: int = 10_000) -> DataFrame:
    """A stream of (xml_path, xml_text); each file is read once per checkpoint."""
    source = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", files_per_batch)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = source.schema(schema).load(f"{folder.rstrip('/')}/*.xml")
    return rows.select(local_name(F.col("path")).alias("xml_path"), F.try_validate_utf8(F.col("content").cast("string")).alias("xml_text"))


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the index rows of new files to a Parquet table; a batch that is
    run again writes the same folder again, so nothing is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        from_xml(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return new_articles(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
