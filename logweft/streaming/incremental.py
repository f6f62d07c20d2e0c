"""An extension: results that arrive as files are merged into a Parquet table by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from logweft.operators.review import missing


def append_new(batch: DataFrame, target: str, key: list[str]) -> None:
    """Adds the rows of batch whose key target does not have; a batch that is tried again adds nothing twice."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(key)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        fresh = missing(fresh, spark.read.schema(batch.schema).parquet(target), key)
    fresh.write.mode("append").parquet(target)


def follow(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Reads what lies in folder, and ends when it has read all of it."""
    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, target, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
