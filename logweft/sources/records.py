"""Use records, the fact rows: ord, id, source_slice_id, timestamp, player, item, source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name, duration in seconds, strength. One event type is left out on purpose: an unknown item.
ITEMS = (("purchase", 600, 100), ("click", 300, 80), ("view", 480, 140), ("signup", 120, 0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def item_dimension(spark: SparkSession, items=ITEMS) -> DataFrame:
    """Items as rows; a local relation, so Spark knows its size when it plans a join."""
    values = ", ".join(f"('{name}', {duration}, {watt})" for name, duration, watt in items)
    return spark.sql(f"select * from values {values} as item_dimension(name, duration, watt)")


def from_events(events: DataFrame) -> DataFrame:
    """Events as use records."""
    return events.select(
        F.col("event_id").alias("ord"), F.concat(F.lit("record_"), "event_id").alias("id"), F.concat(F.lit("slice_"), "event_id").alias("source_slice_id"),
        F.date_format("ts", "'['HH:mm:ss']'").alias("timestamp"), F.concat(F.lit("user"), "user_id").alias("player"),
        F.col("event_type").alias("item"), F.lit("ocr").alias("source"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """Stored sessions (JSON, one a line): missing parts get empty defaults, corrupt lines become null rows."""
    schema = "id string, createdAt string, mode string, images array<struct<id:int,status:string>>, deletedRecordIds array<string>, _corrupt string"
    raw = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.select(
        "id", "createdAt", F.coalesce("mode", F.lit("balanced")).alias("mode"),
        F.coalesce("images", F.array().cast("array<struct<id:int,status:string>>")).alias("images"),
        F.coalesce("deletedRecordIds", F.array().cast("array<string>")).alias("deletedRecordIds"), F.col("_corrupt").isNotNull().alias("corrupt"),
    )


def golden(spark: SparkSession, path: str) -> DataFrame:
    """id and text of the entries of expected-text documents (JSON); entries without an id or a text are left out, as are documents that are no JSON."""
    entry = "struct<id:string,text:string,start_x:int,end_x:int>"
    raw = spark.read.schema(f"version int, start_x int, end_x int, results array<{entry}>").option("multiLine", "true").json(path)
    return raw.select(F.explode("results").alias("e")).select("e.*").where("id is not null and text is not null")
