"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

#: Rows whose texts are Python strings at one time in a task; bounds memory when texts are long.
ROWS_AT_ONCE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """A column name like base that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def checkpoint_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir (a folder of this session's own in it).

    Only a session in one process (a test) that names none gets one of its
    own; on a cluster executors would not see each other's files there, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df read back from a reliable checkpoint, so that lost executors cost no recomputation of what led to it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def bucketed(df: DataFrame, parts: int, key: str) -> DataFrame:
    """df written to the checkpoint folder in sorted buckets of key, and read back; buckets of as many parts are joined without a shuffle."""
    spark, name = df.sparkSession, f"run_{uuid.uuid4().hex}"
    df.write.bucketBy(parts, key).sortBy(key).option("path", f"{checkpoint_folder(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved, so that the name is not needed any more; the files stay
    spark.sql(f"drop table {name}")
    return table


def split_by_crc(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    text: str,
    make: Callable[[], Callable[[list[str]], list[list]]],
    fields: Sequence[StructField],
) -> DataFrame:
    """The columns keep of df, then fields computed from each whole text (null counts as empty).

    make() runs once a task; what it returns gets a list of texts and gives one list of values per field.
    """
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])
    schema = StructType([source.schema[c] for c in keep] + list(fields))
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in in_slices(batches):
            made = work([t or "" for t in batch.column(text).to_pylist()])
            columns = [batch.column(c) for c in keep] + [pa.array(v, type=k) for v, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return source.mapInArrow(run, schema)


def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS_AT_ONCE rows."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS_AT_ONCE):
            yield whole.slice(at, ROWS_AT_ONCE)


def filter_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """The rows of df, with all their columns, for whose whole text (null counts as empty) the function gives true.

    make() runs once a task; rows stay where they are.
    """
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeps = make()
        for batch in in_slices(batches):
            yield batch.filter(pa.array(keeps([t or "" for t in batch.column(place).to_pylist()]), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learnable: Column, most: int) -> DataFrame:
    """(text, label) of at most `most` labelled documents: those whose ids hash lowest.

    The bound is on the classifier's training rows alone; `most` narrow label rows are what is broadcast.
    Ids labelled twice keep their larger label; null ids and null labels take no part.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & learnable)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")
