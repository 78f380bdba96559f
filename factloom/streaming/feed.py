"""The change feed as a stream: each micro-batch is applied to a bucketed table.

A batch that is delivered again changes nothing, since its versions are already reached; so
at-least-once delivery by ``foreachBatch`` gives exactly the state of one batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.feed import BucketedTable


def apply_stream(changes: DataFrame, store: BucketedTable, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start applying a stream of changes; once: stop after what is there now."""

    def batch(rows: DataFrame, _: int) -> None:
        store.apply(rows)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_changes(spark: SparkSession, folder: str, name: str, files_per_batch: int = 4) -> DataFrame:
    """A stream over a parquet table ``name`` in ``folder``, be it one file or a folder of files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    inside = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    schema = spark.read.parquet(f"{folder}/{name}").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/{name}") if inside else reader.option("pathGlobFilter", name).parquet(folder)
