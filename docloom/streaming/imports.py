"""Continuous import: chunk files that arrive in a folder are appended to a store, each pack once."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.packs import import_packs


def import_stream(spark: SparkSession, folder: str, schema: StructType, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start importing; with ``once`` the query ends when the files there are taken.

    A batch that is repeated after a failure finds its packs imported and adds nothing.
    """
    stream = spark.readStream.schema(schema).parquet(folder)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: import_packs(store, df) and None)
    return (writer.trigger(availableNow=True) if once else writer).start()
