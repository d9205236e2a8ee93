"""Append-once as a stream: each micro-batch writes only the conditions that the result table doesn't have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tamarack import sources
from tamarack.sources import files


def append_new(stream: DataFrame, path: str, checkpoint: str, keys: list[str], unique: list[str] | None = None) -> StreamingQuery:
    """Appends to the table at path the rows of keys that it has not, one for each value of `unique` (the keys, if none is given).

    The table is partitioned by the first key, so that a batch meets only the partitions it has keys of. A batch that brings more rows of a
    key than the table has of it raises, as in a table: a part of a condition is never added to."""
    schema = stream.schema

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        fresh = df.dropDuplicates(unique or keys)
        if files.exists(spark, path):
            old = spark.read.schema(schema).parquet(path)
            mine = old.join(fresh.select(keys[0]).distinct(), keys[0], "left_semi")
            n = fresh.groupBy(*keys).agg(F.count("*").alias("n_expected"))
            fresh = sources.append_once(fresh.join(n, keys), mine, keys).select(*schema.names)
        fresh.write.mode("append").partitionBy(keys[0]).parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
