"""Incremental corpus build: a file stream of parts goes to a good and a quarantine table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructType


def part_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_quarantine(stream: DataFrame, keys: list[str], time: str, delay: str, reason: Column, good: str, bad: str, checkpoint: str) -> None:
    """Process all that is there: rows with a reason go to ``bad``, the others to ``good``, each key once.

    State of the keys is dropped once they are ``delay`` older than the newest row. A batch that
    is run again after a failure replaces its own folder, so nothing is written twice.
    """
    seen = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys).withColumn("reason", reason)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter("reason is null").drop("reason").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.filter("reason is not null").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        batch.unpersist()

    query = seen.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


class WholeOrigins(StatefulProcessor):
    """State of one origin: how many of its parts have come, and their tokens. It is dropped once all announced parts are there."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sofar = handle.getValueState("sofar", StructType().add("n", LongType()).add("tokens", LongType()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, tokens = self.sofar.get() or (0, 0)
        announced = 0
        for batch in rows:
            announced = max(announced, int(batch["n_parts"].max()))
            n, tokens = n + len(batch), tokens + int(batch["n_tokens"].sum())
        if n < announced:
            self.sofar.update((n, tokens))
        else:
            self.sofar.clear()
            yield pd.DataFrame({"origin": [key[0]], "n_parts": [n], "total_tokens": [tokens]})

    def close(self) -> None:
        pass


def run_whole_origins(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Totals of each origin (origin, part_id, n_tokens, n_parts: how many parts it has), written once all its parts have come.

    Processes all that is there and stops; another run with the same checkpoint goes on with the state so far. A part that comes again changes nothing: parts are
    told apart before they are counted. The file sink writes each batch once.
    """
    spark = stream.sparkSession
    name, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name, None)
    spark.conf.set(name, store)
    try:
        kind = stream.schema["origin"].dataType.simpleString()
        done = stream.dropDuplicates(["origin", "part_id"]).groupBy("origin").transformWithStateInPandas(WholeOrigins(), f"origin {kind}, n_parts bigint, total_tokens bigint", "Append", "None")
        query = done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
