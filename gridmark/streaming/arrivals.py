"""Incremental listing: each file is recorded once, however often it is delivered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from gridmark.operators.pairing import describe_files
from gridmark.session import settings

#: State on disk, read by key: a batch costs what it delivers, not what was delivered before.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def record_arrivals(stream: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Record image files of a ``(dataset, path)`` stream under ``folder/files``, each path once.

    The paths seen are keyed state in a store on disk, so a batch asks for its own paths only and nothing
    recorded is read again; a replayed batch finds the state of its predecessor and replaces its own rows.
    """
    spark, files = stream.sparkSession, f"{folder}/files"
    described = describe_files(stream).dropDuplicates(["path"])
    describe_files(spark.createDataFrame([], stream.schema)).write.mode("ignore").parquet(f"{files}/batch=-1")  # there is a table before anything arrives

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{files}/batch={batch_id}")

    with settings(spark, STATE_STORE):
        return (described.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint")
                .trigger(**(trigger or {"availableNow": True})).start())
