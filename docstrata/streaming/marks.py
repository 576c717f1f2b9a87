"""High-water marks as keyed state of a stream: a value for each source that moves only when a run has passed.

The stream reads a row for each run and source (source, run_id, status, registered_at: the latest time in the run). The mark is
kept in the checkpoint, so that a restart goes on with it; a late run with an older time, a failed run and a run that is read
again leave it where it is. What comes out are the moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUNS = "source string, run_id string, status string, registered_at string"
MOVES = "source string, high_water string, run_id string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HighWater(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "at string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  (Spark's names)
        held = self.mark.get()[0] if self.mark.exists() else None
        best, run = held, None
        # rows come in pieces, of which the latest passed one counts
        for piece in rows:
            passed = piece[(piece["status"] != "failed") & piece["registered_at"].notna()]
            for at, run_id in zip(passed["registered_at"], passed["run_id"]):
                if best is None or (at, run_id or "") > (best, run or "") and at > (held or ""):
                    best, run = at, run_id
        if run is not None:
            self.mark.update((best,))
            yield pd.DataFrame({"source": [key[0]], "high_water": [best], "run_id": [run]})

    def close(self) -> None:
        pass


def moves(runs: DataFrame) -> DataFrame:
    """The moves of the marks; ``runs`` is a stream of RUNS."""
    return runs.groupBy("source").transformWithStateInPandas(HighWater(), MOVES, "Update", "None")


def advance(spark: SparkSession, runs_folder: str, state: str) -> DataFrame:
    """Take in the runs that were written below ``runs_folder`` (Parquet, any partition folders) since the last call; returns source, high_water of all that is known.

    ``state``: a folder of its own for the checkpoint and the moves.
    """
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        stream = spark.readStream.schema(RUNS).parquet(runs_folder).select("source", "run_id", "status", "registered_at")
        write = moves(stream).writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True)

        def keep(batch: DataFrame, number: int) -> None:
            # the same batch again replaces itself
            batch.write.mode("overwrite").parquet(f"{state}/moves/batch={number}")

        write.foreachBatch(keep).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return marks(spark, state)


def marks(spark: SparkSession, state: str) -> DataFrame:
    """source, high_water: a few rows for each source, whatever the lake holds."""
    from docstrata.storage import exists

    rows = spark.read.schema(f"{MOVES}, batch int").parquet(f"{state}/moves") if exists(spark, f"{state}/moves") else spark.createDataFrame([], f"{MOVES}, batch int")
    return rows.groupBy("source").agg(F.max("high_water").alias("high_water"))
