"""Streams: clarification sessions with state, and idempotent ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.assisted import GIVE_UP

OUT = "session string, used long, gave_up boolean, last_answer string"


def _turns(most: int):
    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, gave, last = state.get if state.exists else (0, False, None)
        for p in parts:
            for answer in p.sort_values("turn")["answer"]:
                last = (answer or "").strip()
                gave = bool(gave) or last.lower() in GIVE_UP
                used = most if gave else min(most, used + 1)
        state.update((used, gave, last))
        yield pd.DataFrame({"session": [key[0]], "used": [used], "gave_up": [gave], "last_answer": [last]})

    return run


def sessions(turns: DataFrame, most: int = 3) -> DataFrame:
    """State of each session after every batch of a stream of (session, turn, answer)."""
    return turns.groupBy("session").applyInPandasWithState(_turns(most), OUT, "used long, gave_up boolean, last_answer string", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events a type and time window, late ones up to the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def ingest(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Writes rows of a stream whose key is not stored yet; running a batch again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        # Nothing is stored before the first batch.
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(path).select(key), key, "left_anti")
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
