"""Event-driven pieces: save checkpoints of a session, and mining of a folder as files arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Messages of a user between two saves.
SAVE_INTERVAL = 15
REASON = "Save checkpoint: file the session's key topics, decisions, quotes and code, then go on."


def counts_as_message(role: Column, content: Column) -> Column:
    """A user's own text; commands don't count."""
    return F.coalesce((role == "user") & ~F.contains(content, F.lit("<command-message>")), F.lit(False))


def checkpoints(messages: DataFrame, session: str, order: str, interval: int = SAVE_INTERVAL) -> DataFrame:
    """messages (session, order, ...), each of which counts -> the rows at which a save is due, with the count so far."""
    so_far = F.row_number().over(Window.partitionBy(session).orderBy(order)).cast("long")
    return messages.withColumn("messages", so_far).where(F.col("messages") % interval == 0)


def hook(session_id: str, count: int, last_saved: int, *, active: bool = False, interval: int = SAVE_INTERVAL) -> tuple[dict, int]:
    """What one call decides, and the count that is saved from now on."""
    del session_id
    due = not active and count > 0 and count - last_saved >= interval
    return ({"decision": "block", "reason": REASON}, count) if due else ({}, last_saved)


def before_compaction() -> dict:
    """Compaction always waits for a save."""
    return {"decision": "block", "reason": REASON}


def stream_checkpoints(messages: DataFrame, session: str, interval: int = SAVE_INTERVAL) -> DataFrame:
    """A stream of messages -> (session, messages, saves): for each batch that makes a save due, the count and how many saves it holds.

    The state of a session is two numbers: its messages so far, and those at the last save.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last = state.get if state.exists else (0, 0)
        count += sum(map(len, batches))
        saves = (count - last) // interval  # one at each interval since the last
        last += saves * interval
        state.update((count, last))
        if saves:
            yield pd.DataFrame({session: [key[0]], "messages": [last], "saves": [saves]})

    kind = messages.schema[session].dataType.simpleString()
    return messages.groupBy(session).applyInPandasWithState(step, f"{session} {kind}, messages long, saves long", "count long, last long", "append", GroupStateTimeout.NoTimeout)


def stream_mining(spark: SparkSession, folder: str, target: str, state: str, *, wing: str) -> StreamingQuery:
    """Mine text files of a folder into a Parquet table as they arrive; what was filed before is skipped."""
    from memloom.operators.transcripts import mine

    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).schema("value string").load(folder)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))

    def file(batch: DataFrame, _: int) -> None:
        found = mine(batch, _existing(spark, target), wing=wing)
        found.write.mode("append").parquet(target)

    return files.writeStream.foreachBatch(file).option("checkpointLocation", state).trigger(availableNow=True).start()


def _existing(spark: SparkSession, target: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    return spark.read.parquet(target) if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at) else None
