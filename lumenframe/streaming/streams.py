"""Streams: debouncing by session windows, idempotent inserts, accepted signals with state, refreshes by micro-batch.

Every query takes a streaming DataFrame; sinks are idempotent by batch number, and state and progress live in the checkpoint
folder, so a query stopped at any point goes on where it was.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenframe.tables import ship_package


def file_stream(spark: SparkSession, folder: str, like: DataFrame, files_at_once: int = 1) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder (or match a pattern, for a single file), with the schema of `like`."""
    ship_package(spark)
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def debounced(stream: DataFrame, keys: list[str], time: str, value: str, quiet: str, late: str) -> DataFrame:
    """(keys, value, changes, due): the last change of each key once it has been quiet, after `late` for stragglers."""
    windowed = stream.withWatermark(time, late).groupBy(F.session_window(time, quiet).alias("w"), *keys)
    last = windowed.agg(F.max_by(value, time).alias(value), F.count(F.lit(1)).alias("changes"))
    return last.select(*keys, value, "changes", F.col("w.end").alias("due"))


def inserted_once(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Rows whose keys weren't seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def accepted_signals(stream: DataFrame, key: str, time: str, gap_seconds: int) -> DataFrame:
    """Rows at least `gap_seconds` after the last accepted row of their key, comparing with accepted rows only.

    A key's state is the time of its last accepted row. Within a micro-batch rows are taken in order of time.
    """
    kinds = dict(stream.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in stream.columns)

    def step(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for batch in batches:
            batch = batch.sort_values(time)
            keep = []
            for ts in batch[time]:
                now = int(ts.timestamp() * 1_000_000)
                ok = last is None or now - last >= gap_seconds * 1_000_000
                last = now if ok else last
                keep.append(ok)
            yield batch[keep]
        if last is not None:
            state.update((last,))

    return stream.groupBy(key).applyInPandasWithState(step, shape, "last bigint", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Append everything that has arrived to a Parquet folder, then stop; a second run goes on behind the first."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder).awaitTermination()


def merge_batches(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand each micro-batch with its number to `merge`, which must be idempotent by number."""
    stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
