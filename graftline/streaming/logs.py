"""Step logs as streams: tailing JSON lines, dropping repeats within a watermark, means per window, sums per segment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STEP = "ts timestamp, user_id bigint, event_id bigint, event_type string, value double"


def tail(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Files of appended JSON lines, each read once."""
    return spark.readStream.schema(STEP).option("maxFilesPerTrigger", files_per_trigger).json(path)


def distinct_steps(steps: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once, as long as repeats come within the watermark."""
    return steps.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def window_means(steps: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and mean per window and type; late rows beyond the watermark are left out."""
    seen = steps.withWatermark("ts", late)
    return seen.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def running_segments(steps: DataFrame, marker: str) -> DataFrame:
    """(user_id, idx, n, total): a row for each stretch between markers of a user that a later marker closes."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idx, n, total = state.get if state.exists else (0, 0, 0.0)
        rows = []
        for batch in batches:
            for kind, value in batch.sort_values(["ts", "event_id"])[["event_type", "value"]].itertuples(index=False):
                if kind == marker:
                    if idx:
                        rows.append((key[0], idx, n, total))
                    idx, n, total = idx + 1, 0, 0.0
                elif idx:
                    n, total = n + 1, total + float(value)
        state.update((idx, n, total))
        yield pd.DataFrame(rows, columns=["user_id", "idx", "n", "total"])

    return steps.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, idx bigint, n bigint, total double", "idx bigint, n bigint, total double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a stream gives for the files that are there: one batch query to a table in the folder."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")
