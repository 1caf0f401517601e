"""Structured Streaming forms of the log roll-ups, of session state and of ingestion."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily_counts(events: DataFrame, ts: str, late: str = "2 days", key: str | None = None) -> DataFrame:
    """Counts of UTC days; rows later than the watermark are dropped."""
    by = [F.window(ts, "1 day"), *([key] if key else [])]
    return events.withWatermark(ts, late).groupBy(*by).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("bucket"), *([key] if key else []), "n")


def weekly_counts(events: DataFrame, ts: str, late: str = "8 days") -> DataFrame:
    """Counts of weeks that begin on Monday (the epoch was a Thursday)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "7 days", "7 days", "4 days")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("bucket"), "n")


def distinct_events(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def recent_ids(uses: DataFrame, n: int = 20) -> DataFrame:
    """Per session the last n ids, the latest last, with a version that counts changes. `uses`: session, id, seq."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, version = state.get if state.exists else ([], 0)
        ids = list(ids)
        rows = pd.concat(list(batches)).sort_values("seq")
        for i in rows["id"]:
            ids = [x for x in ids if x != i] + [i]
        ids, version = ids[-n:], version + 1
        state.update((ids, version))
        yield pd.DataFrame({"session": [key[0]], "ids": [ids], "version": [version]})

    return uses.groupBy("session").applyInPandasWithState(step, "session string, ids array<string>, version long", "ids array<string>, version long", "update", GroupStateTimeout.NoTimeout)


def write_now(df: DataFrame, name: str, checkpoint: str, mode: str = "complete"):
    """Runs over all there is and stops; the result is the table `name` in memory."""
    return df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
