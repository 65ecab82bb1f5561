"""Change feeds over Structured Streaming, and the same over a finished table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def changes(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """rows whose value differs from their key's row before; the first row always counts. Nulls are equal."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("_before", F.lag(value).over(w)).withColumn("_place", F.row_number().over(w))
    return marked.where((F.col("_place") == 1) | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_place")


def debounced(rows: DataFrame, key: str, ts: str, seconds: float, order: list[str]) -> DataFrame:
    """the rows of a key that no other follows within `seconds`."""
    after = F.lead(ts).over(Window.partitionBy(key).orderBy(*order))
    gap = F.unix_micros(after.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))
    return rows.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > seconds * 1e6)).drop("_gap")


def stream_changes(stream: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, order, value) of the changes of a stream; each key's last value is the state.

    Rows of one batch are taken in order; a row that comes after its key's later ones is compared to the value it finds.
    """
    kinds = dict(stream.dtypes)

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(order)
        last = state.get[0] if state.exists else None
        first = not state.exists
        keep = []
        for v in rows[value]:
            now = None if pd.isna(v) else str(v)
            keep.append(first or now != last)
            first, last = False, now
        state.update((last,))
        yield rows.loc[keep, [key, order, value]]

    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} {kinds[value]}"
    return stream.groupBy(key).applyInPandasWithState(run, out, "last string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, *keys: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """counts by window, for a batch or a stream; a stream's rows may be `late`."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
