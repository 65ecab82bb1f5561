"""Subscriptions, polls and autosaves over Structured Streaming, each with the same over a finished table.

State is kept a key by transformWithState, which needs the RocksDB state store (see stateful()).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(spark: SparkSession) -> None:
    """Sets the state store that the streams of this module need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _sorted(frames: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """One key's rows of a micro-batch, which the size of micro-batches bounds."""
    return pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


def _frame(**columns: Any) -> pd.DataFrame:
    """Columns of plain values, nulls among them."""
    return pd.DataFrame({name: pd.Series(list(values), dtype=object) for name, values in columns.items()})


class _Subscription(StatefulProcessor):
    def __init__(self, key: str, order: str, value: str) -> None:
        self.key, self.order, self.value = key, order, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value string, n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rows = _sorted(rows, self.order)
        value, n = self.last.get() if self.last.exists() else (None, -1)
        now = rows[self.value].astype(object).where(rows[self.value].notna(), None)
        before = pd.Series([value, *now[:-1]], dtype=object)
        changed = pd.Series([a != b for a, b in zip(now, before, strict=True)])
        if n < 0:
            changed[0] = True
        found, values = rows[self.order][changed.to_numpy()].tolist(), now[changed.to_numpy()].tolist()
        numbers = range(n + 1, n + 1 + len(found))
        self.last.update((now.iloc[-1], n + len(found)))
        kinds = ["snapshot" if k == 0 else "change" for k in numbers]
        yield _frame(**{self.key: [key[0]] * len(found), "n": numbers, "kind": kinds, self.order: found, self.value: values})

    def close(self) -> None:
        pass


def subscribed(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """F1 F2: (key, n, kind, order, value): each key's first value as a snapshot, then each change of it, numbered from 0; nulls are equal.

    A stream's rows of a micro-batch are taken in order; those that come in a later one follow, whatever their order. value is
    a text. A restart goes on from the last value of each key. Over a table it is the same of all rows in order. Rows without a
    key are left out.
    """
    rows = rows.where(F.col(key).isNotNull())
    if rows.isStreaming:
        kinds = dict(rows.dtypes)
        out = f"{key} {kinds[key]}, n long, kind string, {order} {kinds[order]}, {value} string"
        return rows.select(key, order, F.col(value).cast("string").alias(value)).groupBy(key).transformWithStateInPandas(_Subscription(key, order, value), out, "Append", "None")
    one = Window.partitionBy(key).orderBy(order)
    text = F.col(value).cast("string")
    marked = rows.select(key, order, text.alias(value), F.row_number().over(one).alias("_place"), F.lag(text).over(one).alias("_before"))
    kept = marked.where((F.col("_place") == 1) | ~F.col("_before").eqNullSafe(F.col(value)))
    n = (F.row_number().over(one) - 1).cast("long")
    return kept.select(key, n.alias("n"), F.when(F.col("_place") == 1, "snapshot").otherwise("change").alias("kind"), order, value)


class _Listing(StatefulProcessor):
    def __init__(self, owner: str, item: str, created: str, value: str) -> None:
        self.owner, self.item, self.created, self.value = owner, item, created, value

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "item string", "created long, value string")
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        changed = False
        for frame in rows:
            for item, created, value in zip(frame[self.item], frame[self.created], frame[self.value], strict=True):
                new = (int(created), None if pd.isna(value) else value)
                if not self.held.containsKey((item,)) or tuple(self.held.getValue((item,))) != new:
                    self.held.updateValue((item,), new)
                    changed = True
        if not changed and self.n.exists():
            return
        n = self.n.get()[0] + 1 if self.n.exists() else 0
        self.n.update((n,))
        every = sorted(((-held[0], name[0], held[1]) for name, held in self.held.iterator()))
        yield _frame(**{self.owner: [key[0]] * len(every), "n": [n] * len(every), "place": range(len(every)), self.item: [i for _, i, _ in every], self.created: [-c for c, _, _ in every], self.value: [v for _, _, v in every]})

    def close(self) -> None:
        pass


def listings(stream: DataFrame, owner: str, item: str, created: str, value: str) -> DataFrame:
    """F1: (owner, n, place, item, created, value): an owner's whole list, newest first, after each micro-batch that changed it, n from 0.

    item is a text, created a long. The list is what is asked for, so it is emitted whole. Rows without an owner are left out.
    """
    stream = stream.where(F.col(owner).isNotNull())
    kind = dict(stream.dtypes)[owner]
    out = f"{owner} {kind}, n long, place long, {item} string, {created} long, {value} string"
    rows = stream.select(owner, F.col(item).cast("string").alias(item), F.col(created).cast("long").alias(created), F.col(value).cast("string").alias(value))
    return rows.groupBy(owner).transformWithStateInPandas(_Listing(owner, item, created, value), out, "Append", "None")


class _Poll(StatefulProcessor):
    def __init__(self, key: str, ts: str, done: str, millis: int, waits_by_clock: bool) -> None:
        self.key, self.ts, self.done, self.millis, self.waits_by_clock = key, ts, done, millis, waits_by_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.began = handle.getValueState("began", "at long, limit long")
        self.closed = handle.getValueState("closed", "closed boolean")

    def _end(self, key: Any, outcome: str, at: int) -> pd.DataFrame:
        began, limit = self.began.get()
        self.handle.deleteTimer(limit)
        self.began.clear()
        self.closed.update((True,))
        return _frame(**{self.key: [key[0]], "outcome": [outcome], "at": [pd.Timestamp(at, unit="ms")], "waited": [(at - began) / 1000.0]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        rows = _sorted(rows, self.ts)
        if self.closed.exists():
            return
        at = rows[self.ts].astype("datetime64[ms]").astype("int64")
        if not self.began.exists():
            first = int(at.iloc[0])
            limit = (timerValues.getCurrentProcessingTimeInMs() if self.waits_by_clock else first) + self.millis
            self.began.update((first, limit))
            self.handle.registerTimer(limit)
        began, limit = self.began.get()
        last = began + self.millis
        met = at[rows[self.done].eq(True).fillna(False).astype(bool) & ((at < last) | self.waits_by_clock)]
        if len(met):
            yield self._end(key, "done", int(met.iloc[0]))
        elif not self.waits_by_clock and (at >= last).any():
            yield self._end(key, "timed_out", last)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.began.exists():
            yield self._end(key, "timed_out", self.began.get()[0] + self.millis)

    def close(self) -> None:
        pass


def polled(rows: DataFrame, key: str, ts: str, done: str, seconds: float, now: Column | None = None, late: str = "0 seconds", by_clock: bool = False) -> DataFrame:
    """(key, outcome, at, waited seconds): one row a key, when its poll ends: `done` at its first row that is, if that comes within
    `seconds` of the key's first row, else `timed_out` when they are over. A null is not done; later rows of the key are ignored.

    Over a stream the timer goes off when the watermark, `late` behind the newest row, passes it, or by the clock of the
    machine. Over a table, polls whose time is not over at `now`, by default the last row's, are open and have no row.
    Times count in milliseconds. Rows without a key are left out.
    """
    rows = rows.where(F.col(key).isNotNull())
    millis = int(seconds * 1000)
    at = F.timestamp_millis(F.unix_millis(F.col(ts).cast("timestamp")))
    if rows.isStreaming:
        given = rows.select(key, F.col(ts).cast("timestamp").alias(ts), F.col(done).cast("boolean").alias(done))
        if not by_clock:
            given = given.withWatermark(ts, late)
        out = f"{key} {dict(rows.dtypes)[key]}, outcome string, at timestamp, waited double"
        return given.groupBy(key).transformWithStateInPandas(_Poll(key, ts, done, millis, by_clock), out, "Append", "ProcessingTime" if by_clock else "EventTime")
    each = rows.select(key, at.alias("_at"), F.coalesce(F.col(done).cast("boolean"), F.lit(False)).alias("_done"))
    until = each.agg(F.max("_at").alias("_now")) if now is None else rows.sparkSession.range(1).select(now.cast("timestamp").alias("_now"))
    first = each.groupBy(key).agg(F.min("_at").alias("_first"))
    limit = F.timestamp_millis(F.unix_millis("_first") + F.lit(millis))
    # a key's rows and its first one; the table of now has one row
    met = each.where("_done").join(first, key).where(F.col("_at") < limit).groupBy(key).agg(F.min("_at").alias("_met"))
    told = first.join(met, key, "left").crossJoin(F.broadcast(until)).withColumn("_limit", limit)
    ended = told.where(F.col("_met").isNotNull() | (F.col("_limit") <= F.col("_now"))).withColumn("at", F.coalesce("_met", "_limit"))
    waited = (F.unix_millis("at") - F.unix_millis("_first")) / F.lit(1000.0)
    return ended.select(key, F.when(F.col("_met").isNotNull(), "done").otherwise("timed_out").alias("outcome"), "at", waited.alias("waited"))


def without_echoes(remote: DataFrame, local: DataFrame, key: str, ts: str, seconds: float = 2, late: str = "10 minutes") -> DataFrame:
    """the remote edits (key, ts, ...) but those of less than `seconds` after a local edit of their key, the same moment included.

    Two streams are joined by time with watermarks `late` behind; an edit comes out when no local one can match it any more.
    """
    mine = local.select(F.col(key).alias("_key"), F.col(ts).cast("timestamp").alias("_ts"))
    streaming = remote.isStreaming or local.isStreaming
    if streaming:
        remote, mine = remote.withWatermark(ts, late), mine.withWatermark("_ts", late)
    span = F.expr(f"INTERVAL {int(seconds * 1_000_000)} MICROSECONDS")
    echo = (F.col(key) == F.col("_key")) & (F.col(ts) >= F.col("_ts")) & (F.col(ts) < F.col("_ts") + span)
    if not streaming:
        return remote.join(mine, echo, "left_anti")
    return remote.join(mine, echo, "left_outer").where("_key IS NULL").drop("_key", "_ts")


def autosaved(edits: DataFrame, key: str, ts: str, value: str, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """(key, at, value, edits): the last edit of each run of edits that follow each other within the gap, and how many they were.

    Of edits of one moment the greatest value is the last. Over a stream a run comes out when the watermark has passed it.
    """
    # a second watermark above a join would hold back the first
    known = "spark.watermarkDelayMs" in edits.schema[ts].metadata
    rows = edits.withWatermark(ts, late) if edits.isStreaming and not known else edits
    last = F.max(F.struct(F.col(ts).alias("at"), F.col(value).alias("value")))
    runs = rows.groupBy(F.session_window(ts, gap), key).agg(last.alias("last"), F.count("*").alias("edits"))
    return runs.select(key, "last.at", F.col("last.value").alias(value), "edits")
