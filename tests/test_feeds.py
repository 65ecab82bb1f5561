"""Streams with state: the same rows as over a finished table, also when they stop and go on from their checkpoint."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tessellum.streaming import feeds

START = datetime.datetime(2024, 1, 1)


def moment(seconds):
    return START + datetime.timedelta(seconds=seconds)


@pytest.fixture(autouse=True)
def store(spark):
    feeds.stateful(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


class Feed:
    """A folder that turns of rows come to, and a stream over it that is stopped after each turn and started again."""

    def __init__(self, spark, tmp_path, schema, of):
        self.spark, self.path, self.schema, self.of, self.turns = spark, tmp_path, schema, of, 0

    def turn(self, *tables):
        for name, rows in zip(("one", "two"), tables, strict=False):
            self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.path / name))
        streams = [self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / name)) for name, _ in zip(("one", "two"), tables, strict=False)]
        out = self.of(*streams).writeStream.format("parquet").option("checkpointLocation", str(self.path / "checkpoint")).option("path", str(self.path / "out"))
        query = out.trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.exception() is None

    def found(self):
        return sorted((tuple(r) for r in self.spark.read.parquet(str(self.path / "out")).collect()), key=str)


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_subscription_goes_on_after_a_restart(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(rnd.choice([1, 2, None]), k, rnd.choice(["a", "b", None])) for k in range(120)]
    kind = "k long, n0 long, v string"
    feed = Feed(spark, tmp_path, kind, lambda s: feeds.subscribed(s, "k", "n0", "v"))
    for at in (0, 40, 41):
        part = rows[at : {0: 40, 40: 41, 41: 120}[at]]
        rnd.shuffle(part)
        feed.turn(part)
    want = held(feeds.subscribed(spark.createDataFrame(rows, kind), "k", "n0", "v"))
    assert feed.found() == want and sum(r[2] == "snapshot" for r in want) == 2
    by_key = sorted((r for r in want if r[0] == 1), key=lambda r: r[1])
    assert [r[1] for r in by_key] == list(range(len(by_key))) and all(a[4] != b[4] for a, b in zip(by_key, by_key[1:], strict=False))


def test_listings_come_whole_and_newest_first_after_each_change(spark, tmp_path):
    feed = Feed(spark, tmp_path, "u long, i string, c long, v string", lambda s: feeds.listings(s, "u", "i", "c", "v"))
    feed.turn([(1, "a", 5, "x"), (1, "b", 9, None), (2, "z", 1, "q")])
    feed.turn([(1, "a", 5, "x")])
    feed.turn([(1, "c", 7, "new"), (1, "a", 5, "y")])
    assert [r for r in feed.found() if r[0] == 1] == [(1, 0, 0, "b", 9, None), (1, 0, 1, "a", 5, "x"), (1, 1, 0, "b", 9, None), (1, 1, 1, "c", 7, "new"), (1, 1, 2, "a", 5, "y")]


def test_polls_end_once_by_their_predicate_or_their_time(spark, tmp_path):
    kind = "k long, ts timestamp, ok boolean"
    turns = [
        [(1, moment(0), None), (2, moment(1), False), (3, moment(2), True), (4, moment(3), False)],
        [(1, moment(50), True), (3, moment(51), True), (5, moment(52), False), (4, moment(62), None)],
        [(4, moment(63), True), (2, moment(64), True), (6, moment(100), None)],
        [(9, moment(1000), None)],
    ]
    feed = Feed(spark, tmp_path, kind, lambda s: feeds.polled(s, "k", "ts", "ok", 60))
    for rows in turns:
        feed.turn(rows)
    got = feed.found()
    assert {r[0]: (r[1], r[3]) for r in got} == {1: ("done", 50.0), 2: ("timed_out", 60.0), 3: ("done", 0.0), 4: ("timed_out", 60.0), 5: ("timed_out", 60.0), 6: ("timed_out", 60.0)}
    whole = spark.createDataFrame([r for rows in turns for r in rows], kind)
    assert got == held(feeds.polled(whole, "k", "ts", "ok", 60))
    assert {r.k for r in feeds.polled(whole, "k", "ts", "ok", 60, F.lit(moment(65))).collect()} == {1, 2, 3, 4}


def test_polls_by_the_clock(spark, tmp_path):
    kind = "k long, ts timestamp, ok boolean"
    spark.createDataFrame([(1, moment(0), False), (2, moment(0), True), (None, moment(0), True)], kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = feeds.polled(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), "k", "ts", "ok", 0.001, by_clock=True)
    query = rows.writeStream.format("memory").queryName("clock").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    for _ in range(60):  # by the clock, so batches go on until both have ended
        query.awaitTermination(1)
        if spark.sql("SELECT * FROM clock").count() == 2:
            break
    query.stop()
    assert sorted((r.k, r.outcome) for r in spark.sql("SELECT * FROM clock").collect()) == [(1, "timed_out"), (2, "done")]


def test_echoes_go_and_runs_of_edits_are_saved_once(spark, tmp_path):
    rnd = random.Random(2)
    kind = "k long, ts timestamp, v long"
    local = [(rnd.randrange(3), moment(rnd.randrange(4000) / 4), n) for n in range(80)]
    remote = [(rnd.randrange(3), moment(rnd.randrange(4000) / 4), 1000 + n) for n in range(300)]
    last = [(99, moment(90_000), -1)]

    def of(theirs, mine):
        return feeds.autosaved(feeds.without_echoes(theirs, mine, "k", "ts", 2, "20 minutes"), "k", "ts", "v", "1500 milliseconds", "20 minutes")

    feed = Feed(spark, tmp_path, kind, of)
    feed.turn(remote[:150], local[:40])
    feed.turn(remote[150:], local[40:])
    feed.turn(last, last)
    feed.turn([(98, moment(190_000), -1)], [(97, moment(190_000), -1)])
    table = lambda rows: spark.createDataFrame(rows, kind)
    kept = [r for r in remote if not any(k == r[0] and 0 <= (r[1] - t).total_seconds() < 2 for k, t, _ in local)]
    assert held(feeds.without_echoes(table(remote), table(local), "k", "ts")) == sorted(kept, key=str) and len(kept) < 295
    want = held(feeds.autosaved(table(kept), "k", "ts", "v", "1500 milliseconds"))
    assert [r for r in feed.found() if r[0] < 90] == want and sum(r[3] for r in want) == len(kept)
