import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from trendloom.streaming import jobs
from trendloom.streaming import keyed_state as K

T0 = dt.datetime(2024, 1, 1)
POLLS = "source_key string, poll long, polled_at timestamp, error string"
SEEN = "word string, seen_at timestamp, hits int"


def micros(t):
    return (t - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)


def land(spark, rows, schema, folder, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{name}")


def run(spark, stream, folder, once=False):
    w = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append")
    w.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


def plain_backoff(rows):
    """(poll, allowed, in a row, until), and the ends of pauses, from the rules."""
    state, out, ends = {}, [], []
    for key, poll, at, error in sorted(rows, key=lambda r: (r[2], r[3] or "", r[1])):
        fails, until = state.get(key, (0, None))
        at = micros(at)
        ok = until is None or at >= until
        if ok:
            if until is not None:
                ends.append((key, until))
            fails = fails + 1 if error else 0
            pause = 0
            if error in K.PAUSES:
                low, high = K.PAUSES[error]
                pause = K.spread(key, at, low, high)
                assert low <= pause < high
            elif error and fails >= 3:
                pause = 1800 * min(fails, 12)
            until = at + pause * 10**6 if pause else None
        state[key] = fails, until
        out.append((poll, ok, fails, until))
    return sorted(out), sorted(ends), {k: u for k, (_, u) in state.items() if u}


def polls(n=300):
    rnd = random.Random(4)
    at = [T0 + dt.timedelta(minutes=rnd.randint(0, 20_000)) for _ in range(n)]
    return sorted(((rnd.choice("ab") if rnd.random() < 0.9 else "c", i, t, rnd.choice([None, None, "banned", "empty", "timeout", "timeout", "rate_limited"])) for i, t in enumerate(at)), key=lambda r: r[2])


@pytest.mark.parametrize("parts", [1, 5])
def test_backoff_equals_the_rules(spark, tmp_path, parts):
    rows = polls()
    for i in range(parts):
        land(spark, rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], POLLS, tmp_path, f"p{i}")
    got = run(spark, K.backoff_stream(source(spark, tmp_path, POLLS)), tmp_path)
    expected, ends, open_ = plain_backoff(rows)
    assert sorted((r["poll"], r["allowed"], r["in_a_row"], r["until"] and micros(r["until"])) for r in got if r["event"] == "poll") == expected
    released = sorted((r["source_key"], micros(r["at"])) for r in got if r["event"] == "released")
    # the watermark has passed some of the pauses that no poll has ended
    assert set(ends) <= set(released) <= set(ends) | set(open_.items()) and len(set(released)) == len(released)


def test_a_pause_is_released_by_its_timer(spark, tmp_path):
    land(spark, [("a", 1, T0, "rate_limited"), ("b", 2, T0, None)], POLLS, tmp_path, "p0")
    land(spark, [("b", 3, T0 + dt.timedelta(hours=9), None)], POLLS, tmp_path, "p1")
    land(spark, [("b", 4, T0 + dt.timedelta(hours=10), None)], POLLS, tmp_path, "p2")
    got = run(spark, K.backoff_stream(source(spark, tmp_path, POLLS)), tmp_path)
    (end,) = [r for r in got if r["event"] == "released"]
    assert end["source_key"] == "a" and T0 + dt.timedelta(hours=1) <= end["at"] < T0 + dt.timedelta(hours=2)


def test_backoff_after_a_restart(spark, tmp_path):
    rows = polls(120)
    stream = lambda: K.backoff_stream(source(spark, tmp_path, POLLS))
    for i in range(3):
        land(spark, rows[i * 40 : (i + 1) * 40], POLLS, tmp_path, f"p{i}")
        got = run(spark, stream(), tmp_path)  # a new query from the checkpoint each time
    assert sorted((r["poll"], r["allowed"], r["in_a_row"], r["until"] and micros(r["until"])) for r in got if r["event"] == "poll") == plain_backoff(rows)[0]


def test_until_as_a_column(spark):
    rows = [("a", T0, e, n) for e in ("banned", "timeout", None, "empty") for n in (1, 3, 20)]
    got = spark.createDataFrame(rows, "k string, t timestamp, e string, n int").select("*", jobs.backoff_until(F.col("k"), F.col("e"), F.col("t"), F.col("n")).alias("u")).collect()
    for r in got:
        seconds = K.pause_seconds("a", micros(T0), r["e"], r["n"]) if r["e"] else 0
        assert r["u"] == (T0 + dt.timedelta(seconds=seconds) if seconds else None)
    assert [K.pause_seconds("a", 0, "timeout", n) for n in (1, 2, 3, 12, 40)] == [0, 0, 5400, 21600, 21600]


def test_words_survive_windows_and_expire(spark, tmp_path):
    hour = dt.timedelta(hours=1)
    batches = [[("x", T0, 1), ("y", T0, 2)], [("x", T0 + 5 * hour, 1)], [("z", T0 + 11 * hour, 1)], [("z", T0 + 30 * hour, 1), ("y", T0 + 31 * hour, 5)], [("end", T0 + 100 * hour, 1)], [("end", T0 + 101 * hour, 1)]]
    initial = spark.createDataFrame([("w", T0 - 3 * hour, T0 - hour, 7), ("x", T0 - 2 * hour, T0 - hour, 3)], "word string, first_seen timestamp, last_seen timestamp, hits int")
    stream = lambda: K.pending_words(source(spark, tmp_path, SEEN), 10 * 3600, initial=initial)
    for i, rows in enumerate(batches):
        land(spark, rows, SEEN, tmp_path, f"p{i}")
        if i in (1, 3, 5):  # restarts in between
            got = run(spark, stream(), tmp_path)
    expired = sorted((r["word"], (r["first_seen"] - T0) / hour, (r["last_seen"] - T0) / hour, r["hits"], (r["at"] - T0) / hour) for r in got if r["event"] == "expired")
    assert expired == [("w", -3, -1, 7, 9), ("x", -2, 5, 5, 15), ("y", 0, 0, 2, 10), ("y", 31, 31, 5, 41), ("z", 11, 11, 1, 21), ("z", 30, 30, 1, 40)]
    assert {(r["word"], r["hits"]) for r in got if r["event"] == "pending"} >= {("x", 4), ("x", 5), ("y", 5)}


class _State:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    def getValueState(self, *_):  # noqa: N802
        return _State()

    def registerTimer(self, at):  # noqa: N802
        pass

    deleteTimer = registerTimer  # noqa: N815


def test_rows_of_a_key_are_taken_as_arrays():
    """A million polls, or sightings, of one key take few steps: those within a pause, or without a gap, go at once."""
    import time

    import pandas as pd

    n, begin = 1_000_000, micros(T0)
    rows = pd.DataFrame({"poll": range(n), "at": begin + pd.Series(range(n)) * 10_000, "error": "banned", "hits": 1})
    backoff, pending = K.Backoff(), K.Pending(3600)
    backoff.init(_Handle())
    pending.init(_Handle())
    start = time.process_time()
    polls_ = next(backoff.handleInputRows(("a",), iter([rows[: n // 2], rows[n // 2 :]]), None))
    (words,) = pending.handleInputRows(("w",), iter([rows]), None)
    assert len(polls_) == n and polls_["allowed"].sum() == 1 and polls_["until"].nunique() == 1
    assert words[["event", "hits"]].values.tolist() == [["pending", n]] and time.process_time() - start < 5
