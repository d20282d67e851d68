"""Keyed state with timers: pauses of sources by their failures, and words that stay pending until they expire.

Both are ``transformWithState`` processors over event time. Times travel as microseconds, so that no time zone of a worker
matters. The rows of one key of a batch are taken in time order, as arrays; a restart from the checkpoint goes on where it stopped."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# fixed values: seconds of pause by error class, from the low one to below the high one
PAUSES = {"banned": (21_600, 43_200), "cookie_expired": (21_600, 43_200), "rate_limited": (3_600, 7_200), "empty": (1_800, 3_600)}
# fixed values: plain errors pause from the third failure in a row on, half an hour for each failure, of at most twelve
PLAIN_FROM, PLAIN_SECONDS, PLAIN_MOST = 3, 1_800, 12
SECOND = 1_000_000


def use_state_store(spark: SparkSession) -> None:
    """The state store that keyed state needs; a session of a cluster may have set it already."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def spread(key: str, at: int, low: int, high: int) -> int:
    """A number from low to below high, the same whenever it is drawn again."""
    return low + int(hashlib.md5(f"{key}:{at}".encode()).hexdigest()[:8], 16) % (high - low)


def spread_column(key: Column, at: Column, low: int, high: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), at)), 1, 8), 16, 10).cast("bigint") % (high - low) + low


def pause_seconds(key: str, at: int, error: str, failures: int) -> int:
    """Seconds that a source pauses after its failures in a row, the last one of a class at a time; 0 for none."""
    if error in PAUSES:
        return spread(key, at, *PAUSES[error])
    return PLAIN_SECONDS * min(failures, PLAIN_MOST) if failures >= PLAIN_FROM else 0


class Backoff(StatefulProcessor):
    """Polls of a source: allowed outside its pause; of the allowed ones failures count and begin pauses, a success ends both."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pause", "failures int, until long, timer long")

    @staticmethod
    def _released(key: str, at: list[int], failures: list[int]) -> pd.DataFrame:
        none = [None] * len(at)
        return pd.DataFrame({"source_key": key, "poll": pd.array(none, "Int64"), "at": at, "event": "released", "allowed": pd.array(none, "boolean"), "in_a_row": failures, "until": pd.array(none, "Int64")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, until, timer = self.state.get() if self.state.exists() else (0, 0, 0)
        r = pd.concat(list(rows), ignore_index=True)
        order = np.lexsort((r["poll"].to_numpy(), np.unique(r["error"].fillna("").to_numpy(str), return_inverse=True)[1], r["at"].to_numpy()))
        r = r.iloc[order]
        at, good, errors = r["at"].to_numpy(), r["error"].isna().to_numpy(), r["error"].to_numpy()
        allowed, in_a_row, ends = np.zeros(len(at), bool), np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        over: list[tuple[int, int]] = []
        i = 0
        while i < len(at):
            if at[i] < until:  # all polls within the pause at once
                j = int(np.searchsorted(at, until))
                in_a_row[i:j], ends[i:j] = failures, until
                i = j
                continue
            if until:
                over.append((until, failures))
            failures = 0 if good[i] else failures + 1
            seconds = 0 if good[i] else pause_seconds(key[0], int(at[i]), errors[i], failures)
            until = int(at[i]) + seconds * SECOND if seconds else 0
            allowed[i], in_a_row[i], ends[i] = True, failures, until
            i += 1
        yield pd.DataFrame({"source_key": key[0], "poll": r["poll"].to_numpy(), "at": at, "event": "poll", "allowed": allowed, "in_a_row": in_a_row, "until": pd.Series(ends, dtype="Int64").mask(ends == 0)})
        if over:
            yield self._released(key[0], *map(list, zip(*over, strict=True)))
        if timer and timer != until:
            self.handle.deleteTimer(-(-timer // 1000))
        if until and timer != until:
            self.handle.registerTimer(-(-until // 1000))
        self.state.update((failures, until, until))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, until, _ = self.state.get() if self.state.exists() else (0, 0, 0)
        if until and -(-until // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((failures, 0, 0))
            yield self._released(key[0], [until], [failures])

    def close(self) -> None:
        pass


def backoff_stream(polls: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Of polls (source_key, poll, polled_at, error; a null error is a success) as a stream: (source_key, poll, at, event, allowed, in_a_row, until).

    ``event`` is "poll" for each poll, and "released" when a pause ends: at the first poll after it, or when the watermark
    passes it, whichever is first. A poll within a pause is not allowed and changes nothing."""
    use_state_store(polls.sparkSession)
    rows = polls.withWatermark("polled_at", delay).select("source_key", F.col("poll").cast("bigint").alias("poll"), "polled_at", F.unix_micros("polled_at").alias("at"), "error")
    out = rows.groupBy("source_key").transformWithStateInPandas(Backoff(), "source_key string, poll long, at long, event string, allowed boolean, in_a_row int, until long", "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", "until")})


class Pending(StatefulProcessor):
    """A word stays pending until nobody has seen it for ``ttl`` seconds."""

    def __init__(self, ttl: int):
        self.ttl = ttl * SECOND

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("seen", "first long, last long, hits long")

    def _timer(self, last: int) -> int:
        return -(-(last + self.ttl) // 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        before = held[1] if held else None
        r = pd.concat([b[["at", "hits"]] for b in rows], ignore_index=True).sort_values("at", kind="stable")
        at, hits = r["at"].to_numpy(), r["hits"].to_numpy()
        earlier = np.r_[at[0] if before is None else before, at[:-1]]
        cut = np.flatnonzero(at > (earlier if before is None else np.maximum(earlier, before)) + self.ttl)
        begin = np.union1d(cut, [0])
        firsts, lasts, sums = at[begin], at[np.r_[begin[1:], len(at)] - 1], np.add.reduceat(hits, begin)
        if held and len(cut) and cut[0] == 0:  # it had expired before its first sighting here
            firsts, lasts, sums = np.r_[held[0], firsts], np.r_[held[1], lasts], np.r_[held[2], sums]
        elif held:
            firsts[0], lasts[0], sums[0] = min(firsts[0], held[0]), max(lasts[0], held[1]), sums[0] + held[2]
        told = pd.DataFrame({"word": key[0], "event": "expired", "first_seen": firsts, "last_seen": lasts, "hits": sums, "at": lasts + self.ttl})
        first, last, hits = int(firsts[-1]), int(lasts[-1]), int(sums[-1])
        told.loc[len(told) - 1, ["event", "at"]] = "pending", last
        yield told
        if before is not None and before != last:
            self.handle.deleteTimer(self._timer(before))
        if before != last:
            self.handle.registerTimer(self._timer(last))
        self.state.update((first, last, hits))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        first, last, hits = self.state.get()
        if self._timer(last) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield pd.DataFrame({"word": [key[0]], "event": "expired", "first_seen": first, "last_seen": last, "hits": hits, "at": last + self.ttl})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        first, last, hits = (int(initialState[c].iloc[0]) for c in ("first", "last", "hits"))
        self.state.update((first, last, hits))
        self.handle.registerTimer(self._timer(last))

    def close(self) -> None:
        pass


def pending_words(seen: DataFrame, ttl: int, delay: str = "0 seconds", initial: DataFrame | None = None) -> DataFrame:
    """Of words as they are discovered (word, seen_at, hits) as a stream: (word, event, first_seen, last_seen, hits, at).

    Each batch tells a word that it holds as "pending" with all its hits so far, and "expired" once when it has not been seen
    for ``ttl`` seconds; later it begins anew. ``initial`` are words pending from before (word, first_seen, last_seen, hits)."""
    use_state_store(seen.sparkSession)
    rows = seen.withWatermark("seen_at", delay).select("word", "seen_at", F.unix_micros("seen_at").alias("at"), F.col("hits").cast("bigint").alias("hits"))
    start = None
    if initial is not None:
        start = initial.select("word", F.unix_micros("first_seen").alias("first"), F.unix_micros("last_seen").alias("last"), F.col("hits").cast("bigint").alias("hits")).groupBy("word")
    out = rows.groupBy("word").transformWithStateInPandas(Pending(ttl), "word string, event string, first_seen long, last_seen long, hits long, at long", "Append", "EventTime", start)
    return out.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen", "at")})
