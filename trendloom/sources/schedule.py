"""Sources as streams: when each one is due, and the payloads that fetchers have landed.

``PollTicks`` is a stream of minutes with offsets, whose plan admits the minutes at which sources are polled;
``scheduled_polls`` names the sources of each. Payload files are read by Spark's own file stream, so that any file system that Spark
reaches will do and each file is read once, also after a restart."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
#: Minutes of a partition; between polls of one source; between the first polls of sources that follow each other.
MINUTES, EVERY, OFFSET = 1440, 15, 3


def due(minute: int) -> bool:
    """Whether any source is polled in a minute since the epoch: in every quarter hour from nine o'clock, before that in every other one."""
    of_day = minute % 1440
    return of_day >= 540 or of_day % 60 < 15 or 30 <= of_day % 60 < 45


def minute_of(text: str) -> int:
    return int((dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc) - EPOCH).total_seconds() // 60)


class MinuteRange(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


def _ranges(first: int, last: int) -> list[InputPartition]:
    return [MinuteRange(m, min(m + MINUTES, last)) for m in range(first, last, MINUTES)]


def _ticks(partition: InputPartition) -> Iterator[tuple]:
    first, last = partition.value
    for m in range(first, last):
        if due(m):
            yield EPOCH + dt.timedelta(minutes=m), m % EVERY


class _TickStream(DataSourceStreamReader):
    """Offsets are minutes: a batch holds those from the start to before the end."""

    def __init__(self, start: int, until: int | None):
        self.start, self.until = start, until

    def initialOffset(self) -> dict:
        return {"minute": self.start}

    def latestOffset(self) -> dict:
        now = int((dt.datetime.now(dt.timezone.utc) - EPOCH).total_seconds() // 60)
        return {"minute": max(self.start, now if self.until is None else min(now, self.until))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _ranges(start["minute"], end["minute"])

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _ticks(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for minutes that are done: offsets lie in the query's checkpoint."""


class _TickBatch(DataSourceReader):
    def __init__(self, start: int, until: int):
        self.start, self.until = start, until

    def partitions(self) -> list[InputPartition]:
        return _ranges(self.start, self.until)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return _ticks(partition)


class PollTicks(DataSource):
    """(due_at, slot): the minutes from ``start`` to before ``until`` (ISO times, UTC; a stream without ``until`` goes on) in which
    polls are due, and the minute's place in the quarter hour."""

    @classmethod
    def name(cls) -> str:
        return "poll_ticks"

    def schema(self) -> str:
        return "due_at timestamp, slot int"

    def _until(self) -> int | None:
        return minute_of(self.options["until"]) if "until" in self.options else None

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TickStream(minute_of(self.options["start"]), self._until())

    def reader(self, schema) -> DataSourceReader:
        return _TickBatch(minute_of(self.options["start"]), self._until() or int((dt.datetime.now(dt.timezone.utc) - EPOCH).total_seconds() // 60))


def poll_ticks(spark: SparkSession, start: str, until: str | None = None, stream: bool = True) -> DataFrame:
    spark.dataSource.register(PollTicks)
    reader = (spark.readStream if stream else spark.read).format("poll_ticks").option("start", start)
    return (reader.option("until", until) if until else reader).load()


def scheduled_polls(ticks: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_key, due_at): a poll of each source (source_key, index) in its minute of every admitted quarter hour."""
    own = sources.select("source_key", F.pmod(F.col("index") * OFFSET, F.lit(EVERY)).cast("int").alias("slot"))
    return ticks.join(own, "slot").select("source_key", "due_at")


PAYLOAD = "path string, modificationTime timestamp, length bigint, content binary"


def landed_payloads(spark: SparkSession, path: str, stream: bool = True, files_per_batch: int = 1000) -> DataFrame:
    """(source_key, body, fetched_at) of payload files ``<source_key>.<anything>`` in a folder of any file system that Spark reads;
    as a stream each file once, at most ``files_per_batch`` in a batch. An empty file has no row."""
    if stream:
        files = spark.readStream.schema(PAYLOAD).format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(path)
    else:
        files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(F.split_part(name, F.lit("."), F.lit(1)).alias("source_key"), F.decode("content", "UTF-8").alias("body"), F.col("modificationTime").alias("fetched_at"))
