import datetime as dt
import hashlib

import pytest

from trendloom.sources import schedule as S

UTC = dt.timezone.utc


def plain(start, until):
    out, t = [], start
    while t < until:
        if t.hour >= 9 or t.minute < 15 or 30 <= t.minute < 45:
            out.append((t, t.minute % 15))
        t += dt.timedelta(minutes=1)
    return out


def told(spark, stream, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out").collect()


def test_ticks_as_a_batch_and_as_a_stream_with_restarts(spark, tmp_path):
    first, last = dt.datetime(2024, 1, 1, 7, 50), dt.datetime(2024, 1, 3, 10, 7)
    want = plain(first, last)
    assert sorted((r["due_at"], r["slot"]) for r in S.poll_ticks(spark, first.isoformat(), last.isoformat(), stream=False).collect()) == want
    for until in (first, dt.datetime(2024, 1, 1, 9, 3), last, last):  # a new query from the checkpoint each time
        got = told(spark, S.poll_ticks(spark, first.isoformat(), until.isoformat()), tmp_path)
        assert sorted((r["due_at"], r["slot"]) for r in got) == plain(first, until)


def test_polls_of_sources(spark):
    sources = spark.createDataFrame([("a", 0), ("b", 1), ("c", 5), ("d", 6)], "source_key string, index int")
    got = S.scheduled_polls(S.poll_ticks(spark, "2024-01-01T09:00:00", "2024-01-01T10:00:00", stream=False), sources).collect()
    assert sorted((r["source_key"], r["due_at"].minute) for r in got) == sorted((s, m) for s, o in (("a", 0), ("b", 3), ("c", 0), ("d", 3)) for m in range(o, 60, 15))


@pytest.mark.parametrize("per_batch", [1, 1000])
def test_payloads_are_read_once(spark, tmp_path, per_batch):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {"zhihu.1.json": "{}", "weibo.2.html": "北京\n", "zhihu.3.json": "[]", "zhihu.4.json": ""}
    for i, (name, text) in enumerate(texts.items()):
        (folder / name).write_text(text, encoding="utf-8")
        if i != 1:  # a restart in the midst
            got = told(spark, S.landed_payloads(spark, str(folder), files_per_batch=per_batch), tmp_path)
    assert sorted((r["source_key"], r["body"]) for r in got) == sorted((n.split(".")[0], t) for n, t in texts.items() if t)
    assert S.landed_payloads(spark, str(folder), stream=False).count() == 3


def test_batches_of_landed_bodies_do_not_grow_with_files(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from trendloom.operators.graph import shared_folder
    from trendloom.plans import stream_queries

    monkeypatch.setattr(stream_queries, "MOST_BATCHES", 2)
    spark.createDataFrame([(100 * i + j, f"part {i} {j}") for i in range(20) for j in (1, 0)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    folder = Path(shared_folder(spark))
    before = set(folder.iterdir())
    got = sorted(r["digest"] for r in stream_queries.landed_bodies(spark, str(tmp_path)).collect())
    assert got == sorted(hashlib.md5(f"part {i} 0\npart {i} 1\n".encode()).hexdigest() for i in range(20))
    (checkpoint,) = (p for p in set(folder.iterdir()) - before if p.name.endswith("-checkpoint"))
    assert len([p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()]) == 2
