"""The stages together, each against the plain statement of what it must do."""

import collections
import random
import re

import pytest

import corpus_pipeline


def prose(r, n):
    out = []
    for i in range(n):
        out.append("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) + (".\n" if r.random() < 0.03 else "." if r.random() < 0.1 else ""))
    return " ".join(out)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    r = random.Random(4)
    folder = tmp_path_factory.mktemp("sf")
    item = prose(r, 45)
    passage = prose(r, 80)
    rows = [(i, prose(r, r.randrange(80, 300)), "en", f"s{i % 2}") for i in range(240)]
    rows += [(1000, rows[3][1], "en", "s0"), (1001, rows[4][1] + " tail", "en", "s1"), (1002, "too short", "en", "s0"), (1003, " ".join(w.upper() + "!!" for w in prose(r, 200).split()), "en", "s0")]
    rows += [(1010 + i, prose(r, 100) + " " + passage + " " + prose(r, 60), "en", "s1") for i in range(3)]
    rows += [(1020, prose(r, 90) + " " + item + " " + prose(r, 40), "en", "s0"), (1021, None, None, None), (1022, "", "en", "s0")]
    data = [(i, t, g, s, len(t) if t is not None else None) for i, t, g, s in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {x[0]: x[1] for x in rows}, item, passage


def test_stages(spark, sf):
    folder, text, item, passage = sf
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs = corpus_pipeline.checkpoint(docs)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            kept[name] = {x.doc_id: x.text for x in docs.collect()}
    assert set(range(240)) <= set(kept["quality"]) and not {1002, 1003, 1021, 1022} & set(kept["quality"])
    assert set(kept["quality"]) - set(kept["near_dedup"]) == {1000, 1001}
    bare = lambda x: re.sub(r"\s+", " ", x)
    has = collections.Counter(bare(passage) in bare(t) for i, t in kept["substring_dedup"].items() if 1010 <= i < 1013)
    assert has[True] == 1 and all(kept["substring_dedup"][i] == text[i] for i in range(240))
    assert set(kept["substring_dedup"]) - set(kept["decontamination"]) == {1020}
    pieces = docs.collect()
    assert {p.doc_id for p in pieces} == set(kept["decontamination"]) and all(p.length <= 2048 for p in pieces)
    whole = sorted((p.doc_id, p.piece, p.ids_crc32) for p in pieces)
    assert sorted((p.doc_id, p.piece, p.ids_crc32) for p in corpus_pipeline.run(spark, folder).collect()) == whole


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    """One row in is one row out or none, whatever the ids."""
    r = random.Random(8)
    a, b, c, long = (prose(r, n) for n in (120, 150, 130, 20_000))
    passage = prose(r, 80)
    rows = [(i, prose(r, r.randrange(80, 200)), "en", "s0") for i in range(60)]
    rows += [(100, a, "en", "s0"), (100, a, "en", "s0"), (101, b, "en", "s0"), (101, c, "en", "s1"), (101, "too short", "en", "s1")]
    rows += [(None, prose(r, 140) + " " + passage, "en", "s0"), (None, prose(r, 90) + " " + passage, None, None), (102, long, "en", "s0"), (103, None, "en", "s0"), (103, "", "en", "s0")]
    data = [(i, t, g, s, len(t) if t is not None else None, "x", 7) for i, t, g, s in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, d2 int"
    spark.createDataFrame([(1, prose(r, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(data, schema)
    want = collections.Counter((i, t) for i, t, _, _ in rows if t and len(t.split()) >= 50)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.checkpoint(stage(spark, docs, str(tmp_path)))
        got = collections.Counter((x.doc_id, x.text) for x in docs.collect())
        if name == "near_dedup":
            want[100, a] = 1
        if name in ("quality", "near_dedup"):
            assert got == want, name
        assert sum(got.values()) == sum(want.values()), name
    cut = [x.text for x in docs.collect() if x.doc_id is None]
    assert sorted(passage.split()[5] in t for t in cut) == [False, True] or sum(passage[10:80] in t for t in cut) == 1
    assert corpus_pipeline.packing(spark, docs, str(tmp_path)).filter("piece = 0").count() == sum(want.values())


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == 0, name
