import re

import duckdb

from trendloom.llm.licence_scan import LICENCES, oracle_sql, scan_licences

SCHEMA = "doc_id long, text string, licence string, digest int"


def test_forms_of_one_text_match(spark):
    mit = LICENCES["MIT"]
    rows = [
        (1, mit),
        (2, "Copyright (c) 2019 Some One\n\n" + mit),
        (3, "The licence".replace("The licence", "") + mit.upper().replace("\n\n", "\r\n").replace(" ", "   ").replace("SUBLICENSE", "sub-licence")),
        (4, mit + " And more."),
        (5, None),
        (6, ""),
        (7, " .,;\n"),
        (8, "Copyright 2020 X\nAll rights reserved.\n"),
        (9, "released under the MIT licence"),
        (10, mit * 500),
        (1, mit),
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = scan_licences(docs).collect()
    assert len(got) == len(rows)
    by = {x.doc_id: x.licence for x in got}
    assert by == {1: "MIT", 2: "MIT", 3: "MIT", 4: None, 5: None, 6: None, 7: None, 8: None, 9: "MIT-notice", 10: None}
    assert all(x.is_licence == (x.licence is not None) for x in got)
    assert {x.doc_id for x in got if x.digest is None} == {5, 6, 7, 8}
    c = duckdb.connect()
    c.execute("create table documents(doc_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", rows)
    assert sorted(c.sql(oracle_sql()).fetchall(), key=str) == sorted(((x.doc_id, x.digest, x.licence, x.is_licence) for x in got), key=str)
    assert scan_licences(docs.limit(0)).count() == 0


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert not re.search("Python|Pandas|Arrow", scan_licences(docs)._jdf.queryExecution().executedPlan().toString())


def test_every_known_text_is_found(spark):
    """Each text with a notice of its holder before it, by its own name; a known table too large to broadcast gives the same."""
    from trendloom.llm import licence_scan as L

    rows = [(i, f"Copyright (c) 20{i:02d} Someone\nAll rights reserved.\n\n{t}") for i, (_, t) in enumerate(L.known_texts())]
    names = [k for k, _ in L.known_texts()]
    rows += [(1000 + i, t) for i, t in enumerate([None] * 50 + [L.LICENCES["MIT"]] * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (L.BROADCAST_ROWS, 3):
        old, L.BROADCAST_ROWS = L.BROADCAST_ROWS, most
        got = {x.doc_id: x.licence for x in scan_licences(docs).collect()}
        L.BROADCAST_ROWS = old
        assert [got[i] for i in range(len(names))] == names
        assert [got[1000 + i] for i in range(100)] == [None] * 50 + ["MIT"] * 50


def test_digests_of_long_licences(spark):
    """Where the system has the texts, their digests are the known ones."""
    from pathlib import Path

    from trendloom.llm.licence_scan import DIGESTS

    folder = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}
    rows = [(k, (folder / f).read_text()) for k, f in files.items() if (folder / f).exists()]
    got = scan_licences(spark.createDataFrame(rows, "name string, text string"), id_col="name").collect() if rows else []
    assert all(x.licence == x.name for x in got)
    assert all(len(d) == 64 for ds in DIGESTS.values() for d in ds)
