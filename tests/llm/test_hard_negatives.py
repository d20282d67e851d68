import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm import hard_negatives
from trendloom.llm.hard_negatives import mine_hard_negatives, products
from trendloom.llm.queries import HARD_NEGATIVES_SQL, op11_hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, a string, score long"


def brute(rows, every=50, k=5, m=3):
    """Rows of the result from the definition; repeated ids are rows of their own."""
    good = [(i, lab, [math.floor(256 * x) for x in v]) for i, v, lab, *_ in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, lab, v in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, other) for j, other, w in good)
        for s, j, _ in [x for x in scored if x[2] == lab and x[1] != i][:k]:
            found = [x for x in scored if x[2] != lab and 50 * -s <= 100 * -x[0] <= 95 * -s][:m]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(found)]
    return sorted(out)


def run(spark, rows):
    return sorted(tuple(r) for r in mine_hard_negatives(spark.createDataFrame(rows, SCHEMA), F.pmod("id", F.lit(50)) == 0).collect())


def vectors(rnd, n, dims=6, copies=0.3):
    pool = [[rnd.gauss(0, 1) for _ in range(dims)] for _ in range(max(1, int(n * (1 - copies))))]
    return [(i, rnd.choice(pool), rnd.randint(0, 3), "x", 1) for i in range(n)]


@pytest.mark.parametrize(("few", "bits", "tile", "block", "size"), [(64, 12, 8192, 1024, 10**9), (3, 2, 7, 2, 10**9), (5, 5, 40, 3, 0)])
def test_equals_brute_force(spark, monkeypatch, few, bits, tile, block, size):
    for k, v in {"FEW": few, "BITS": bits, "TILE": tile, "BLOCK": block, "BROADCAST_BYTES": size}.items():
        monkeypatch.setattr(hard_negatives, k, v)
    rows = vectors(random.Random(bits), 260)
    # a vector that a third of the rows have, of several labels
    rows += [(1000 + i, rows[0][1], i % 3, None, None) for i in range(130)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    v = [1.0, 0.5]
    rows = [(0, v, 1, "", 0), (0, v, 1, "", 0), (1, v, 1, "", 0), (2, v, 1, "", 0), (2, [2.0], 1, "", 0), (3, [0.8, 0.4], 2, "", 0), (3, [0.8, 0.4], 2, "", 0), (4, [], 2, "", 0), (50, [-1.0, -0.5, 7.0], 1, "", 0), (-50, [0.7, 0.7], 2, "", 0)]
    odd = [(None, v, 1, "", 0), (6, None, 1, "", 0), (7, v, None, "", 0), (8, [None, 1.0], 1, "", 0), (9, [float("nan")], 1, "", 0), (100, [float("inf"), 1.0], 1, "", 0)]
    assert run(spark, [*rows, *odd]) == brute(rows)


def test_no_rows_and_no_anchors(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0], 1, "", 0), (2, [1.0], 2, "", 0)]) == []
    assert run(spark, [(50, [1.0], 1, "", 0)]) == []
    assert run(spark, [(50, [], 1, "", 0), (51, [], 1, "", 0), (52, [], 2, "", 0)]) == [(50, 51, 1, 52, 0, 0)]
    assert run(spark, [(50, [0.0], 1, "", 0), (51, [0.0], 1, "", 0), (52, [0.0], 2, "", 0)]) == [(50, 51, 1, 52, 0, 0)]


def test_query_and_sql_equal_brute_force(spark):
    path = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in op11_hard_negatives(spark, path).collect())
    table = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    expected = brute([(r["vec_id"], [float(x) for x in r["embedding"]], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in table])
    assert got == expected
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet'")
    assert sorted(con.execute(HARD_NEGATIVES_SQL).fetchall()) == expected


def test_large_components(spark):
    rows = [(i, [x * 1e6 for x in v], lab, a, s) for i, v, lab, a, s in vectors(random.Random(9), 120)]
    assert run(spark, rows) == brute(rows)
    a = np.array([[2**40, 3]])
    with pytest.raises(ArithmeticError):
        products(a, a, 2**40, 2**40)
