import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.llm import whitening
from trendloom.llm.whitening import batch_sums, digits, exact_gram, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(ids[i] if ids else i, v, 1, 2, "x") for i, v in enumerate(vectors)], SCHEMA)


def brute(vectors, dims, k=8):
    """x, exact sums, exact covariance (as fractions), from the definition."""
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100000 for c in [*v, *[0.0] * (dims - len(v))]] for v in vectors]
    n = len(x)
    s = [sum(r[i] for r in x) for i in range(dims)]
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(dims)] for i in range(dims)])
    return x, s, cov


def check(got, vectors, dims, tolerance=1e-9):
    x, s, cov = brute(vectors, dims)
    n, e = len(x), np.linalg.eigh(cov)[0][::-1]
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(by) == list(range(1, min(8, dims) + 1))
    for k, rows in by.items():
        assert sorted(rows) == list(range(n))
        assert {r["n"] for r in rows.values()} == {n}
        for i, r in rows.items():
            d = sum((n * a - b) ** 2 for a, b in zip(x[i], s, strict=True))
            assert int(r["deviation_exact"]) == d and r["deviation"] == (d if d < 2**63 else None)
        assert abs(rows[0]["explained"] - e[k - 1] / e.sum()) <= 1e-9
    w = np.array([[by[k][i]["whitened"] for k in sorted(by)] for i in range(n)])
    assert np.abs(w.T @ w / n - np.eye(w.shape[1])).max() <= tolerance
    assert max(r["identity_error"] for r in got) <= tolerance
    # the components are eigenvectors: their projections are uncorrelated with the right variances, in the span of x
    y = np.array(x, float) - np.array(s, float) / n
    u = np.linalg.lstsq(y, w * np.sqrt(e[: w.shape[1]]), rcond=None)[0]
    assert np.abs(cov @ u - u * e[: w.shape[1]]).max() <= 1e-6 * e[0]


def test_equals_the_definition(spark):
    rnd = random.Random(2)
    vectors = [[rnd.gauss(0, 1) * (i + 1) for i in range(12)] for _ in range(300)]
    check(whiten(table(spark, vectors).repartition(5)).collect(), vectors, 12)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = sorted(docs.collect(), key=lambda r: r["vec_id"])
    got = whiten(docs).collect()
    x, s, cov = brute([r["embedding"] for r in rows], 64)
    assert len(got) == 8 * len(rows)
    e, u = np.linalg.eigh(cov)
    y = np.array(x, float) - np.array(s, float) / len(rows)
    at = {r["vec_id"]: i for i, r in enumerate(rows)}
    for r in got:
        k = 64 - r["component"]
        assert abs(abs(r["whitened"]) - abs(y[at[r["vec_id"]]] @ u[:, k] / np.sqrt(e[k]))) < 1e-8
        assert r["deviation"] == sum((len(rows) * a - b) ** 2 for a, b in zip(x[at[r["vec_id"]]], s, strict=True))


def test_odd_rows(spark):
    vectors = [[1.0, 2.0, 3.0], [0.5], [], [2.0, -1.0, 0.25], [2.0, -1.0, 0.25], [9.0, 1.0, 1.0]]
    odd = [None, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [-float("inf")]]
    got = whiten(table(spark, [*vectors, *odd])).collect()
    check(got, vectors, 3)
    ids = whiten(table(spark, vectors, [7, 7, None, None, 1, 1])).groupBy("vec_id").count().collect()
    assert sorted((r["vec_id"] or 0, r["count"]) for r in ids) == [(0, 6), (1, 6), (7, 6)]


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]] * 4, [[3.0, 4.0]], [[], []], []])
def test_without_variance(spark, vectors):
    got = whiten(table(spark, vectors)).collect()
    assert len(got) == sum(len(v) for v in vectors)
    assert all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] == 0 and r["identity_error"] is None for r in got)


def test_rank_below_the_components(spark):
    vectors = [[float(i), 2.0 * i, 5.0] for i in range(6)]
    got = whiten(table(spark, vectors)).collect()
    assert sum(r["whitened"] is not None for r in got) == 6
    assert max(r["identity_error"] for r in got) < 1e-9


def test_values_of_many_limbs(spark):
    rnd = random.Random(4)
    vectors = [[float(np.float32(rnd.choice([1, -1]) * 2.0 ** rnd.randint(0, 50))) for _ in range(4)] for _ in range(60)]
    got = whiten(table(spark, vectors)).collect()
    x, s, _ = brute(vectors, 4)
    n = len(x)
    assert {r["vec_id"]: int(r["deviation_exact"]) for r in got} == {i: sum((n * a - b) ** 2 for a, b in zip(x[i], s, strict=True)) for i in range(n)}
    assert any(r["deviation"] is None for r in got)


def test_products_and_digits_are_exact():
    rnd = np.random.default_rng(1)
    for bits in (3, 19, 20, 21, 40, 61):
        x = rnd.integers(-(1 << bits), 1 << bits, size=(50, 5))
        big = x.astype(object)
        assert (exact_gram(x) == big.T @ big).all()
        s, q = batch_sums(x)
        assert (s == big.sum(axis=0)).all() and (q == big.T @ big).all()
    full = np.full((whitening.ROWS, 2), (1 << whitening.LIMB) - 1)
    assert exact_gram(full)[0, 1] == whitening.ROWS * ((1 << whitening.LIMB) - 1) ** 2
    for v in (0, -1, 5, -(1 << 150), (1 << 200) + 12345):
        assert sum(d << whitening.DIGIT * k for k, d in enumerate(digits(v))) == v


def test_partitions_do_not_matter(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    one, many = ({(r["vec_id"], r["component"]): r for r in whiten(d).collect()} for d in (docs.coalesce(1), docs.repartition(9, F.col("vec_id"))))
    assert one.keys() == many.keys()
    for k, r in one.items():
        assert (r["deviation"], r["explained"]) == (many[k]["deviation"], many[k]["explained"]) and abs(r["whitened"] - many[k]["whitened"]) < 1e-12
