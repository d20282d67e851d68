import random

import numpy as np
import pytest

import trendloom.llm.components as module
from trendloom.llm import near_dedup
from trendloom.llm.components import connected_components
from trendloom.llm.near_dedup import near_duplicates

SCHEMA = "doc_id long, text string, a string, component_id int"


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) > k else frozenset([tuple(w)] if w else [])


def expected(rows, k):
    sets = {i: shingles(t, k) for i, t in rows}
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, x in enumerate(ids):
        for y in ids[:n]:
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= 80 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                comp[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def texts(r):
    vocabulary = ["w%d" % i for i in range(400)]
    rows = []
    for _ in range(40):
        base = [r.choice(vocabulary) for _ in range(r.randrange(3, 120))]
        for _ in range(r.choice([1, 1, 2, 12])):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 12)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append(" ".join(w))
    return rows


def test_equals_brute_force(spark):
    r = random.Random(8)
    rows = list(enumerate(texts(r)))
    r.shuffle(rows)
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (5004, "ONE"), (5005, "Two words"), (5006, "é two"), (5007, "É two")]
    rows += [(6000 + i, "the same text over and over again here") for i in range(300)]
    rows += [(7000, " ".join("v%d" % i for i in range(30000))), (7001, " ".join("v%d" % i for i in range(29000)))]
    for k in (2, 5):
        docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
        got = {x.doc_id: x for x in near_duplicates(docs, k=k).collect()}
        want = expected(rows, k)
        assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == want
        assert all(x.kept == (x.doc_id == x.component_id) for x in got.values())


def cloud(r, n, keep, size=260, vocabulary=100_000):
    """Rows that share about ``keep`` of their words with one base, and by chance links between them."""
    base = [r.randrange(vocabulary) for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for i in r.sample(range(size), int(size * (1 - keep) * r.uniform(0.8, 1.1))):
            w[i] = r.randrange(vocabulary)
        out.append(" ".join("w%d" % x for x in w))
    return out


@pytest.mark.parametrize("comparisons", [None, 3000])
def test_crowded_regions(spark, monkeypatch, comparisons):
    """A cloud in which hardly any rows link, a hub of near copies, rows at its rim, across many partitions."""
    monkeypatch.setattr(near_dedup, "PER_TASK", 2000)
    r = random.Random(21)
    rows = cloud(r, 220, 0.96)  # about 0.72 to 0.85 between two
    hub = cloud(r, 1, 1.0)[0].split()
    for n in [2] * 150 + [9, 10, 11, 12, 13] * 8:
        w = list(hub)
        for i in r.sample(range(len(w)), n):
            w[i] = "x%d" % r.randrange(10**6)
        rows.append(" ".join(w))
    rows = list(enumerate(rows))
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), k=2, comparisons=comparisons).collect()}
    want = {i: c for i, (_, c) in expected(rows, 2).items()}
    assert 20 < len(set(want.values())) < 380
    wrong = sum(got[i] != want[i] for i in want)
    assert wrong <= (1 if comparisons is None else 4), wrong  # of links at 0.80, one in some hundred may share no run


def test_runs_of_several_components():
    """Every pair between components that agrees enough is found while the run may be compared; deeper parts otherwise."""
    rng = np.random.default_rng(5)
    labels = np.concatenate([np.zeros((120, 1 + near_dedup.DEPTH), np.uint8), rng.integers(0, 2, (120, near_dedup.PLACES - near_dedup.DEPTH))], 1).astype(np.uint8)
    labels = labels[np.lexsort(labels.T[::-1])]
    component = rng.integers(0, 4, 120) * (rng.random(120) < 0.3)
    labels = np.concatenate([labels, rng.integers(0, 2, (120, near_dedup.LONG)).astype(np.uint8)], 1)
    short, all_ = (lambda i, j: (labels[i, 1 : near_dedup.PLACES + 1] == labels[j, 1 : near_dedup.PLACES + 1]).sum()), (lambda i, j: (labels[i, 1:] == labels[j, 1:]).sum())
    want = {(i, j) for i in range(120) for j in range(120) if component[i] != component[j] and short(i, j) >= 50 and all_(i, j) >= 290}
    got = {(min(x, y), max(x, y)) for a, b, _ in near_dedup.crowded_candidates(labels, component, (50, 290), None) for x, y in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i, j in want if i < j}
    deeper = {(min(x, y), max(x, y)) for a, b, _ in near_dedup.crowded_candidates(labels, component, (50, 290), 400) for x, y in zip(a.tolist(), b.tolist())}
    assert deeper < got and deeper


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b c", None, None), (1, "a b c", None, None), (2, "a b c", None, None)], SCHEMA)
    assert sorted(x.component_id for x in near_duplicates(docs).collect()) == [1, 1, 1]
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [10, 1_000_000])
def test_components_of_a_chain_and_a_star(spark, monkeypatch, chunk):
    monkeypatch.setattr(module, "CHUNK", chunk)
    links = [(i, i + 1) for i in range(100, 160)] + [(9, i) for i in range(10, 90)] + [(3, 3), (9, 9), (200, 9)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and {got[i] for i in (*range(9, 90), 200)} == {9} and 3 not in got


def test_rows_without_ids(spark):
    words = lambda a, n: " ".join(f"{a}{i}" for i in range(n))
    rows = [(None, "a b c d"), (1, "q w e r t"), (None, words("x", 40)), (None, words("x", 39)), (7, words("y", 40)), (None, words("y", 39)), (None, words("y", 40)), (None, None), (None, ""), (None, "a b c d")]
    got = near_duplicates(spark.createDataFrame([(i, t, "", 1) for i, t in rows], SCHEMA), k=2).collect()
    found = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0, r["kept"]) for r in got)
    kept = [r for r in found if r[1] in (38, 39) and r[2] == 0]
    assert len(found) == len(rows) and [r["kept"] is None for r in got].count(True) == 0
    assert [r for r in found if r not in kept] == sorted([(0, 3, 0, True)] * 2 + [(1, 4, 1, True), (7, 39, 7, True), (0, 38, 7, False), (0, 39, 7, False)] + [(0, 0, 0, True)] * 2)
    assert sorted(r[3] for r in kept) == [False, True]
    only = near_duplicates(spark.createDataFrame([(None, "a b c d", "", 1), (1, "q w e r t", "", 1)], SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in only) == [(0, 0, True), (1, 1, True)]
