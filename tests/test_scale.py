"""Operators that must not lean on small groups, against plain statements of their results."""

import datetime as dt
import math
import random

import pytest

from trendloom.operators import mining as M
from trendloom.operators import relational as R
from trendloom.operators.graph import components
from trendloom.sources import feeds

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("slice_rows", [1, 7, 10**6])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "int", "date"])
def test_asof_join_over_slices_equals_a_loop(spark, slice_rows, kind):
    rnd = random.Random(slice_rows)
    at = {"timestamp_ntz": lambda i: T0 + dt.timedelta(seconds=7 * i), "int": lambda i: i, "date": lambda i: dt.date(2024, 1, 1) + dt.timedelta(days=i)}[kind]
    key = lambda: 0 if rnd.random() < 0.5 else rnd.choice([1, 2, 3, None])  # noqa: E731  (one key holds half of all rows)
    time = lambda: None if rnd.random() < 0.05 else at(rnd.randint(0, 300))
    left = [(key(), i, time()) for i in range(120)]
    right = [(key(), time(), rnd.choice([None, float(i)])) for i in range(150)]
    got = R.asof_join(spark.createDataFrame(left, f"k int, i int, t {kind}"), spark.createDataFrame(right, f"k int, u {kind}, v double"), "k", "t", "u", "v", slice_rows).collect()
    want = {}
    for k, i, t in left:
        found = [(u, v) for q, u, v in right if None not in (k, t, q, u, v) and q == k and u <= t]
        want[i] = (k, t, max(found)[1] if found else None)
    assert {r["i"]: (r["k"], r["t"], r["asof_v"]) for r in got} == want and len(got) == len(left)


def test_asof_join_of_nothing(spark):
    left, right = spark.createDataFrame([(1, 5)], "k int, t int"), spark.createDataFrame([], "k int, u int, v double")
    assert [tuple(r) for r in R.asof_join(left, right, "k", "t", "u", "v").collect()] == [(1, 5, None)]
    assert R.asof_join(left.limit(0), right, "k", "t", "u", "v").collect() == []


def near(x, y):
    def forms(w):
        return {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}

    return x in y or y in x or x in forms(y) or y in forms(x) or (len(x) == len(y) and sum(a != b for a, b in zip(x, y)) == 1)


def test_near_words_equal_all_pairs(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abü北", k=rnd.randint(0, 9)))
    left, right = ([(rnd.choice("st"), word()) for _ in range(70)] + [("s", None)] for _ in range(2))
    got = R.near_words(*(spark.createDataFrame(x, "source_key string, w string") for x in (left, right)), ("source_key",)).collect()
    want = {(s, a, b) for s, a in left for q, b in right if s == q and a and b and near(a, b)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    links = R.near_equal_links(spark.createDataFrame([(i, w) for i, (_, w) in enumerate(left)], "k int, w string")).collect()
    assert {r["k"]: r["links"] for r in links} == {i: sum(bool(a and b) and i != j and near(a, b) for j, (_, b) in enumerate(left)) for i, (_, a) in enumerate(left)}


def test_urls_of_near_titles_equal_all_pairs(spark):
    rnd = random.Random(5)
    title = lambda: "".join(rnd.choices("ab ", k=rnd.randint(0, 7)))
    new, recent = ([(rnd.choice("st"), f"{p}{i}", title()) for i in range(60)] for p in ("n", "o"))
    want = set()
    for s, u, t in new:
        a = t.replace(" ", "")
        found = sorted((a != b, v) for q, v, b in ((q, v, x.replace(" ", "")) for q, v, x in recent) if q == s and a and b and near(a, b))
        want.add((s, found[0][1] if found else u))
    got = feeds.replace_url_of_near_title(*(spark.createDataFrame(x, "source_key string, url string, title string") for x in (new, recent))).collect()
    assert {(r["source_key"], r["url"]) for r in got} == want and len(got) == len(want)


def test_collapse_equals_the_greedy_rule(spark):
    rnd = random.Random(8)
    words = ["storm", "north", "hits", "coast", "again", "team", "wins"]
    rows = []
    for i in range(150):
        title = " ".join(rnd.choice(words) + rnd.choice(["", "", ",", "!"]) for _ in range(rnd.randint(0, 6)))
        rows.append((rnd.randint(0, 1), rnd.choice(["s", "t", None]), i, rnd.choice([title, title, title.replace(" ", ""), None]), rnd.choice([None, 1, 5, 9, i]), i))
    want, kept = set(), {}
    for c, s, i, title, heat, _ in sorted(rows, key=lambda r: (-(r[4] if r[4] is not None else -1), r[2])):
        own = {w.strip(".,!?;:") for w in (title or "").lower().split()}
        bare = "".join(x for x in (title or "").lower() if x.isalnum())
        if not any(b == bare or (len(w & own) >= 2 and 4 * len(w & own) >= 3 * min(len(w), len(own))) for b, w in kept.get((c, s), [])):
            kept.setdefault((c, s), []).append((bare, own))
            want.add(i)
    got = M.collapse_same_source(spark.createDataFrame(rows, "component int, source_key string, id int, title string, heat_value long, extra int"))
    assert got.columns == ["component", "source_key", "id", "title", "heat_value", "extra"] and sorted(r["id"] for r in got.collect()) == sorted(want)


@pytest.mark.parametrize(("least", "posting"), [(0.3, 2000), (0.8, 3), (1.0, 1)])
def test_similar_titles_equal_the_full_join(spark, monkeypatch, least, posting):
    monkeypatch.setattr(M, "POSTING", posting)
    rnd = random.Random(2)
    vectors = {i: {rnd.choice("abcdefghij"): rnd.choice([0.0, 0.5, 1.0, 2.0]) for _ in range(rnd.randint(1, 5))} for i in range(80)}
    for i in range(80, 110):  # a third of the titles are one
        vectors[i] = dict(vectors[3])
    member, pairs = M.similar_titles(spark.createDataFrame([(i, t, w) for i, v in vectors.items() for t, w in v.items()], "id int, token string, weight double"), least)
    classes = {i: min(j for j in vectors if vectors[j] == vectors[i]) for i in vectors}
    assert {r["id"]: r["class"] for r in member.collect()} == classes
    length = {i: math.sqrt(sum(w * w for w in v.values())) for i, v in vectors.items()}
    cosine = lambda a, b: sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()) / (length[a] * length[b]) if length[a] and length[b] else 0
    reps = sorted(set(classes.values()))
    want = {(a, b): cosine(a, b) for a in reps for b in reps if a < b}
    got = {(r["a"], r["b"]): r["semantic"] for r in pairs.collect()}
    assert {p for p, c in want.items() if c >= least + 1e-9} <= set(got) <= {p for p, c in want.items() if c >= least - 1e-9}
    assert all(abs(c - want[p]) < 1e-9 for p, c in got.items())
    links = {r["id"]: r["links"] for r in M.similar_links(member, pairs).collect()}
    assert all(links[i] == sum(j != i and (classes[i] == classes[j] or (min(classes[i], classes[j]), max(classes[i], classes[j])) in got) for j in vectors) for i in vectors)


def test_components_that_do_not_settle_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "a int, b int")
    assert {r["component"] for r in components(links).collect()} == {0}
    with pytest.raises(RuntimeError, match="settled"):
        components(links, most=1)
