import random

import numpy as np

from trendloom.llm.decontaminate import GAP, MATCH, MISS, align, contaminated


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISS), h[i - 1, j] + GAP, h[i, j - 1] + GAP)
    return h.max() / (MATCH * len(a))


def test_alignment_equals_the_textbook():
    r = np.random.default_rng(2)
    pairs = [(r.integers(1, 5, r.integers(1, 14)), r.integers(0, 5, r.integers(1, 20))) for _ in range(80)]
    assert np.allclose([s for s, _ in align(pairs)], [smith_waterman(a, b) for a, b in pairs])


def prose(r, n):
    return [r.choice(["w%d" % i for i in range(900)]) for _ in range(n)]


def test_copies_are_caught_and_clean_texts_left(spark):
    r = random.Random(6)
    items = [(i, " ".join(prose(r, r.randrange(20, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "zzz yyy")]
    rows, want = [], set()
    for i in range(200):
        words = prose(r, r.randrange(30, 300))
        if i % 4 == 0:
            k = r.randrange(25)
            copy = items[k][1].split()
            for _ in range(len(copy) // 8 if i % 8 else 0):
                copy[r.randrange(len(copy))] = "other"
            if i % 16 == 0:
                copy.insert(len(copy) // 2, "Inserted,")
            at = r.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in copy]
            want.add((i, k))
        rows.append((i, " ".join(words), "x", 1.0))
    rows += [(500, None, None, None), (501, "", None, None), (502, " ".join(prose(r, 30000)), None, None), (503, "a Zzz yyy. b", None, None)]
    rows += [(600, items[0][1], None, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string, score double")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chunk in (10**6, 2000):
        got = [(x.doc_id, x.item_id) for x in contaminated(docs, bench, chunk_chars=chunk).collect()]
        assert sorted(got) == sorted([*want, (503, 92), (600, 0), (600, 0)])
    assert contaminated(docs.limit(0), bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0


def plain_score(a, b):
    row, best = [0] * (len(b) + 1), 0
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (MATCH if x == y else MISS), row[j + 1] + GAP, new[j] + GAP))
        row, best = new, max(best, *new)
    return best / (MATCH * len(a))


def test_edited_copies_equal_brute_force(spark):
    """Every fifth, fourth or third word changed, words put between all others, halves; with an exact copy elsewhere."""
    r = random.Random(11)
    items = [(i, prose(r, r.randrange(15, 50))) for i in range(10)]
    rows = []
    for i, w in items:
        copies = [w] if i % 2 else []
        copies += [[f"n{i}" if j % step == step - 1 else x for j, x in enumerate(w)] for step in (5, 4, 3)]
        copies += [[y for x in w for y in (x, f"m{i}")], w[: (len(w) + 1) // 2], w[: len(w) // 2 - 1]]
        rows += [prose(r, r.randrange(30)) + c + prose(r, r.randrange(30)) for c in copies]
    want = sorted((d, i, plain_score(w, text)) for d, text in enumerate(rows) for i, w in items if plain_score(w, text) >= 0.5)
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(rows)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    assert len(want) >= 50
    assert sorted((x.doc_id, x.item_id, x.score) for x in contaminated(docs, bench).collect()) == want
