import hashlib
import random

import numpy as np

import trendloom.llm.exact_substrings as module
from trendloom.llm.exact_substrings import remove_repeated_bytes
from trendloom.llm.suffixes import suffix_array

SCHEMA = "doc_id long, text string, block string, n_bytes int"


def expected(rows, size=50):
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        raw = (t or "").encode()
        for p in range(len(raw) - size + 1):
            first.setdefault(raw[p : p + size], i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        covered = bytearray(len(raw))
        for p in range(len(raw) - size + 1):
            if first[raw[p : p + size]] < i:
                covered[p : p + size] = b"\1" * size
        spans = sum(c and (k == 0 or not covered[k - 1]) for k, c in enumerate(covered))
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        out.append((i, len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(r):
    passage = ["".join(r.choice("abcdeé \n") for _ in range(r.randrange(40, 200))) for _ in range(6)]
    rows = []
    for i in range(80):
        parts = [r.choice([*passage, "".join(r.choice("abcdeé \n") for _ in range(r.randrange(0, 150)))]) for _ in range(r.randrange(0, 5))]
        if r.random() < 0.3 and parts:
            p = parts[0]
            parts[0] = p[r.randrange(0, 20) :][: r.randrange(45, 90)]
        rows.append((i, "".join(parts)))
    return rows + [(100, None), (101, ""), (102, "a" * 49), (103, "a" * 50), (104, "a" * 400), (105, "ab" * 300), (106, "ba" * 100)]


def compare(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeated_bytes(docs).collect())
    assert got == expected(rows)


def test_equals_brute_force(spark):
    r = random.Random(4)
    rows = corpus(r)
    r.shuffle(rows)
    compare(spark, [*rows, (7, rows[0][1]), (7, rows[0][1])])


def test_small_parts_are_merged(spark, monkeypatch):
    for name, value in (("PER_SORT", 7), ("BLOCK_BYTES", 1500), ("BUCKET_ANCHORS", 60), ("SHARD_BYTES", 9000)):
        monkeypatch.setattr(module, name, value)
    r = random.Random(5)
    compare(spark, corpus(r))


def test_anchor_in_many_surroundings(spark, monkeypatch):
    """One string of GRAM bytes and more in very many different surroundings, some of which repeat."""
    for name, value in (("BLOCK_BYTES", 40_000), ("SHARD_BYTES", 60_000), ("PER_SORT", 500)):
        monkeypatch.setattr(module, name, value)
    r = random.Random(6)
    common = "the very common string of thirty bytes"
    plain = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    around = [(plain(20), plain(20)) for _ in range(300)]
    rows = [(i, plain(30) + a + common + b + plain(30)) for i, (a, b) in enumerate(r.choices(around, k=400) + [(plain(20), plain(20)) for _ in range(1600)])]
    rows += [(3000 + i, common * 4) for i in range(3)]
    compare(spark, rows)
    monkeypatch.setattr(module, "HOT_CODES", 10**6)
    monkeypatch.setattr(module, "HOT_IN_BLOCK", 10**6)
    compare(spark, rows)  # the same without the way for hot anchors


def test_digests_that_share_one_half():
    from trendloom.llm.blocks import digest_groups

    high, low, owner = np.array([5, 5, 5, 9, 5], np.uint64), np.array([2, 1, 2, 1, 1], np.uint64), np.array([7, 3, 1, 4, 0])
    order, head = digest_groups(high, low, owner)
    assert order.tolist() == [4, 1, 2, 0, 3] and head.tolist() == [True, False, True, False, True]


def test_empty_table(spark):
    assert remove_repeated_bytes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_suffix_array():
    raw = b"abracadabra" * 9 + b"\0" + b"abra" * 5 + b"\0\0" + b"abra" * 5
    end = [(raw + b"\0").index(b"\0", i) for i in range(len(raw))]
    assert suffix_array(np.frombuffer(raw, np.uint8)).tolist() == sorted(range(len(raw)), key=lambda i: (raw[i : end[i]], i))
