import random
import re

import numpy as np
import pytest

from trendloom.operators import patterns
from trendloom.operators.extract import Lexicon, candidates
from trendloom.operators.patterns import Automaton, dictionary_hits, lowered


def brute(words, texts):
    """All hits from the definition."""
    out = []
    for r, t in enumerate(texts):
        for w in words:
            short = len(w) <= 3 and w.isascii()
            for i in range(len(t) - len(w) + 1):
                around = t[max(i - 1, 0) : i] + t[i + len(w) : i + len(w) + 1]
                if t[i : i + len(w)] == w and not (short and re.search("[a-z0-9]", around)):
                    out.append((r, i, i + len(w), w))
    return sorted(out)


def found(words, texts):
    a = Automaton.build((w, w) for w in words)
    return sorted((r, s, e, a.labels[p]) for r, s, e, p in zip(*(x.tolist() for x in a.search(texts)), strict=True))


@pytest.mark.parametrize("table", [patterns.FULL_TABLE, 0])
@pytest.mark.parametrize("chunk", [1, 3, 256])
def test_hits_equal_brute_force(monkeypatch, table, chunk):
    monkeypatch.setattr(patterns, "FULL_TABLE", table)
    monkeypatch.setattr(patterns, "CHUNK", chunk)
    rnd = random.Random(chunk)
    for letters in ("ab", "abé北", "a 1"):
        words = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(12)})
        texts = ["".join(rnd.choice(letters + "z") for _ in range(rnd.randint(0, 40))) for _ in range(30)]
        assert found(words, texts) == brute(words, texts)


def test_nested_and_overlapping_labels():
    words = ["华为", "华为手机", "手机", "北京大学", "大学城", "大学"]
    texts = ["华为手机发布", "北京大学城", "", "城"]
    assert [[w for _, _, _, w in found(words, [t])] for t in texts] == [["华为", "华为手机", "手机"], ["北京大学", "大学", "大学城"], [], []]
    a = Automaton.build([("o1", "o1"), ("go", "Go"), ("cs2", "CS2"), ("x", "X"), ("go", "other")])
    assert a.labels_of(["go123 o1", "o1 go", "cs2!cs22", "pro1", "发布o1模型"]) == [["o1"], ["o1", "Go"], ["CS2"], [], ["o1"]]


def test_long_texts_and_offsets():
    words = ["needle", "nee"]
    text = "x" * 100_000 + "needle" + "y" * 50_000 + " nee"
    assert found(words, [text, "a", text]) == [(0, 100_000, 100_006, "needle"), (0, 150_007, 150_010, "nee"), (2, 100_000, 100_006, "needle"), (2, 150_007, 150_010, "nee")]
    assert lowered("İX") == "İx" and lowered(None) == "" and np.all([len(lowered(t)) == len(t) for t in ("İİ", "ẞß", "ǅ")])


@pytest.mark.parametrize("most", [10**6, 7])
def test_dictionary_hits(spark, most):
    texts = spark.createDataFrame([(1, "The RED ring", 5), (None, "ringing ring", 6), (2, None, 7), (2, "", 8)], "id long, text string, label int")
    words = spark.createDataFrame([("ring", "ring"), ("Ring", "a ring"), ("red", "red"), ("inging", "x"), (None, "y"), ("ear", None)], "pattern string, label string")
    got = sorted((r["id"] or 0, r["label"], r["start"], r["end"]) for r in dictionary_hits(texts, words, most_chars=most).collect())
    assert got == [(0, "a ring", 0, 4), (0, "a ring", 8, 12), (0, "x", 1, 7), (1, "a ring", 8, 12), (1, "red", 4, 7)]
    assert dictionary_hits(texts, words.limit(0)).count() == 0 and dictionary_hits(texts.limit(0), words).count() == 0


def test_candidates_take_overlapping_labels():
    lx = Lexicon(entries={"华为": ("company", ()), "华为手机": ("product", ()), "北京大学": ("school", ()), "大学城": ("place", ())})
    assert {"北京大学", "大学城"} <= {c[0] for c in candidates("北京大学城", lx)}
    assert {"华为", "华为手机"} <= set(lx.matches("华为手机发布"))
