import collections
import random
import re

import numpy as np

from trendloom.llm import quality
from trendloom.llm.quality import CHI2_975, CHI2_HALF, CUT, DIMS, PRIOR, SMOOTH, TWICE, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, kept string, d2 int"


def expected(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def prose(r, n, shout=False):
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(n)]
    return " ".join(w.upper() + "!!" if shout else w for w in words)


def test_counts_and_outliers(spark):
    r = random.Random(1)
    rows = [(i, prose(r, r.randrange(60, 300)), "en", "a" if i % 3 else "b", "x", 1) for i in range(600)]
    rows += [(1000 + i, prose(r, 200, shout=True), "en", "a", None, None) for i in range(15)]
    odd = [None, "", " \n\t ", "a b c a b c a b c " * 20, "x y z\n\nx y z\n", "#$%&|<>* " * 60, "a a a a", "\x0b1\x0c2", prose(r, 30000)]
    rows += [(2000 + i, t, None, "a", None, None) for i, t in enumerate(odd)]
    rows += [(3000, rows[0][1], "en", "a", "x", 1)] * 2
    got = quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    text = {x[0]: x[1] for x in rows}
    for x in got:
        want = expected(text[x.doc_id])
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, text[x.doc_id]
        assert x.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (x.base_failed and x.kept)
    kept = {x.doc_id for x in got if x.kept}
    assert all(i in kept for i in range(600)) and 3000 in kept
    assert not any(1000 + i in kept for i in range(15))
    assert 2005 not in kept and 2008 in kept


def fast_mcd(x, tolerance):
    """n, mean and covariance: concentration to the end from two starts, reweighted, made consistent."""
    far = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c + tolerance), x - m)
    middle = np.median(x, 0)
    found = []
    for m, c in ((middle, np.diag((1.4826 * np.median(abs(x - middle), 0)) ** 2)), (x.mean(0), np.cov(x.T, bias=True))):
        for _ in range(50):
            d = far(m, c)
            half = x[d <= np.sort(d)[(len(d) - 1) // 2]]
            m, c = half.mean(0), np.cov(half.T, bias=True).reshape(DIMS, DIMS) if len(half) > 1 else np.zeros((DIMS, DIMS))
        found.append((np.linalg.slogdet(c + tolerance)[1], m, c))
    _, m, c = min(found, key=lambda f: f[0])
    d = far(m, c)
    near = x[d <= np.sort(d)[(len(d) - 1) // 2] * CHI2_975 / CHI2_HALF]
    m, c = near.mean(0), np.cov(near.T, bias=True).reshape(DIMS, DIMS) if len(near) > 1 else np.zeros((DIMS, DIMS))
    d = np.sort(far(m, c))
    return len(near), m, c * d[(len(d) - 1) // 2] / CHI2_HALF


def plain_distances(rows):
    """Squared distances of (id, text, lang, source) that pass the base rules."""
    kept, counts = [], []
    for i, t, g, s in rows:
        n, chars, symbols, dup, rep = expected(t)
        if n >= 50 and 100 * rep <= 50 * n:
            kept.append((i, g, s))
            counts.append((n, chars, symbols, len(re.findall(r"[A-ZÀ-ÖØ-Þ!]", t)), rep, dup))
    n, chars, symbols, upper, rep, dup = np.array(counts, float).T
    low = lambda v: np.sort(v)[(len(v) - 1) // 2]
    letters, per_symbol, per_upper = low(chars / n), low(symbols / chars), low(upper / chars)
    wide = chars + SMOOTH * letters
    x = np.stack([np.log(wide / (n + SMOOTH)), np.sqrt((symbols + SMOOTH * letters * per_symbol) / wide), np.sqrt((upper + SMOOTH * letters * per_upper) / wide), rep / (n + SMOOTH), dup / (n + SMOOTH)], 1)
    v = np.mean(0.25 / (n + SMOOTH))
    square = np.mean((n + SMOOTH) ** -2.0)
    tolerance = np.diag([v, v / letters, v / letters, TWICE**2 * square, square])
    out = {}
    _, *all_ = fast_mcd(x, tolerance)
    for g in {k[1] for k in kept}:
        in_lang = np.array([k[1] == g for k in kept])
        size, *own = fast_mcd(x[in_lang], tolerance)
        lang = [size / (size + PRIOR) * a + PRIOR / (size + PRIOR) * b for a, b in zip(own, all_)]
        for s in {k[2] for k in kept if k[1] == g}:
            here = np.array([k[1] == g and k[2] == s for k in kept])
            size, *own = fast_mcd(x[here], tolerance)
            m, c = (size / (size + PRIOR) * a + PRIOR / (size + PRIOR) * b for a, b in zip(own, lang))
            d = np.einsum("ij,jk,ik->i", x[here] - m, np.linalg.inv(c + tolerance), x[here] - m)
            out |= {k[0]: v for k, v in zip([k for k, h in zip(kept, here) if h], d)}
    return out


def test_distances_equal_a_plain_estimate(spark):
    """Groups of 1 to 400 rows, with a share of outliers, against numpy, with the constants as they are."""
    r = random.Random(3)
    rows = []
    for g, s, n in (("en", "a", 400), ("en", "b", 90), ("de", "a", 30), ("de", "c", 1), (None, None, 5)):
        for _ in range(n):
            t = prose(r, r.randrange(50, 400))
            if r.random() < 0.5:
                t = t.replace("e", "E", r.randrange(60)).replace(" ", "\n", r.randrange(9)) + " #" * r.randrange(3)
            if r.random() < 0.12:
                t = " ".join(w + "#$%" for w in t.split())
            rows.append((len(rows), t, g, s))
    docs = spark.createDataFrame([(i, t, g, s) for i, t, g, s in rows], "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality_rules(docs).collect()}
    want = plain_distances(rows)
    assert set(want) == {i for i, x in got.items() if not x.base_failed}
    for i, d in want.items():
        assert abs(got[i].d2 - d) <= 0.02 * d + 1e-6, (i, rows[i][2:], got[i].d2, d)
        assert got[i].kept == (d <= CUT) or abs(d - CUT) < 2
    assert 20 < sum(not got[i].kept for i in want) < 120


def test_repetition_alone_is_rejected(spark):
    """Far more repetition than a group has, but less than the base rules allow."""
    r = random.Random(4)
    phrase = prose(r, 3).split()
    rows = [(i, prose(r, r.randrange(100, 500)), "en", "s") for i in range(400)]
    lines = "\n".join(prose(r, 6) for _ in range(40))
    rows += [(1000 + p, " ".join([prose(r, 300 - 3 * p), *phrase * p]), "en", "s") for p in (2, 5, 30, 45, 48)]
    rows += [(2000 + k, lines + "\n" + "\n".join(["so"] * k), "en", "s") for k in (1, 30)]
    got = {x.doc_id: x for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i].kept for i in range(400)) and not any(x.base_failed for x in got.values())
    assert {i for i, x in got.items() if not x.kept} == {1030, 1045, 1048, 2030}


def test_empty_table(spark):
    assert quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_native_plan(spark, monkeypatch):
    """No Python in the plan of any checkpoint or of the result."""
    plans = []
    cut = quality.checkpoint
    monkeypatch.setattr(quality, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    rows = [(i, prose(random.Random(i), 80), "en", "a", None, None) for i in range(30)]
    plans.append(quality_rules(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().toString())
    assert len(plans) > 4 and not any(re.search("Python|Pandas|Arrow", x) for x in plans)
