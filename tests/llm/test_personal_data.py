import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from trendloom.llm.personal_data import CONTEXT, find_personal_data, personal_data, running, sanitise

SCHEMA = "doc_id long, text string, h1 string, email int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def base(text):
    """Spans by the plain patterns."""
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end(), m.group()))
    return out


def check(got, texts):
    for r in got:
        spans = base(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (texts[r["doc_id"]], joined, r["spans"])
        assert r["spans"] == joined or r["spans"].startswith(joined + "," if joined else "")
        assert [r[f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in spans) for k in PATTERNS]


ODD = [
    "", " ", "@", "a@b", "a@b.c", "a@b.c_d@e.f", "x@y.z-@q.r", "é.a@b.co😀 9.9.9.9 1.2.3.4.5.6.7.8.9", "300.1.1.1 01.002.0003.255 1.2.3", "4111111111111111", "x4111 1111-1111 1111,", "4111  111111111111 4111-1111-1111-1112",
    "41111111111111110000", "+1 (555) 123-4567 +", "+1-", "+1(((((2", "++12345678+123456789012345 +1234567890123456", "a@b.c@d.e a.@b..c a@-.-", "1.2.3.4@5.6.7.8", "ü@ß.de ß@b.de", "+4111111111111111", "a" * 5000 + "@", "7" * 5000, "1 " * 3000, "+" * 300 + "1" * 30, "a@b" + ".c" * 20000, "1.2.3." * 3000, "\x00a@b.c\x00\n1.1.1.1\r\n",
]


def test_base_spans_equal_the_plain_patterns(spark):
    rnd = random.Random(3)
    texts = [*ODD, *("".join(rnd.choice(["a", "7", "@", ".", "+", "-", " ", "(", "1.2.3.4", "4111111111111111", "é", "😀", "b.c", "_"]) for _ in range(rnd.randint(1, 60))) for _ in range(1500))]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    got = personal_data(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    check(got, dict(enumerate(texts)))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = personal_data(docs).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    check(got, texts)


def corpus():
    rnd = random.Random(5)
    word = lambda: "w%d" % rnd.randint(0, 60)
    rows = []
    for i in range(400):
        text = [word() for _ in range(40)]
        if i % 20 == 0:  # a name that stands with one address only
            text[10:10] = ["Tarquinia", "ann@mail.example.org", "Desk-7431"]
        if i % 20 == 10:
            text[5:5] = ["+1 (555) 123-4567", "Ulpian"]
        if i == 7:
            text[3] = "tarquinia"
        if i in (8, 9, 11, 12):
            text[3] = "ULPIAN"
        rows.append((i, " ".join(text), "x", 1))
    copy = "zanthor bob@mail.example.org " + rows[5][1]
    rows += [(400 + i, copy, "x", 1) for i in range(30)]  # copies of one text prove nothing
    return [*rows, (None, None, None, None), (3, rows[3][1], "y", 2), (3, rows[20][1], None, None)]


def brute(rows, least, generalise, remove):
    """Actions by term, from the definition."""
    word = re.compile(r"[^\W_]+")
    keys = {(i, t or "") for i, t, *_ in rows}
    mentions = {}
    for i, t in keys:
        for kind, a, b, v in base(t):
            same = [s for s in base(t) if s[0] == kind]
            k = same.index((kind, a, b, v))
            left, right = t[same[k - 1][2] if k else 0 : a][-CONTEXT:], t[b : same[k + 1][1] if k + 1 < len(same) else len(t)][:CONTEXT]
            left = re.sub(r"^[^\W_]+", "", left) if len(left) == CONTEXT else left
            right = re.sub(r"[^\W_]+$", "", right) if len(right) == CONTEXT else right
            ctx = tuple(dict.fromkeys(word.findall(left.lower()) + word.findall(right.lower())))
            mentions.setdefault((kind, re.sub("[^0-9]", "", v) if kind in ("card", "phone") else v.lower()), []).append(((i, t), ctx))
    held = {}
    for _, t, *_ in rows:
        for w in set(word.findall((t or "").lower())):
            held[w] = held.get(w, 0) + 1
    actions = {}
    for found in mentions.values():
        known = math.log(len(rows) / len({k for k, _ in found}))
        for term in {w for _, c in found for w in c if re.search(r"[^\W\d_]|[0-9]{3}", w)}:
            own = {}
            for k, c in found:
                if term in c:
                    own.setdefault(k, c)
            if len(set(own.values())) >= least and known > 0:
                d = math.log(len(own) * len(rows) / (len({k for k, _ in found}) * held[term])) / known
                actions[term] = max(actions.get(term, 0), d)
    return {w: "removed" if d >= remove else "generalised" for w, d in actions.items() if d >= generalise}


@pytest.mark.parametrize(("generalise", "remove"), [(0.9, 0.97), (0.6, 0.8), (0.2, 0.5)])
def test_disclosing_terms_equal_brute_force(spark, generalise, remove):
    rows = corpus()
    expected = brute(rows, 3, generalise, remove)
    assert "zanthor" not in expected
    if remove == 0.97:
        assert expected == {"tarquinia": "removed", "desk": "removed", "7431": "removed", "ulpian": "generalised"}
    got = find_personal_data(spark.createDataFrame(rows, SCHEMA), generalise=generalise, remove=remove).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, []).append(t or "")
    for r in got:
        spans = {a: [tuple(s) for s in r[a]] for a in ("generalised", "removed")}
        options = []
        for t in texts[r["doc_id"]]:
            inside = lambda m, t=t: any(a < m.end() and m.start() < b for _, a, b, _ in base(t))
            options.append({a: [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\W_]+", t) if expected.get(m.group().lower()) == a and not inside(m)] for a in spans})
        assert spans in options


@pytest.mark.parametrize("bound", [100_000, 0])
def test_broadcast_and_shuffle_agree(spark, monkeypatch, bound):
    monkeypatch.setattr("trendloom.llm.personal_data.BROADCAST", bound)
    got = personal_data(spark.createDataFrame(corpus(), SCHEMA)).collect()
    assert (sum(r["n_generalised"] for r in got), sum(r["n_removed"] for r in got)) == (20 + 4, 3 * 20 + 1 + 3)
    test_broadcast_and_shuffle_agree.seen = getattr(test_broadcast_and_shuffle_agree, "seen", None) or sorted(map(str, got))
    assert sorted(map(str, got)) == test_broadcast_and_shuffle_agree.seen


def test_sanitised_text(spark):
    rows = corpus()
    got = {r["doc_id"]: r["text"] for r in sanitise(spark.createDataFrame(rows, SCHEMA).filter("doc_id is null or doc_id <> 3")).collect()}
    assert len(got) == len({r[0] for r in rows if r[0] != 3})
    assert "[EMAIL]" in got[0]
    assert "arquinia" not in got[0] + got[20] + got[7] and "@" not in got[0] and "U. " in got[8]
    assert got[None] == "" and got[1] == rows[1][1]


def test_overlaps_in_sanitised_text(spark):
    texts = {1: "mail 1.2.3.4@5.6.7.8 end", 2: "call +4111111111111111.", 3: "", 4: "a@b.co,a@b.co"}
    got = {r["doc_id"]: r["text"] for r in sanitise(spark.createDataFrame([(k, v, "", 0) for k, v in texts.items()], SCHEMA)).collect()}
    assert got == {1: "mail [EMAIL] end", 2: "call +[CARD].", 3: "", 4: "[EMAIL],[EMAIL]"}


def test_empty_table(spark):
    assert personal_data(spark.createDataFrame([], SCHEMA)).count() == 0


def test_running_sums(spark):
    rnd = random.Random(1)
    for n in (0, 1, 511, 512, 513, 2000):
        v = [rnd.randint(0, 9) for _ in range(n)]
        got = spark.createDataFrame([(v,)], "v array<bigint>").select(running(F.col("v"))).first()[0]
        assert got == [sum(v[:i]) for i in range(n)]


def test_native_plan(spark):
    plan = personal_data(spark.createDataFrame(corpus(), SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
