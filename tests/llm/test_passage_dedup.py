import random
import re

import trendloom.llm.blocks as blocks
from trendloom.llm.passage_dedup import remove_repeated_passages

SCHEMA = "doc_id long, text string, block string, spans int"


def words(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 8))) + r.choice(["", "", "", "", "."]) for _ in range(n))


def run(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return remove_repeated_passages(docs, **more).collect()


def plain_words(text):
    """(start, normalised) of each word, and the numbers of the words that begin a line."""
    words, lines, line = [], [], None
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        before = text[: m.start()].count("\n")
        if before != line:
            lines.append(len(words))
            line = before
        words.append((m.start(), re.sub(r"[!-/:-@\[-`{-~]", "", m[0].lower())))
    return words, lines


def expected(rows, least=20, least_line=20):
    """What stays of each text when, in rank order, every line and every run of words that stood before goes."""
    seen_lines, seen_runs, out = set(), set(), {}
    for i, t in sorted(rows, key=lambda x: (x[0], x[1] or "")):
        words, lines = plain_words(t or "")
        gone = set()
        for a, b in zip(lines, [*lines[1:], len(words)]):
            unit = tuple(w for _, w in words[a:b])
            if b - a >= least_line:
                if unit in seen_lines:
                    gone |= set(range(a, b))
                seen_lines.add(unit)
        for k in range(len(words) - least + 1):
            run_ = tuple(w for _, w in words[k : k + least])
            if run_ in seen_runs:
                gone |= set(range(k, k + least))
            seen_runs.add(run_)
        begin = [*(s for s, _ in words), len(t or "")]
        kept = (t or "")[: begin[0]] + "".join(t[begin[k] : begin[k + 1]] for k in range(len(words)) if k not in gone)
        out.setdefault(i, []).append(kept)
    return out


def test_passages_go_and_clean_texts_stay(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    r = random.Random(9)
    passage = [words(r, n) for n in (55, 70, 120)]
    rows = [(i, words(r, 60) + "\nCommon line here.\n" + words(r, 50)) for i in range(30)]
    planted = [(100 + i, words(r, r.randrange(5, 40)) + " " + passage[i % 3].upper().replace(".", ",. ") + " " + words(r, 20)) for i in range(30)]
    long = [(500, words(r, 20000) + " " + passage[0]), (501, None), (502, ""), (503, " \n"), (504, "é " * 100), (505, "dup dup. " * 300), (505, "dup dup. " * 300)]
    all_ = rows + planted + long
    r.shuffle(all_)
    got = run(spark, all_)
    want = expected(all_)
    for x in got:
        assert (x.text or "") in want[x.doc_id], x.doc_id
    by = {x.doc_id: x for x in got}
    assert len(got) == len(all_) and all(by[i].n_removed == 0 for i in range(30)) and by[501].text is None
    for i in range(3, 30):
        gone = sum(s.end - s.start for s in by[100 + i].spans)
        assert gone == by[100 + i].n_removed > 0.6 * len(passage[i % 3])
    assert all(by[100 + i].n_removed == 0 for i in range(3))
    source = dict(all_)
    for x in got:
        if x.text and x.spans:
            for s in x.spans:
                assert len(source[x.doc_id][s.start : s.end]) == s.end - s.start


def test_empty_table(spark):
    assert run(spark, []) == []


def test_passages_go_from_first_to_last_word(spark, monkeypatch):
    """Passages of 20 to 80 words in the middle of lines, without any full stop."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    r = random.Random(12)
    plain = lambda n: words(r, n).replace(".", "")
    passages = [plain(n) for n in [20, 21, 25, 30, 40, 50, 51, 60, 80] * 4]
    rows = [(i, plain(15) + " " + p + " " + plain(9)) for i, p in enumerate(passages)]
    rows += [(100 + i, plain(12) + " " + p + " " + plain(30)) for i, p in enumerate(passages)]
    short = plain(19)
    rows += [(200, short + " " + plain(40)), (201, plain(40) + " " + short)]
    by = {x.doc_id: x for x in run(spark, rows)}
    source = dict(rows)
    for i, p in enumerate(passages):
        assert by[i].n_removed == 0
        assert [source[100 + i][s.start : s.end] for s in by[100 + i].spans] == [p + " "]
    assert by[200].n_removed == by[201].n_removed == 0


def test_short_lines_go_where_asked(spark, monkeypatch):
    """All repeated lines, however short, with least_line = 1; punctuation and case make no difference."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1500)
    r = random.Random(13)
    common = ["Share this page!", "ok", words(r, 7), words(r, 30), words(r, 45)]
    rows = []
    for i in range(60):
        lines = [words(r, r.randrange(1, 40)) for _ in range(r.randrange(1, 4))]
        for x in r.sample(common, r.randrange(0, 4)):
            lines.insert(r.randrange(len(lines) + 1), x.upper() if r.random() < 0.3 else x + " ..." * (r.random() < 0.3))
        if r.random() < 0.3:
            lines.append(words(r, 6) + " " + common[4] + " " + words(r, 3))  # a line within a line
        rows.append((i, "\n".join(lines) + "\n" * r.randrange(3)))
    rows += [(70, "\n\n \n"), (71, "ok\nok\nOK."), (71, "ok")]
    for least_line in (1, 20):
        want = expected(rows, least_line=least_line)
        got = run(spark, rows, least_line=least_line)
        for x in got:
            assert x.text in want[x.doc_id], (least_line, x.doc_id, x.text, want[x.doc_id])
        assert (sum(x.n_lines_removed for x in got) > 60) == (least_line == 1)


def test_one_passage_in_many_surroundings(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    r = random.Random(14)
    passage = words(r, 22)
    rows = [(i, words(r, 8) + " " + passage + " " + words(r, 8)) for i in range(400)]
    want = expected(rows)
    assert all(x.text in want[x.doc_id] for x in run(spark, rows))
