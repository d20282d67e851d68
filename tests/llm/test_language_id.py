import random
import zlib

import numpy as np

from trendloom.llm.language_id import WINDOW, BiGRU, frame, identify_languages, pooled

WORDS = {"en": ["the", "with", "thing", "other"], "fr": ["être", "où", "quelle", "eau"], "de": ["über", "schön", "zeit", "nicht"]}


def test_gradients_are_those_of_the_loss():
    net = BiGRU(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = frame([b"hello there", b"abc"])
    x, mask = x[:12], mask[:12].astype(np.float64)
    label = np.array([0, 2])
    _, grad = net.gradients(x, mask, label)
    for name, place in (("Ef", (104, 3)), ("Ub", (2, 17)), ("V", (5, 1)), ("c", (2,)), ("Uf", (1, 1)), ("Eb", (97, 20))):
        keep = net.p[name][place]
        loss = []
        for step in (1e-3, -1e-3):
            net.p[name][place] = keep + step
            loss.append(net.gradients(x, mask, label)[0])
        net.p[name][place] = keep
        assert abs((loss[0] - loss[1]) / 2e-3 - grad[name][place]) < 1e-4


def test_held_out_accuracy_and_rows(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        lang = r.choice(list(WORDS))
        rows.append((i, " ".join(r.choice(WORDS[lang]) for _ in range(r.randrange(5, 60))), lang, "x", None))
    odd = [(1000, None, "en", "x", 1.0), (1001, "", "fr", None, None), (1002, "12 34 ² ½ !?", "de", None, None), (1003, "the other thing " * 9000, None, None, None), (5, rows[5][1], rows[5][2], "x", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, score double")
    got = identify_languages(docs).collect()
    assert len(got) == len(rows) + len(odd)
    by = {x.doc_id: x for x in got}
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in got)
    test = [(by[i].lang_pred, lang) for i, _, lang, _, _ in rows if by[i].held_out]
    assert sum(a == b for a, b in test) >= 0.95 * len(test) > 50
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "en"


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(x.lang_pred, x.score) for x in identify_languages(docs).collect()] == [("und", 0.0)]
    assert identify_languages(docs.limit(0)).count() == 0


def test_pooling_is_the_mean_over_every_byte():
    """Against one window at a time, without padding or batches."""
    net = BiGRU(3, 1)
    texts = ["a", "é" * 40, "some text of more than one window, that is. " * 5, "x" * WINDOW, "y" * (WINDOW + 1)]
    got = pooled(net, texts, 3)
    for text, p in zip(texts, got):
        raw, total = text.encode(), np.zeros(3)
        for a in range(0, len(raw), WINDOW):
            x, _ = frame([raw[a : a + WINDOW]])
            total += net.probabilities(x)[: len(raw[a : a + WINDOW]), 0].sum(0)
        assert np.allclose(p, total / len(raw), atol=1e-5), text


def test_ids_of_other_types(spark):
    rows = [(f"doc-{i}", WORDS["en" if i % 2 else "fr"][i % 4] + " " + WORDS["en" if i % 2 else "fr"][(i + 1) % 4], "en" if i % 2 else "fr") for i in range(120)]
    rows += [(None, "the other", "en"), ("doc-1", "the other thing", "en")]
    got = identify_languages(spark.createDataFrame(rows, "doc_id string, text string, lang string")).collect()
    assert len(got) == 122 and all(x.held_out == (x.doc_id is not None and zlib.crc32(x.doc_id.encode()) % 4 == 2) for x in got)
