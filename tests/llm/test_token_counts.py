import random

import public_tokenizers
import pytest
import sentencepiece

from trendloom.llm.token_counts import TokenCounter, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_equals_the_library_on_odd_texts(library):
    r = random.Random(3)
    letters = "abehinrst   \n\t▁éßю中😀0123<s></s>.,'ʰ "
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3000)]
    texts += ["a" * 3000, "ha" * 900, " " * 300, "the" * 500 + " " * 33, "\n" * 50, "<unk><s>", "", "x\0y", "\0", "the " * 3]
    assert TokenCounter(MODEL).count(texts) == [len(x) for x in library.encode(texts, num_threads=1)]


def test_a_full_table_starts_afresh(library):
    texts = [f"word{i} again" for i in range(2000)]
    c = TokenCounter(MODEL, kept=50)
    got = [c.count([t])[0] for t in texts]
    assert got == [len(x) for x in library.encode(texts, num_threads=1)]


def test_rows(spark, library):
    rows = [(1, None, 5), (2, "", 6), (3, "the rain " * 5000, 7), (3, "x", 8), (4, "é", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_counts(docs, MODEL).collect()))
    long = len(library.encode(rows[2][1]))
    assert got == sorted([(1, 0, 0, False), (2, 0, 0, False), (3, 45000, long, long > 4096), (3, 1, len(library.encode("x")), False), (4, 2, len(library.encode("é")), False)])
    assert token_counts(docs.limit(0), MODEL).count() == 0
