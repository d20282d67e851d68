import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendloom.operators import extract as X
from trendloom.operators.segmentation import BEGIN, END, FOLLOWS, MIDDLE, SINGLE, CharacterModel, Segmenter, TagModel, kind_of, tagged_words

NAMES = ["王建国", "李明", "陈小红", "张伟", "欧阳明", "王小红", "李建国", "陈明"]


@pytest.fixture(scope="module")
def characters(spark):
    return CharacterModel.fit(spark.createDataFrame([(NAMES * 3 + ["的", "在", "的"],), (["张", "建国"],), (None,), ([],), ([None, ""],)], "words array<string>"))


def states_of(words):
    return [s for w in words for s in ([SINGLE] if len(w) == 1 else [BEGIN, *[MIDDLE] * (len(w) - 2), END])]


def cuts(run):
    """All ways to cut a run into words."""
    for gaps in itertools.product([0, 1], repeat=len(run) - 1):
        words, at = [], 0
        for i, g in enumerate(gaps, 1):
            if g:
                words.append(run[at:i])
                at = i
        yield [*words, run[at:]]


def test_character_model_equals_enumeration(characters):
    rnd = random.Random(1)
    runs = ["".join(rnd.choice("王建国李明陈小红的在张x") for _ in range(rnd.randint(1, 8))) for _ in range(120)]

    def score(run, words):
        s = states_of(words)
        e = characters.scores(run)
        return characters.start[s[0]] + sum(e[i][x] for i, x in enumerate(s)) + sum(characters.moves[a, b] for a, b in zip(s, s[1:]))

    for run, words in zip(runs, characters.cut(runs), strict=True):
        assert "".join(words) == run
        assert score(run, words) >= max(score(run, w) for w in cuts(run)) - 1e-9
    assert characters.cut([]) == []
    for a in range(4):
        assert all((characters.moves[a, b] > -1e29) == (b in FOLLOWS[a]) for b in range(4))


def test_lattice_equals_enumeration():
    rnd = random.Random(2)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))): rnd.randint(1, 50) for _ in range(25)}
    s = Segmenter(words, run="[a-z]+")
    score = lambda ws: sum(np.log((words.get(w) or (0.5 if len(w) == 1 else 1e-300)) / s.total) for w in ws)
    runs = ["".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 8))) for _ in range(150)]
    for run, got in zip(runs, s.paths(runs), strict=True):
        assert "".join(got) == run and score(got) >= max(map(score, cuts(run))) - 1e-9


def test_unknown_names_come_out_whole(characters):
    s = Segmenter({"访问": 300, "北京": 800, "发布": 900, "手机": 700}, characters)
    assert s.segment(["王建国访问北京", "陈小红发布手机", "", "M9 李明"]) == [["王建国", "访问", "北京"], ["陈小红", "发布", "手机"], [], ["M9", "李明"]]
    assert s.segment(["李明陈小红访问"]) == [["李明", "陈小红", "访问"]]
    assert Segmenter({"访问": 3}).segment(["李明陈小红访问"]) == [["李明陈小红", "访问"]]


@pytest.fixture(scope="module")
def tags(spark):
    rows = [(["王建国", "访问", "北京"], ["nr", "v", "ns"]), (["访问", "北京"], ["vn", "ns"]), (["发布", "新", "手机"], ["v", "a", "n"]), (["他", "发布", "消息"], ["r", "v", "n"]), (["手机", "发布", "会"], ["n", "vn", "n"]), (["Apple", "3"], ["eng", "m"]), (None, None)]
    return TagModel.fit(spark.createDataFrame(rows, "words array<string>, tags array<string>"))


def test_tags_equal_enumeration(tags):
    rnd = random.Random(3)
    vocabulary = ["王建国", "访问", "北京", "发布", "新", "手机", "他", "未知", "OpenAI", "42"]
    sentences = [[rnd.choice(vocabulary) for _ in range(rnd.randint(0, 4))] for _ in range(40)]

    def score(words, path):
        e = [tags.emission(w) for w in words]
        return tags.start[path[0]] + sum(x[p] for x, p in zip(e, path, strict=True)) + sum(tags.moves[a, b] for a, b in zip(path, path[1:]))

    for words, got in zip(sentences, tags.decode(sentences), strict=True):
        assert len(got) == len(words)
        if words:
            best = max(score(words, p) for p in itertools.product(range(len(tags.tags)), repeat=len(words)))
            assert score(words, [tags.tags.index(t) for t in got]) >= best - 1e-6
    assert tags.decode([["OpenAI", "42"]]) == [["eng", "m"]]


def test_columns_and_kinds(spark, characters, tags):
    s = Segmenter({"访问": 300, "北京": 800, "发布": 900, "手机": 700}, characters, tags)
    rows = spark.createDataFrame([(1, "王建国访问北京", 0), (2, None, 0), (3, "", 0)], "id int, title string, word int")
    got = tagged_words(rows, s).withColumn("kind", kind_of(F.col("tag"))).orderBy("pos").collect()
    assert [(r["word"], r["kind"]) for r in got] == [("王建国", "entity"), ("访问", "keyword"), ("北京", "entity")]


def test_rules_take_the_segmenter(characters, tags):
    lx = X.seed_lexicon()
    lx.characters, lx.tag_model = characters, tags
    assert X.segment("王建国访问北京", lx) == ["王建国", "访问", "北京"]
    assert X.word_kind("访问北京", lx) == "keyword" and X.word_kind("王建国", lx) == "entity"
