"""Words and parts of speech of text without spaces: a lattice of dictionary words, a hidden Markov model over begin, middle,
end and single characters for what the dictionary lacks, and a tag-sequence decoder over the words.

Parameters are counted by Spark from a segmented and tagged list that the caller supplies. Decoding runs over Arrow batches:
the dictionary's automaton gives the edges of all lattices at once, and every Viterbi step treats all runs of a batch together.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.operators.patterns import Automaton

HAN_RUN = "[㐀-鿿]+"
WORDS = "[A-Za-z0-9+.]+"
BEGIN, MIDDLE, END, SINGLE = range(4)
#: States that may follow each other: a word is begun before it goes on, and ended before the next one.
FOLLOWS = {BEGIN: (MIDDLE, END), MIDDLE: (MIDDLE, END), END: (BEGIN, SINGLE), SINGLE: (BEGIN, SINGLE)}
NEVER = -1e30
#: Rows of a counted parameter table that are collected at most.
MOST_ROWS = 2_000_000


def _collected(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a model of more than {MOST_ROWS} parameters")
    return rows


@dataclass
class CharacterModel:
    """Log probabilities of the states at the start, of their successions, and of characters in each state."""

    start: np.ndarray
    moves: np.ndarray
    emissions: dict[str, np.ndarray]
    unseen: np.ndarray

    @staticmethod
    def fit(segmented: DataFrame, words: str = "words") -> CharacterModel:
        """From rows with an array of words each, with one more count for every succession and character that can be."""
        w = F.filter(F.coalesce(words, F.array().cast("array<string>")), lambda x: F.coalesce(F.length(x) > 0, F.lit(False)))
        states = F.flatten(F.transform(w, lambda x: F.transform(F.split(x, ""), lambda c, i: F.struct(c.alias("c"), F.when(F.length(x) == 1, SINGLE).when(i == 0, BEGIN).when(i == F.length(x) - 1, END).otherwise(MIDDLE).alias("s")))))
        rows = segmented.select(states.alias("_x")).filter(F.size("_x") > 0)
        first = _collected(rows.groupBy(F.col("_x")[0]["s"].alias("s")).count())
        pairs = _collected(rows.select(F.explode(F.zip_with(F.slice("_x", F.lit(1), F.size("_x") - 1), F.slice("_x", F.lit(2), F.size("_x")), lambda a, b: F.struct(a["s"].alias("a"), b["s"].alias("b")))).alias("p")).groupBy("p.a", "p.b").count())
        seen = _collected(rows.select(F.explode("_x").alias("x")).groupBy("x.c", "x.s").count())
        starts, moves = np.zeros(4), np.zeros((4, 4))
        starts[[BEGIN, SINGLE]] = 1
        for a, bs in FOLLOWS.items():
            moves[a, list(bs)] = 1
        for r in first:
            starts[r["s"]] += r["count"]
        for r in pairs:
            moves[r["a"], r["b"]] += r["count"]
        chars = {r["c"]: np.ones(4) for r in seen}
        for r in seen:
            chars[r["c"]][r["s"]] += r["count"]
        total = sum(chars.values(), np.ones(4))  # one place for characters not seen
        with np.errstate(divide="ignore"):
            log = lambda x: np.maximum(np.log(x), NEVER)
            return CharacterModel(log(starts / starts.sum()), log(moves / moves.sum(axis=1, keepdims=True)), {c: np.log(v / total) for c, v in chars.items()}, np.log(1 / total))

    def scores(self, run: str) -> np.ndarray:
        return np.array([self.emissions.get(c, self.unseen) for c in run])

    def cut(self, runs: list[str]) -> list[list[str]]:
        """The most probable words of each run (of non-empty strings), all runs step by step together."""
        if not runs:
            return []
        order = sorted(range(len(runs)), key=lambda i: -len(runs[i]))
        sizes = np.array([len(runs[i]) for i in order])
        flat = [self.scores(runs[i]) for i in order]
        most = int(sizes[0])
        emit = np.zeros((most, len(runs), 4))
        for k, e in enumerate(flat):
            emit[: len(e), k] = e
        best = self.start + emit[0]
        back = np.zeros((most, len(runs), 4), np.int8)
        ends = np.zeros(len(runs), np.int64)
        closing = np.array([NEVER, NEVER, 0.0, 0.0])
        for t in range(1, most + 1):
            live = int(np.searchsorted(-sizes, -t, side="left"))  # runs longer than t
            done = slice(live, int(np.searchsorted(-sizes, -t, side="right")))
            ends[done] = (best[done] + closing).argmax(axis=1)
            if t < most:
                ways = best[:live, :, None] + self.moves[None]
                back[t, :live] = ways.argmax(axis=1)
                best = ways.max(axis=1) + emit[t, :live]
        out: list[list[str]] = [[] for _ in runs]
        for k, i in enumerate(order):
            run, state, words, to = runs[i], int(ends[k]), [], len(runs[i])
            for t in range(len(run) - 1, -1, -1):
                if state in (BEGIN, SINGLE):
                    words.append(run[t:to])
                    to = t
                state = int(back[t, k, state])
            out[i] = words[::-1]
        return out


@dataclass
class TagModel:
    """Log probabilities of tags at the start, of their successions, and of words by tag."""

    tags: list[str]
    start: np.ndarray
    moves: np.ndarray
    words: dict[str, np.ndarray]
    unknown: np.ndarray

    @staticmethod
    def fit(tagged: DataFrame, words: str = "words", tags: str = "tags") -> TagModel:
        """From rows with an array of words and one of tags; unknown words are as likely in a tag as words seen once in it."""
        pairs = F.filter(F.arrays_zip(F.col(words).alias("w"), F.col(tags).alias("t")), lambda x: x["w"].isNotNull() & x["t"].isNotNull())
        rows = tagged.select(F.transform(pairs, lambda x: F.struct(x["w"].alias("w"), x["t"].alias("t"))).alias("_x")).filter(F.size("_x") > 0)
        first = _collected(rows.groupBy(F.col("_x")[0]["t"].alias("t")).count())
        follow = _collected(rows.select(F.explode(F.zip_with(F.slice("_x", F.lit(1), F.size("_x") - 1), F.slice("_x", F.lit(2), F.size("_x")), lambda a, b: F.struct(a["t"].alias("a"), b["t"].alias("b")))).alias("p")).groupBy("p.a", "p.b").count())
        seen = _collected(rows.select(F.explode("_x").alias("x")).groupBy("x.w", "x.t").count())
        names = sorted({r["t"] for r in seen})
        at = {t: i for i, t in enumerate(names)}
        n = len(names)
        starts, moves, total, once = np.ones(n), np.ones((n, n)), np.zeros(n), np.ones(n)
        counts: dict[str, np.ndarray] = {}
        for r in first:
            starts[at[r["t"]]] += r["count"]
        for r in follow:
            moves[at[r["a"]], at[r["b"]]] += r["count"]
        for r in seen:
            counts.setdefault(r["w"], np.zeros(n))[at[r["t"]]] += r["count"]
            total[at[r["t"]]] += r["count"]
            once[at[r["t"]]] += r["count"] == 1
        with np.errstate(divide="ignore"):
            log = lambda x: np.maximum(np.log(x), NEVER)
            return TagModel(names, log(starts / starts.sum()), log(moves / moves.sum(axis=1, keepdims=True)), {w: log(c / (total + once)) for w, c in counts.items()}, log(once / (total + once) / max(len(counts), 1)))

    def emission(self, word: str) -> np.ndarray:
        known = self.words.get(word)
        if known is not None:
            return known
        fixed = "eng" if re.fullmatch("[A-Za-z][A-Za-z0-9+.]*", word) else "m" if re.fullmatch("[0-9.]+", word) else None
        if fixed in self.tags:  # Latin words and numbers tell their tag
            return np.where(np.array(self.tags) == fixed, 0.0, NEVER)
        return self.unknown

    def decode(self, sentences: list[list[str]]) -> list[list[str]]:
        """The most probable tags of each sentence's words, all sentences step by step together."""
        order = sorted((i for i, s in enumerate(sentences) if s), key=lambda i: -len(sentences[i]))
        out: list[list[str]] = [[] for _ in sentences]
        if not order or not self.tags:
            return out
        sizes = np.array([len(sentences[i]) for i in order])
        emit = np.zeros((int(sizes[0]), len(order), len(self.tags)))
        for k, i in enumerate(order):
            emit[: len(sentences[i]), k] = [self.emission(w) for w in sentences[i]]
        best, back, last = self.start + emit[0], np.zeros(emit.shape, np.int32), np.zeros(len(order), np.int64)
        for t in range(1, len(emit) + 1):
            live = int(np.searchsorted(-sizes, -t, side="left"))
            done = slice(live, int(np.searchsorted(-sizes, -t, side="right")))
            last[done] = best[done].argmax(axis=1)
            if t < len(emit):
                ways = best[:live, :, None] + self.moves[None]
                back[t, :live] = ways.argmax(axis=1)
                best = ways.max(axis=1) + emit[t, :live]
        for k, i in enumerate(order):
            tag, tags = int(last[k]), []
            for t in range(len(sentences[i]) - 1, -1, -1):
                tags.append(self.tags[tag])
                tag = int(back[t, k, tag])
            out[i] = tags[::-1]
        return out


@dataclass
class Segmenter:
    """``words``: word -> frequency. Without a character model a stretch of unknown single characters is one word."""

    words: dict[str, int]
    characters: CharacterModel | None = None
    tags: TagModel | None = None
    run: str = HAN_RUN
    other: str = WORDS
    automaton: Automaton = field(init=False)

    def __post_init__(self) -> None:
        # one character is no pattern of the automaton where it is a single byte: single ones are edges in any case
        self.automaton = Automaton.build((w, w) for w in self.words if len(w) > 1)
        self.automaton.bounded[:] = False
        self.total = sum(self.words.values()) or 1
        self.logs = np.array([np.log(self.words[w] / self.total) for w in self.automaton.labels]) if self.automaton.labels else np.zeros(0)

    def paths(self, runs: list[str]) -> list[list[str]]:
        """The most probable dictionary words of each run; of equal ways the one with the longest last word."""
        if not runs:
            return []
        sizes = np.array([len(r) for r in runs])
        row, start, end, pattern = self.automaton.search(runs)
        width = int(sizes.max()) + 1
        best = np.full((len(runs), width), NEVER)
        came = np.zeros((len(runs), width), np.int64)
        best[:, 0] = 0.0
        single = np.full((len(runs), width), np.log(0.5 / self.total))
        for i, r in enumerate(runs):
            single[i, : len(r)] = [np.log((self.words.get(c) or 0.5) / self.total) for c in r]
        by_end = np.argsort(end, kind="stable")
        cuts = np.searchsorted(end[by_end], np.arange(width + 1))
        for p in range(1, width):
            best[:, p], came[:, p] = best[:, p - 1] + single[:, p - 1], p - 1
            edges = by_end[cuts[p] : cuts[p + 1]]
            edges = edges[np.argsort(-start[edges], kind="stable")]  # shorter first: of equal ways a later, longer one stays
            for begin in np.unique(start[edges])[::-1].tolist():
                e = edges[start[edges] == begin]  # one for each row
                score = best[row[e], begin] + self.logs[pattern[e]]
                better = score >= best[row[e], p]
                best[row[e][better], p], came[row[e][better], p] = score[better], begin
        out = []
        for i, r in enumerate(runs):
            to, words = len(r), []
            while to:
                words.append(r[came[i, to] : to])
                to = int(came[i, to])
            out.append(words[::-1])
        return out

    def segment(self, texts: list[str]) -> list[list[str]]:
        """Words of each text: runs of the script are cut, other words stay whole, the rest goes."""
        pieces = [re.findall(f"{self.run}|{self.other}", t) for t in texts]
        cut = re.compile(self.run)
        runs = sorted({p for ps in pieces for p in ps if cut.fullmatch(p)})
        groups: dict[str, list[tuple[str, bool]]] = {}  # words, and whether single characters that the dictionary leaves
        for r, words in zip(runs, self.paths(runs), strict=True):
            kept: list[tuple[str, bool]] = []
            for w in words:
                loose = len(w) == 1 and w not in self.words
                if loose and kept and kept[-1][1]:
                    kept[-1] = (kept[-1][0] + w, True)
                else:
                    kept.append((w, loose))
            groups[r] = kept
        unknown = sorted({w for g in groups.values() for w, loose in g if loose and len(w) > 1})
        ways = dict(zip(unknown, self.characters.cut(unknown), strict=True)) if self.characters else {}
        done = {r: [x for w, _ in g for x in ways.get(w, [w])] for r, g in groups.items()}
        return [[x for p in ps for x in done.get(p, [p])] for ps in pieces]

    def tagged(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        words = self.segment(texts)
        tags = self.tags.decode(words) if self.tags else [[""] * len(w) for w in words]
        return [list(zip(w, t, strict=True)) for w, t in zip(words, tags, strict=True)]


#: Rows that a task of rules in Python takes at least where cores would else be idle, and about at most.
LEAST_ROWS, MOST_ROWS = 500, 20_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks, by their number: files may be few and small, while the rules on each row are slow."""
    n = rows.count()
    return rows.repartition(max(min(rows.sparkSession.sparkContext.defaultParallelism, n // LEAST_ROWS), n // MOST_ROWS, 1))


def tagged_words(texts: DataFrame, segmenter: Segmenter, id_col: str = "id", text_col: str = "title") -> DataFrame:
    """(id, pos, word, tag) of the texts, in Arrow batches; a null text has no words."""

    @F.pandas_udf("array<struct<word: string, tag: string>>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([[{"word": w, "tag": t} for w, t in x] for x in segmenter.tagged([t or "" for t in batch])])

    return spread(texts.select(id_col, text_col)).select(id_col, F.posexplode(run(text_col)).alias("pos", "w")).select(id_col, "pos", "w.word", "w.tag")


def kind_of(tag) -> object:
    """Nouns and Latin words are entities, everything else is a keyword."""
    return F.when(tag.startswith("n") | (tag == "eng"), "entity").otherwise("keyword")
