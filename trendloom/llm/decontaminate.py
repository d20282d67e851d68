"""Benchmark decontamination: rare words as seeds, then Smith-Waterman alignment.

The words of the test items are counted over all documents (documents holding them). A score is the best local
alignment's share of what the item scores against itself, so that edited and paraphrased copies score by what they
kept. Documents with a score of ``least`` or more are contaminated.

The seeds lose none of them. With b = 2 * (1 - least) for each word of an item, an alignment that reaches ``least``
leaves at most b / 2 of the item's words unmatched and inserts at most b words. So of the item's b / 2 + k rarest
words at least k stand in the document, within the item's length and b words. Places where they do are aligned.

Longer seeds would lose copies: with a word put between all others, or every third word changed, an item still reaches a score of
one half while hardly any two of its words stand together. So the n-grams are of one word, and what joins them is their places.

Benchmarks go to the workers in chunks of bounded size, one pass over the documents for each.

Defined results: null or empty texts and items match nothing; repeated ids report row by row, and items of equal score each their
own row; an empty table gives no rows; other columns are ignored; texts are searched whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import slices

#: Least share of an item's own score; characters of items that one pass takes.
LEAST, CHUNK_CHARS = 0.5, 16_000_000
MATCH, MISS, GAP = 2, -1, -1
#: Besides those it can lose, an item has a seed word more for each SPARE of its words.
SPARE = 8
#: Cells of alignment rows that are worked on at once.
CELLS = 400_000

_trim = ".,;:!?\"'()[]{}<>*#|&%$"


def _words(text: str | None) -> list[str]:
    return [x for w in (text or "").lower().split() if (x := w.strip(_trim))]


class Items:
    """The items of a chunk with their words as numbers."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        words = [_words(t) for _, t in rows]
        self.number = {w: k + 1 for k, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.words = [np.array([self.number[w] for w in ws], np.int64) for ws in words]
        keys = [np.unique(ws) + k * (len(self.number) + 1) for k, ws in enumerate(self.words)]
        self.has = np.concatenate(keys) if keys else np.zeros(0, np.int64)

    def bounds(self, owner: list[int], regions: list[np.ndarray]) -> np.ndarray:
        """Share of the item's own score that no alignment with the region exceeds: its words count as matches in any order."""
        if not owner:
            return np.zeros(0)
        size = np.array([len(r) for r in regions])
        key = np.repeat(np.array(owner) * (len(self.number) + 1), size) + np.concatenate(regions)
        gain = np.where(self.has[np.minimum(np.searchsorted(self.has, key), len(self.has) - 1)] == key, MATCH, MISS)
        head = np.cumsum(size) - size
        # before each region the sum falls so far that the running minimum starts anew there
        fall = np.zeros(len(gain), np.int64)
        fall[head] = (MATCH - MISS) * int(size.max())
        before = np.cumsum(gain - fall) - gain
        best = np.maximum.reduceat(before + gain - np.minimum.accumulate(before), head)
        return best / (MATCH * np.array([len(self.words[k]) for k in owner]))

    def numbers(self, text: str) -> np.ndarray:
        """Word numbers of a text; words of no item are 0."""
        ws = text.lower().split()
        get = self.number.get
        return np.fromiter((get(w) or get(w.strip(_trim), 0) for w in ws), np.int64, len(ws))


class Seeds:
    """Per word the items it is a seed of; per item how many seeds must stand how close together."""

    def __init__(self, items: Items, frequency: np.ndarray, least: float):
        size = np.array([len(ws) for ws in items.words], np.int64)
        spend = np.floor(MATCH * size * (1 - least) + 1e-9).astype(np.int64)
        lost = np.minimum(spend // 2, size)
        self.need = np.maximum(np.minimum(size - lost, 1 + size // SPARE), 1)
        self.reach = size + spend
        word, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, ws in enumerate(items.words):
            rare = ws[np.lexsort((ws, frequency[ws]))][: lost[k] + self.need[k]]
            word.append(np.unique(rare))
            owner.append(np.full(len(word[-1]), k))
        words, owners = np.concatenate(word), np.concatenate(owner)
        self.owner = owners[np.argsort(words, kind="stable")]
        self.first = np.searchsorted(np.sort(words), np.arange(len(frequency) + 1))

    def regions(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, from, to) of the parts of a document that can reach the least score, overlapping ones as one."""
        many = self.first[numbers + 1] - self.first[numbers]
        place = np.flatnonzero(many)
        many = many[place]
        ends = np.cumsum(many)
        at = np.repeat(self.first[numbers[place]] - (ends - many), many) + np.arange(ends[-1] if len(ends) else 0)
        item, place = self.owner[at], np.repeat(place, many)
        by = np.argsort(item, kind="stable")
        item, place = item[by], place[by]
        i = np.arange(len(item))
        j = i + self.need[item] - 1
        ok = j < len(item)
        i, j = i[ok], j[ok]
        ok = (item[j] == item[i]) & (place[j] - place[i] < self.reach[item[i]])
        i, j = i[ok], j[ok]
        item, lo, hi = item[i], np.maximum(place[j] - self.reach[item[i]] + 1, 0), np.minimum(place[i] + self.reach[item[i]], len(numbers))
        # one after another by place, the starts and ends of an item's regions both grow
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (lo[1:] >= hi[:-1])
        return item[new], lo[new], hi[np.r_[np.flatnonzero(new)[1:] - 1, len(hi) - 1]] if len(hi) else hi


def align(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, int]]:
    """Share of the item's own score and end place of the best local alignment of each (item, region)."""
    out: list[tuple[float, int]] = [(0.0, 0)] * len(pairs)
    order = sorted(range(len(pairs)), key=lambda k: (len(pairs[k][0]), len(pairs[k][1])))
    at = 0
    while at < len(order):
        take, wide = [], 0
        while at < len(order) and (not take or (len(take) + 1) * max(wide, len(pairs[order[at]][1])) <= CELLS):
            take.append(order[at])
            wide = max(wide, len(pairs[order[at]][1]))
            at += 1
        tall = max(len(pairs[k][0]) for k in take)
        item = np.full((len(take), tall), -1, np.int64)
        region = np.full((len(take), wide), -2, np.int64)
        for r, k in enumerate(take):
            item[r, : len(pairs[k][0])] = pairs[k][0]
            region[r, : len(pairs[k][1])] = pairs[k][1]
        ramp = np.arange(wide + 1, dtype=np.int32) * -GAP
        row = np.zeros((len(take), wide + 1), np.int32)
        best, end = np.zeros(len(take), np.int32), np.zeros(len(take), np.int64)
        for i in range(tall):
            step = np.where(item[:, i : i + 1] == region, MATCH, MISS).astype(np.int32)
            new = np.maximum(row + GAP, 0)
            new[:, 1:] = np.maximum(new[:, 1:], row[:, :-1] + step)
            # gaps along the row: the running maximum with the falling ramp taken off
            row = np.maximum.accumulate(new + ramp, 1) - ramp
            top = row.max(1)
            better = top > best
            if better.any():
                best[better] = top[better]
                end[better] = row[better].argmax(1)
        for r, k in enumerate(take):
            out[k] = (float(best[r]) / (MATCH * len(pairs[k][0])), int(end[r]))
    return out


def _document_frequencies(source: DataFrame, items: Items) -> np.ndarray:
    """How many documents have each word of the items, by word number."""
    size = len(items.number) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(1):
                t = text.as_py()
                if t:
                    count[np.unique(items.numbers(t))] += 1
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], names=["word", "n"])

    total = np.zeros(size, np.int64)
    # one row for each word of the chunk at most
    for row in source.mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator():
        total[row["word"]] = row["n"]
    return total


def _matches(source: DataFrame, items: Items, frequency: np.ndarray, least: float) -> DataFrame:
    seeds = Seeds(items, frequency, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                pairs, about = [], []
                for i in range(a, b):
                    if not texts[i]:
                        continue
                    numbers = items.numbers(texts[i])
                    for k, x, y in zip(*(c.tolist() for c in seeds.regions(numbers)), strict=True):
                        pairs.append((items.words[k], numbers[x:y]))
                        about.append((i, k, x))
                able = np.flatnonzero(items.bounds([k for _, k, _ in about], [r for _, r in pairs]) >= least).tolist()
                pairs, about = [pairs[j] for j in able], [about[j] for j in able]
                best: dict[tuple[int, int], tuple[float, int]] = {}
                for (i, k, x), (score, end) in zip(about, align(pairs), strict=True):
                    if score >= least and score > best.get((i, k), (0.0, 0))[0]:
                        best[i, k] = (score, x + end)
                rows = sorted(best)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())), pa.array([items.ids[k] for _, k in rows], pa.int64()), pa.array([best[r][0] for r in rows], pa.float64()), pa.array([best[r][1] for r in rows], pa.int64())],
                    names=["id", "item_id", "score", "end_word"],
                )

    return source.mapInArrow(run, "id bigint, item_id bigint, score double, end_word bigint")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, chunk_chars: int = CHUNK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, score, end_word) of every row and item whose best alignment reaches ``least``."""
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("bigint").alias("id"), F.col(item_text_col).alias("text")).filter(F.length("text") > 0)
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    chunks = total // chunk_chars + 1
    out = None
    for c in range(chunks):
        part = items.filter(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c)
        rows = sorted((r["id"], r["text"]) for r in part.collect())  # about chunk_chars characters
        own = Items(rows)
        if not own.number:
            continue
        found = _matches(source, own, _document_frequencies(source, own), least)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = source.limit(0).select("id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).cast("bigint").alias("end_word"))
    return out.withColumnRenamed("id", id_col).withColumnRenamed("item_id", item_col if item_col != id_col else "item_id")
