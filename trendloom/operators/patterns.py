"""All occurrences of many patterns in texts: an Aho-Corasick automaton as flat arrays, run over Arrow batches.

A batch's texts are one array of character codes, cut into chunks that overlap by the longest pattern; all chunks take one
step at a time, so that a step is a few array operations however many texts there are and however long one is. Hits
overlap and nest freely. Dictionaries are cut into automata of bounded size, which are broadcast.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk; characters of patterns in one automaton (some 40 bytes each as a broadcast); characters of texts
#: that are searched at once (a longer text stands alone).
CHUNK, MOST_CHARS, SLICE_CHARS = 256, 1_000_000, 1_000_000
#: Entries of transitions that are held as a full table rather than a sorted list.
FULL_TABLE = 16_000_000


@dataclass
class Automaton:
    """States are numbered by breadth; code 0 is any character that no pattern has."""

    labels: list[str]
    lengths: np.ndarray
    bounded: np.ndarray
    alphabet: np.ndarray
    keys: np.ndarray
    targets: np.ndarray
    failure: np.ndarray
    pattern: np.ndarray
    link: np.ndarray
    full: np.ndarray | None = None

    @staticmethod
    def build(entries: Iterable[tuple[str, str]]) -> Automaton:
        """From (pattern, label): of a pattern's labels the first counts, patterns of under two bytes are left out. Short
        ASCII patterns (three characters at most) hit between other characters than letters and digits only."""
        first: dict[str, str] = {}
        for p, label in entries:
            if len(p.encode()) >= 2:
                first.setdefault(p, label)
        goto: list[dict[str, int]] = [{}]
        ends: list[int] = [-1]
        for k, p in enumerate(first):
            at = 0
            for c in p:
                if c not in goto[at]:
                    goto[at][c] = len(goto)
                    goto.append({})
                    ends.append(-1)
                at = goto[at][c]
            ends[at] = k
        failure, link, order = [0] * len(goto), [0] * len(goto), [0]
        queue = deque(goto[0].values())
        while queue:
            s = queue.popleft()
            order.append(s)
            link[s] = failure[s] if ends[failure[s]] >= 0 else link[failure[s]]
            for c, t in goto[s].items():
                f = failure[s]
                while f and c not in goto[f]:
                    f = failure[f]
                failure[t] = goto[f].get(c, 0)
                queue.append(t)
        alphabet = np.array(sorted({ord(c) for g in goto for c in g}), dtype=np.int64)
        width = len(alphabet) + 1
        edges = sorted((s * width + int(np.searchsorted(alphabet, ord(c))) + 1, t) for s, g in enumerate(goto) for c, t in g.items())
        out = Automaton(
            list(first.values()), np.array([len(p) for p in first], np.int64), np.array([len(p) <= 3 and p.isascii() for p in first], bool), alphabet,
            np.array([k for k, _ in edges], np.int64), np.array([t for _, t in edges], np.int64), np.array(failure, np.int64), np.array(ends, np.int64), np.array(link, np.int64),
        )
        if len(goto) * width <= FULL_TABLE:
            full = np.zeros((len(goto), width), np.int32)
            for s in order:  # a failure state comes before the state
                full[s] = full[failure[s]]
                for c, t in goto[s].items():
                    full[s, np.searchsorted(alphabet, ord(c)) + 1] = t
            out.full = full.ravel()
        return out

    def _step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        width = len(self.alphabet) + 1
        if self.full is not None:
            return self.full[state * width + code]
        out = np.zeros(len(state), np.int64)
        open_ = np.flatnonzero(code)
        at = state[open_]
        while len(open_):
            key = at * width + code[open_]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            out[open_[hit]] = self.targets[place[hit]]
            rest = ~hit & (at > 0)
            open_, at = open_[rest], self.failure[at[rest]]
        return out

    def search(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, start, end, pattern) of all hits, by text and end, longer ones first."""
        none = np.zeros(0, np.int64)
        if not len(self.lengths) or not any(texts):
            return none, none, none, none
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.empty(len(points), np.int32)
        for at in range(0, len(points), SLICE_CHARS):
            part = points[at : at + SLICE_CHARS].astype(np.int64)
            place = np.minimum(np.searchsorted(self.alphabet, part), len(self.alphabet) - 1)
            codes[at : at + SLICE_CHARS] = np.where(self.alphabet[place] == part, place + 1, 0)
        sizes = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(sizes) - sizes
        over = int(self.lengths.max()) - 1
        pieces = -(-sizes // CHUNK)
        row = np.repeat(np.arange(len(texts)), pieces)
        number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        own = begin[row] + number * CHUNK  # hits that end here or before belong to the chunk before
        start, end = np.maximum(own - over, begin[row]), np.minimum(own + CHUNK, begin[row] + sizes[row])
        state = np.zeros(len(row), np.int64)
        found = []
        by_length = np.argsort(start - end, kind="stable")
        row, own, start, end = (x[by_length] for x in (row, own, start, end))
        steps = end - start
        for step in range(int(steps.max())):
            live = int(np.searchsorted(-steps, -step, side="left"))
            state = self._step(state[:live].astype(np.int64), codes[start[:live] + step])
            out = np.where(self.pattern[state] >= 0, state, self.link[state])
            at = np.flatnonzero((out > 0) & (start[:live] + step >= own[:live]))
            out = out[at]
            while len(at):
                found.append((row[at], start[at] + step + 1, self.pattern[out]))
                out = self.link[out]
                at, out = at[out > 0], out[out > 0]
        if not found:
            return none, none, none, none
        rows, ends, patterns = (np.concatenate(x) for x in zip(*found, strict=True))
        starts = ends - self.lengths[patterns]
        word = ((points >= 48) & (points <= 57)) | ((points >= 97) & (points <= 122)) | ((points >= 65) & (points <= 90))
        left = (starts > begin[rows]) & word[np.maximum(starts - 1, 0)]
        right = (ends < begin[rows] + sizes[rows]) & word[np.minimum(ends, len(word) - 1)]
        keep = ~(self.bounded[patterns] & (left | right))
        rows, starts, ends, patterns = rows[keep], starts[keep], ends[keep], patterns[keep]
        order = np.lexsort((starts, ends))
        return rows[order], (starts - begin[rows])[order], (ends - begin[rows])[order], patterns[order]

    def labels_of(self, texts: list[str]) -> list[list[str]]:
        """The labels that occur in each text, in the order of their first ends."""
        out: list[dict[str, None]] = [{} for _ in texts]
        rows, _, _, patterns = self.search(texts)
        for r, p in zip(rows.tolist(), patterns.tolist(), strict=True):
            out[r].setdefault(self.labels[p])
        return [list(x) for x in out]


def lowered(text: str | None) -> str:
    """Lower case with one character for each: offsets stay those of the text."""
    text = text or ""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def slices(batch: pd.DataFrame, texts: pd.Series) -> Iterator[pd.DataFrame]:
    """Parts of a batch of about SLICE_CHARS characters."""
    size = texts.map(lambda t: len(t) if t else 0).cumsum() // SLICE_CHARS
    for _, part in batch.groupby(size.to_numpy(), sort=False):
        yield part


def automata(dictionary: DataFrame, pattern: str = "pattern", label: str = "label", most_chars: int = MOST_CHARS) -> Iterator[Automaton]:
    """Automata of at most ``most_chars`` characters of patterns each that hold the dictionary between them, read part by part."""
    held: list[tuple[str, str]] = []
    size = 0
    for r in dictionary.groupBy(F.lower(F.trim(pattern)).alias("p")).agg(F.min(label).alias("label")).filter("p is not null and label is not null").orderBy("p").toLocalIterator():
        if held and size + len(r["p"]) > most_chars:
            yield Automaton.build(held)
            held, size = [], 0
        held.append((r["p"], r["label"]))
        size += len(r["p"])
    if held:
        yield Automaton.build(held)


def dictionary_hits(texts: DataFrame, dictionary: DataFrame, id_col: str = "id", text_col: str = "text", most_chars: int = MOST_CHARS) -> DataFrame:
    """(id, label, start, end) of every occurrence of a dictionary's patterns (pattern, label) in the lower-cased texts.

    A pass over the texts for each automaton; a dictionary within ``most_chars`` is one. A null text is empty."""
    spark = texts.sparkSession
    kind = texts.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, label string, start long, end long"
    out: DataFrame | None = None
    for automaton in automata(dictionary, most_chars=most_chars):
        shipped = spark.sparkContext.broadcast(automaton)

        def run(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            a = shipped.value
            labels = np.array(a.labels, dtype=object)
            for b in batches:
                for part in slices(b, b.iloc[:, 1]):
                    rows, start, end, pattern = a.search([lowered(t) for t in part.iloc[:, 1]])
                    yield pd.DataFrame({id_col: part.iloc[rows, 0].to_numpy(), "label": labels[pattern], "start": start, "end": end})

        found = texts.select(id_col, text_col).mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out
