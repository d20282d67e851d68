"""Token counts of a piece vocabulary with byte fallback, by rank-synchronous array merging.

Texts are cut into pre-tokens at places that no vocabulary piece spans, distinct pre-tokens are held as ragged
numpy arrays of symbols, and every round merges the lowest-rank pair of every sequence at once. What is left
when no pair merges are the tokens. Results are kept per pre-token in a bounded table, so that frequent
pre-tokens are merged once per Python worker.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows are counted row by row; columns
other than id and text are ignored; text of any length is counted whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trendloom.llm.common import slices

NEVER = np.int32(2**31 - 1)
MARK = "▁"  # fixed value: how the vocabulary writes a space
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Pre-tokens whose counts a worker keeps before it starts afresh.
KEPT = 1_000_000


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message."""
    i = 0

    def number() -> int:
        nonlocal i
        shift = value = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        key = number()
        field, wire = key >> 3, key & 7
        if wire == 0:
            yield field, number()
        elif wire == 2:
            size = number()
            yield field, raw[i : i + size]
            i += size
        else:
            size = 4 if wire == 5 else 8
            yield field, struct.unpack("<f" if wire == 5 else "<d", raw[i : i + size])[0]
            i += size


class PieceVocabulary:
    """Merge table of a piece model: which two symbols join, with which rank, into which symbol."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        pieces: list[tuple[str, float, int]] = []
        normal: dict[int, object] = {}
        trainer: dict[int, object] = {}
        for field, value in _fields(raw):
            if field == 1:
                d = dict(_fields(value))
                pieces.append((d[1].decode("utf-8"), float(d.get(2, 0.0)), int(d.get(3, NORMAL))))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                normal = dict(_fields(value))
        if normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1) or not trainer.get(35) or trainer.get(3) != 2:
            raise ValueError("only byte-fallback BPE models with identity normalisation and a dummy prefix are supported")
        if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        scored = {p: s for p, s, kind in pieces if kind == NORMAL}
        levels = {s: r for r, s in enumerate(sorted(set(scored.values()), reverse=True))}
        chars = sorted({c for p in scored for c in p})
        symbols = [*chars, *(p for p in scored if len(p) > 1)]
        number = {p: i for i, p in enumerate(symbols)}
        self.other = len(symbols)  # characters of no piece
        self.char_id = np.full(0x110000, self.other, np.int32)
        self.char_id[[ord(c) for c in chars]] = np.arange(len(chars), dtype=np.int32)
        single = np.ones(len(symbols) + 1, np.int64)
        single[[number[c] for c in chars if c not in scored]] = 0
        self.in_vocabulary = single.astype(bool)
        keys, ranks, into, careful = [], [], [], np.zeros(len(symbols) + 1, bool)
        for p, score in scored.items():
            rank = levels[score]
            for k in range(1, len(p)):
                a, b = number.get(p[:k]), number.get(p[k:])
                if a is None or b is None:
                    continue
                keys.append(a * (self.other + 1) + b)
                ranks.append(rank)
                into.append(number[p])
                for part in (p[:k], p[k:]):  # a join that may enable one of no higher rank goes alone
                    if len(part) > 1 and rank <= levels[scored[part]]:
                        careful[number[part]] = True
        order = np.argsort(keys)
        self.keys = np.asarray(keys, np.int64)[order]
        self.ranks = np.asarray(ranks, np.int32)[order]
        self.into = np.asarray(into, np.int32)[order]
        self.careful = careful
        inside = {ord(p[i]) * 0x110000 + ord(p[i + 1]) for p in scored for i in range(len(p) - 1)}
        self.inside = np.asarray(sorted(inside), np.int64)
        if any(p[i] != MARK and p[i + 1] == MARK for p in scored for i in range(len(p) - 1)) or any("\n" in p for p in scored):
            raise ValueError("pieces that hold a space after another character, or a line end, are not supported")

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER if they don't join) and result of neighbouring symbols."""
        key = left.astype(np.int64) * (self.other + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), np.where(hit, self.into[at], -1).astype(np.int32)

    def count(self, pretokens: list[str]) -> np.ndarray:
        """Tokens of each pre-token, without a dummy prefix."""
        out = np.zeros(len(pretokens), np.int64)
        lengths = np.fromiter(map(len, pretokens), np.int64, len(pretokens))
        code = np.frombuffer("".join(pretokens).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(code):
            return out
        owner = np.repeat(np.arange(len(pretokens)), lengths)
        sym = self.char_id[code]
        alone = ~self.in_vocabulary[sym] | (sym == self.other)
        utf8 = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        # a character outside the vocabulary becomes its bytes; each other one starts as one symbol
        out += np.bincount(owner, np.where(alone, utf8, 1), len(pretokens)).astype(np.int64)
        pair_code = code[:-1] * 0x110000 + code[1:]
        at = np.minimum(np.searchsorted(self.inside, pair_code), len(self.inside) - 1)
        start = np.ones(len(code), bool)
        start[1:] = (owner[1:] != owner[:-1]) | (self.inside[at] != pair_code)
        joined = self._merge(sym, np.cumsum(start) - 1, owner, len(pretokens))
        return out - joined

    def _merge(self, sym: np.ndarray, seq: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """How many joins the symbols of each owner make; seq numbers the independent sequences."""
        joined = np.zeros(n, np.int64)
        sym = sym.copy()
        rank = np.full(len(sym), NEVER, np.int32)
        into = np.full(len(sym), -1, np.int32)
        same = np.flatnonzero(seq[1:] == seq[:-1])
        rank[same], into[same] = self.pairs(sym[same], sym[same + 1])
        while True:
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(seq)])
            live = low != NEVER
            if not live.all():
                keep = np.repeat(live, size)
                sym, seq, owner, rank, into = sym[keep], seq[keep], owner[keep], rank[keep], into[keep]
                low, size = low[live], size[live]
                if not len(sym):
                    return joined
            nth = np.repeat(np.arange(len(size)), size)
            at = np.flatnonzero(rank == low[nth])
            group = nth[at]
            head = np.r_[True, group[1:] != group[:-1]]
            lone = np.logical_or.reduceat(self.careful[into[at]], np.flatnonzero(head))
            # of overlapping places every other one, from the left; where order matters only the leftmost
            run = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | head[1:]])
            turn = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[np.where(lone[group], head, turn % 2 == 0)]
            joined += np.bincount(owner[at], minlength=n)
            sym[at] = into[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            moved = np.cumsum(stay) - 1
            sym, seq, owner, rank, into = sym[stay], seq[stay], owner[stay], rank[stay], into[stay]
            here = moved[at]
            touched = np.zeros(len(sym) + 1, bool)
            touched[here] = touched[here - 1] = True  # -1 is the spare last place
            changed = np.flatnonzero(touched[:-1])
            rank[changed] = NEVER
            inner = changed[changed < len(seq) - 1]
            inner = inner[seq[inner] == seq[inner + 1]]
            rank[inner], into[inner] = self.pairs(sym[inner], sym[inner + 1])


class TokenCounter:
    """Counts whole texts through a bounded table of pre-token counts."""

    _runs = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def __init__(self, path: str, kept: int = KEPT):
        self.vocabulary = PieceVocabulary(path)
        self.kept = kept
        self.table: dict[str, int] = {}

    def pretokens(self, text: str) -> list[str]:
        """Keys of the table: words with their leading space left out, or (after NUL) strings as they are.

        "\\0x" stands for a line end and x; "\\0\\0x" for x itself."""
        if not text:
            return []
        if "\0" in text or MARK in text or "  " in text or text[0] == " ":
            return ["\0\0" + run for run in self._runs.findall(MARK + text.replace(" ", MARK))]
        return text.replace("\n", " \0").split(" ")

    @staticmethod
    def spelled(key: str) -> str:
        if key.startswith("\0\0"):
            return key[2:]
        return "\n" + key[1:] if key.startswith("\0") else MARK + key

    def count(self, texts: list[str | None]) -> list[int]:
        found = [0] * len(texts)
        for a, b in slices(texts):
            keys = [self.pretokens(t or "") for t in texts[a:b]]
            fresh = set()
            for k in keys:
                fresh.update(k)
            if len(self.table) + len(fresh) > self.kept:
                self.table = {}
            todo = [k for k in fresh if k not in self.table]
            self.table.update(zip(todo, self.vocabulary.count([self.spelled(k) for k in todo]).tolist(), strict=True))
            get = self.table.__getitem__
            found[a:b] = [sum(map(get, k)) for k in keys]
        return found


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens). ``model`` is a path on every node."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = c.count(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
