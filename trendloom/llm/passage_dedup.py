"""Removal of repeated lines, and of repeated passages within lines, by digests of normalised units.

Words are normalised (lower case, no ASCII punctuation, white space as one). The units are lines; each has a 128-bit
digest of its words. Digests are grouped globally; the earliest occurrence, by document id and place, stays, and all
others are cut out, with their offsets in the original text. A line of one document often stands in the midst of a line
of another, which line digests cannot see: so of what lines are left, every word also starts a run of LEAST words, and
the runs' digests are grouped the same way. A repeated passage goes from its first word to its last, wherever it stands.

Lines of fewer than ``least_line`` words stay where a document has them; by default that is LEAST, as short lines such
as notices and headings repeat in documents that are clean otherwise. With 1, every repeated line goes.

Blocks of documents offer each distinct digest once with its smallest id, so that a passage in very many documents
is as cheap as any other. Runs that stand in one block only are not offered: a run's anchor is the smallest hash among
its strings of LEAST / 2 words, equal for equal runs and for most neighbours; blocks first learn which of their anchors others
have. Runs wholly within a line that goes are neither named nor offered.

Defined results: null and empty texts stay as they are; rows with one id are ranked by their texts; an empty table
gives no rows; offsets count characters; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.blocks import BUCKET_DIGESTS, among, blocked, digest_groups, named_elsewhere, names, offers, owned_elsewhere, sent_digests, text_bytes
from trendloom.llm.hashing import POWERS, POWERS_TWO, Powers, mix, prefix_sums, word_spans

#: Words of a run, and of a line at least.
LEAST = 20
#: Kinds of rows exchanged: digests of lines and of runs, names of anchors.
LINES, RUNS, ANCHORS = 0, 1, 2

_punctuation = np.zeros(256, bool)
_punctuation[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _lowered(text: str, raw: bytes) -> np.ndarray:
    low = text.lower().encode()
    return np.frombuffer(low if len(low) == len(raw) else raw.lower(), np.uint8)


def _word_hashes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (byte places) of the words of a text, their hashes, and the numbers of the words that begin a line."""
    raw_bytes = text.encode()
    raw = np.frombuffer(raw_bytes, np.uint8)
    start, end = word_spans(raw)
    if not len(start):
        return start, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = _lowered(text, raw_bytes)
    use = ~_punctuation[low]
    place = np.r_[0, np.cumsum(use)]
    sums = prefix_sums(low[use])
    _, down = POWERS.of(len(sums))
    line = np.unique(np.r_[0, np.searchsorted(start, np.flatnonzero(raw == 10))])
    return start, mix((sums[place[end]] - sums[place[start]]) * down[place[start]]), line[line < len(start)]


def _between(word: np.ndarray, first: np.ndarray, until: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """Hashes of the strings of words from ``first`` to before ``until``."""
    up, down = powers.of(len(word) + 1)
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * up[:-1], out=total[1:])
    return mix((total[until] - total[first]) * down[first] + (until - first).astype(np.uint64))


def _strings(word: np.ndarray, n: int, powers: Powers = POWERS) -> np.ndarray:
    """Hashes of the strings of n words."""
    first = np.arange(max(len(word) - n + 1, 0))
    return _between(word, first, first + n, powers) if len(first) else np.zeros(0, np.uint64)


def _anchors(word: np.ndarray, least: int) -> np.ndarray:
    """Of each run of ``least`` words: the smallest hash among its strings of half as many."""
    low = _strings(word, max(least // 2, 1))
    wide, have = least - max(least // 2, 1) + 1, 1
    if len(low) < wide:
        return np.zeros(0, np.uint64)
    while have < wide:
        step = min(have, wide - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


class _Rows:
    """Rows of a block in rank order, with the words of all texts one after another."""

    def __init__(self, rows: pa.Table, least: int, least_line: int):
        ids, texts = rows.column("id").to_pylist(), rows.column("text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] or ""))
        self.ids, self.texts, self.least = [ids[i] for i in order], [texts[i] for i in order], least
        words = [_word_hashes(t or "") for t in self.texts]
        self.start, self.words = [w[0] for w in words], [w[1] for w in words]
        low = np.iinfo(np.int64).min
        owner = np.array([low if i is None else i for i in self.ids], np.int64)
        self.first_line, self.end_line, high, lower, n = [], [], [], [], []
        for start, word, line in words:
            until = np.r_[line[1:], len(start)].astype(np.int64)
            use = until - line >= least_line
            line, until = line[use], until[use]
            self.first_line.append(line)
            self.end_line.append(until)
            n.append(len(line))
            high.append(_between(word, line, until) if len(line) else np.zeros(0, np.uint64))
            lower.append(_between(mix(word), line, until, POWERS_TWO) if len(line) else np.zeros(0, np.uint64))
        none = [np.zeros(0, np.uint64)]
        self.line_digests = np.concatenate(high or none), np.concatenate(lower or none)
        self.line_owner = np.repeat(owner, n)
        self.owner = owner
        self.n_lines = n

    def lines_gone(self, sent: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Of each text, which of its lines have an earlier occurrence: in another block, or in this one."""
        gone = among(sent, *self.line_digests)
        order, head = digest_groups(*self.line_digests, np.arange(len(gone)))
        gone[order[~head]] = True
        return np.split(gone, np.cumsum(self.n_lines)[:-1]) if self.n_lines else []

    def runs(self, gone: list[np.ndarray] | None) -> list[np.ndarray]:
        """Of each text, the first words of its runs, without those within lines that go."""
        out = []
        for i, word in enumerate(self.words):
            first = np.arange(max(len(word) - self.least + 1, 0))
            if gone is not None and len(first) and gone[i].any():
                inside = np.zeros(len(word) + 1, np.int64)
                a, b = self.first_line[i][gone[i]], self.end_line[i][gone[i]]
                long = b - a >= self.least
                inside[a[long]] += 1
                inside[b[long] - self.least + 1] -= 1
                first = first[np.cumsum(inside)[: len(first)] == 0]
            out.append(first)
        return out

    def anchors(self) -> np.ndarray:
        return np.concatenate([_anchors(w, self.least) for w in self.words] or [np.zeros(0, np.uint64)])

    def run_digests(self, runs: list[np.ndarray], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, first word and both halves of the digest of runs whose anchor is among the sorted shared ones."""
        at, first, high, low = [], [], [], []
        for i, (word, own) in enumerate(zip(self.words, runs, strict=True)):
            if not len(own):
                continue
            anchor = _anchors(word, self.least)[own]
            own = own[_among(shared, anchor)]
            if not len(own):
                continue
            at.append(np.full(len(own), i))
            first.append(own)
            high.append(_between(word, own, own + self.least))
            low.append(_between(mix(word), own, own + self.least, POWERS_TWO))
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return np.concatenate(at), np.concatenate(first), np.concatenate(high), np.concatenate(low)


def _sent(rows: pa.Table, kind: int) -> list[bytes]:
    return [x for k, x in zip(rows.column("kind").to_pylist(), rows.column("blob").to_pylist(), strict=True) if k == kind]


def _names(blobs: list[bytes]) -> np.ndarray:
    return np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in blobs])) if blobs else np.zeros(0, np.uint64)


def _among(taken: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return taken[np.minimum(np.searchsorted(taken, digest), len(taken) - 1)] == digest if len(taken) else np.zeros(len(digest), bool)


def _of_kind(rows: pa.Table, kind: int) -> pa.Table:
    return rows.append_column("kind", pa.array([kind] * rows.num_rows, pa.int32()))


def remove_repeated_passages(docs: DataFrame, least: int = LEAST, least_line: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, text (what is kept), n_units (lines that may go), n_lines_removed, n_removed (characters), spans (start and end offsets)."""
    least_line = least if least_line is None else least_line
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    total = text_bytes(source)
    buckets = total // 40 // BUCKET_DIGESTS + 1
    grouped = blocked(source, total).groupBy("block")

    def name(rows: pa.Table) -> pa.Table:
        r = _Rows(rows, least, least_line)
        block = rows.column("block")[0].as_py()
        return pa.concat_tables([_of_kind(offers(block, *r.line_digests, r.line_owner, buckets), LINES), _of_kind(names(block, np.unique(r.anchors()), buckets), ANCHORS)])

    def settle(rows: pa.Table) -> pa.Table:
        kind = rows.column("kind")[0].as_py()
        return _of_kind((named_elsewhere if kind == ANCHORS else owned_elsewhere)(rows), kind)

    def found(r: _Rows, sent: pa.Table) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
        gone = r.lines_gone(sent_digests(_sent(sent, LINES)))
        return gone, r.run_digests(r.runs(gone), _names(_sent(sent, ANCHORS)))

    def offer(rows: pa.Table, sent: pa.Table) -> pa.Table:
        none = np.zeros(0, np.uint64)
        if not rows.num_rows or not sent.num_rows:
            return _of_kind(offers(0, none, none, np.zeros(0, np.int64), buckets), RUNS)
        r = _Rows(rows, least, least_line)
        _, (at, _, high, low) = found(r, sent)
        return _of_kind(offers(rows.column("block")[0].as_py(), high, low, r.owner[at], buckets), RUNS)

    kinds = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_units", pa.int64()), ("n_lines_removed", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def cut(rows: pa.Table, sent: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return kinds.empty_table()
        r = _Rows(rows, least, least_line)
        gone = r.lines_gone(sent_digests(_sent(sent, LINES)))
        left = r.runs(gone)
        # of this block's runs: those that another block has earlier, and all but the first of equal ones
        at, first, high, low = [], [], [], []
        for i, (word, own) in enumerate(zip(r.words, left, strict=True)):
            if len(own):
                at.append(np.full(len(own), i))
                first.append(own)
                high.append(_between(word, own, own + least))
                low.append(_between(mix(word), own, own + least, POWERS_TWO))
        if at:
            at, first, high, low = (np.concatenate(x) for x in (at, first, high, low))
            later = among(sent_digests(_sent(sent, RUNS)), high, low)
            order, head = digest_groups(high, low, np.arange(len(high)))
            later[order[~head]] = True
            at, first = at[later], first[later]
        else:
            at = first = np.zeros(0, np.int64)
        ends = np.searchsorted(at, np.arange(len(r.ids) + 1))
        out: list[list] = [[] for _ in kinds]
        for i, (id_, text, start) in enumerate(zip(r.ids, r.texts, r.start, strict=True)):
            edge = np.zeros(len(start) + 1, np.int64)
            mine = first[ends[i] : ends[i + 1]]
            np.add.at(edge, mine, 1)
            np.add.at(edge, mine + least, -1)
            edge[r.first_line[i][gone[i]]] += 1
            np.add.at(edge, r.end_line[i][gone[i]], -1)
            spans: list[dict] = []
            kept, removed = text, 0
            if edge.any():
                cover = np.r_[False, np.cumsum(edge[:-1]) > 0, False].astype(np.int8)
                a, b = np.flatnonzero(np.diff(cover) == 1), np.flatnonzero(np.diff(cover) == -1)
                raw = np.frombuffer(text.encode(), np.uint8)
                chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
                begin = np.r_[start, len(raw)]
                lo, hi = chars[begin[a]].tolist(), chars[begin[b]].tolist()
                spans = [{"start": x, "end": y} for x, y in zip(lo, hi, strict=True)]
                kept = "".join(text[x:y] for x, y in zip([0, *hi], [*lo, len(text)], strict=True))
                removed = len(text) - len(kept)
            for column, value in zip(out, (id_, kept, len(gone[i]), int(gone[i].sum()), removed, spans), strict=True):
                column.append(value)
        return pa.table({f.name: pa.array(x, f.type) for f, x in zip(kinds, out, strict=True)})

    sent = "bucket bigint, block bigint, blob binary, kind int"
    back = "block bigint, blob binary, kind int"
    known = grouped.applyInArrow(name, sent).groupBy("kind", "bucket").applyInArrow(settle, back)
    runs = grouped.cogroup(known.groupBy("block")).applyInArrow(offer, sent).groupBy("kind", "bucket").applyInArrow(settle, back)
    done = grouped.cogroup(known.filter(F.col("kind") == LINES).unionByName(runs).groupBy("block")).applyInArrow(cut, "id bigint, text string, n_units bigint, n_lines_removed bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>")
    return done.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_units", "n_lines_removed", "n_removed", "spans")
