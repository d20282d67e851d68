"""Best-fit packing of token documents into fixed-length sequences, with certified bin counts.

Every partition packs its pieces best-fit decreasing; dual-feasible functions give a lower bound of its bins, which
certifies the count where both agree. Nothing can be saved in a certified set. Partitions without a certificate give
the pieces of their bins with gaps into an exchange and are packed again; where every partition has its certificate,
but all together need more bins than the bound of all together, every partition takes part. Packing ends when the
bound of what could be exchanged is met, or when exchanges among all, in ever larger partitions, save no bin. Bins without a gap are never
touched again. Pieces of full length need no packing.

Defined results: a null or empty text is the end id alone; repeated ids stay separate pieces with their own place, null
ids too; an empty table packs into nothing; other columns are ignored; long texts are cut, the first piece being the
short one; of equal lengths the smaller id comes first.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import checkpoint, slices

#: Distinct words whose ids a worker keeps before it starts afresh.
KEPT = 600_000
#: Pieces that one packing task takes on average.
PER_TASK = 200_000
#: How many times as many it takes at most, after exchanges of all partitions that saved nothing.
WIDEST = 8


def _byte_letters() -> dict[str, int]:
    """The printable letter by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return letters


class IdTable:
    """Ids of whole texts, as little-endian bytes, through a bounded table of words.

    Words are taken at single spaces and line ends, before which a byte-level pre-token always ends; a text with
    neighbouring white space or an added token in it is encoded whole."""

    _double = re.compile(r"\s\s")

    def __init__(self, path: str, pattern: str, kept: int = KEPT):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        added = {x["content"] for x in spec.get("added_tokens", ())}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.added = re.compile("|".join(map(re.escape, sorted(added)))) if added else None
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[list(ranks.values())] = list(map(len, ranks))
        self.kept = kept
        self.table: dict[str, bytes] = {}

    def _raw(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, keys: list[str]) -> None:
        """Ids of many words by one call: each starts with white space, so that no token spans two."""
        spelled = ["\n" + k[1:] if k[:1] == "\0" else " " + k for k in keys]
        ids = np.asarray(self.encoding.encode_ordinary("".join(spelled)), "<u4")
        ends = np.cumsum([len(s.encode()) for s in spelled])
        cut = np.searchsorted(np.cumsum(self.size[ids]), ends, "left") + 1
        raw, start = ids.tobytes(), 0
        for k, end in zip(keys, (cut * 4).tolist(), strict=True):
            self.table[k] = raw[start:end]
            start = end

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        for a, b in slices(texts):
            split: list[list[str] | bytes] = []
            fresh: set[str] = set()
            for t in texts[a:b]:
                if not t:
                    split.append(b"")
                elif self.added is not None and self.added.search(t):
                    split.append(np.asarray(self.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                elif "\0" in t or self._double.search(t):
                    split.append(self._raw(t))
                else:
                    keys = t.replace("\n", " \0").split(" ")
                    split.append(keys)
                    fresh.update(keys[1:])
            if len(self.table) + len(fresh) > self.kept:
                self.table = {}
            known = self.table
            if todo := [k for k in fresh if k not in known and k not in ("", "\0")]:
                self._learn(todo)
            known[""], known["\0"] = self._raw(" "), self._raw("\n")
            get = known.__getitem__
            for x in split:
                if isinstance(x, bytes):
                    yield x
                else:
                    first = x[0]
                    yield (self._raw("\n" + first[1:] if first[:1] == "\0" else first) if first else b"") + b"".join(map(get, x[1:]))


@lru_cache(maxsize=2)
def id_table(path: str, pattern: str) -> IdTable:
    return IdTable(path, pattern)


def token_pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece of at most ``capacity`` ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = id_table(tokenizer, pattern)
        for batch in batches:
            rows: list[list[int]] = [[] for _ in range(5)]
            for i, raw in enumerate(t.ids(batch.column(1).to_pylist())):
                raw += b"\0\0\0\0"
                n, start, piece = len(raw) // 4, 0, 0
                while start < n:
                    length = (n % capacity if piece == 0 else 0) or capacity
                    for column, value in zip(rows, (i, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])), strict=True):
                        column.append(value)
                    start, piece = start + length, piece + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of the bin count among three families of dual-feasible functions."""
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(count: np.ndarray, capacity: int) -> int:
    """``lower_bound`` of so many pieces of each length."""
    count = count.astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    total = int(count @ x)
    best = -(-total // capacity)
    n_from, sum_from = np.cumsum(count[::-1])[::-1], np.cumsum((count * x)[::-1])[::-1]
    low = np.arange(1, capacity // 2 + 1)
    # pieces over capacity - t count whole, those under t not at all
    big = n_from[np.minimum(capacity - low + 1, capacity)]
    middle = sum_from[low] - sum_from[capacity - low + 1]
    best = max(best, int((big - (-middle // capacity)).max(initial=0)))
    for k in range(1, 33):  # rounding to k-ths
        scaled = x * (k + 1)
        value = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)
        best = max(best, -(-int(count @ value) // (capacity * k)))
    for t in range(1, capacity // 2 + 1, max(1, capacity // 128)):  # how many pieces of at least t share a bin
        per = capacity // t
        value = np.where(2 * x > capacity, 2 * (per - (capacity - x) // t), np.where(2 * x == capacity, per, 2 * (x // t)))
        value[x < t] = 0
        best = max(best, -(-int(count @ value) // (2 * per)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length (given in falling order), and what stays free in each bin."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins, free = 0, [], []  # open_: bit f is set while some bin has f places free
    offset = []
    for size in lengths.tolist():
        fits = open_ >> size
        if fits:
            f = size + (fits & -fits).bit_length() - 1
            b = by_free[f].pop()
            if not by_free[f]:
                open_ ^= 1 << f
        else:
            f, b = capacity, len(free)
            free.append(capacity)
        bins.append(b)
        offset.append(capacity - f)
        free[b] = left = f - size
        if left:
            by_free[left].append(b)
            open_ |= 1 << left
    return np.asarray(bins, np.int64), np.asarray(offset, np.int64), np.asarray(free, np.int64)


def _pack(pieces: DataFrame, tasks: int, round_: int, capacity: int, id_col: str) -> DataFrame:
    """Pieces with their places, the gap of their sequence, and bins, bound and certificate of their partition."""
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    dealt = pieces.select(*names, F.pmod(F.xxhash64(F.col(id_col), "piece", "start", F.lit(round_)), F.lit(tasks)).alias("task"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*names).schema)

    def pack(rows: pa.Table) -> pa.Table:
        task = rows.column("task")[0].as_py()
        rows = rows.select(names).sort_by([("length", "descending"), (id_col, "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows.column("length").to_numpy()
        bins, offset, free = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        n = rows.num_rows
        more = {"sequence_id": (round_ << 56) + (task << 32) + bins, "offset": offset, "gap": free[bins], "bins": np.full(n, len(free)), "bound": np.full(n, bound)}
        for name, values in more.items():
            rows = rows.append_column(name, pa.array(values, pa.int64()))
        return rows.append_column("certified", pa.array(np.full(n, len(free) == bound)))

    return dealt.groupBy("task").applyInArrow(pack, f"{kinds}, sequence_id bigint, offset bigint, gap bigint, bins bigint, bound bigint, certified boolean")


def _state(packed: DataFrame, capacity: int) -> tuple[int, int, int]:
    """Pieces, bins and the lower bound of the bins of a packing: a row for each length at most comes to the driver."""
    count = np.zeros(capacity + 1, np.int64)
    for row in packed.groupBy("length").agg(F.count("*").alias("n")).collect():
        count[row["length"]] = row["n"]
    bins = packed.filter("offset = 0").count()  # every sequence has one piece there
    return int(count.sum()), bins, bound_of_counts(count, capacity)


def pack_documents(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = 2048, per_task: int = PER_TASK, id_col: str = "doc_id", text_col: str = "text", log: list[dict] | None = None) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset, certified. ``pattern`` is the tokenizer's pre-token pattern.

    ``certified``: the bin count of the piece's partition, of its exchange, or of all was proved least. ``log`` gets an
    entry for each step: who took part, pieces, bins and bound before, bins after."""
    pieces = checkpoint(token_pieces(docs, tokenizer, pattern, capacity, id_col, text_col))
    return pack_pieces(pieces, capacity, per_task, id_col, log)


def pack_pieces(pieces: DataFrame, capacity: int = 2048, per_task: int = PER_TASK, id_col: str = "doc_id", log: list[dict] | None = None) -> DataFrame:
    """``pack_documents`` of pieces: id, piece, start, length (1 to capacity), ids_crc32."""
    log = [] if log is None else log
    names = [*pieces.columns, "sequence_id", "offset", "certified"]
    full = pieces.filter(F.col("length") == capacity).select(*pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(True).alias("certified"))
    rest = pieces.filter(F.col("length") < capacity)
    packed = checkpoint(_pack(rest, -(-rest.count() // per_task) or 1, 0, capacity, id_col))
    done, round_, everyone, wide = [full], 0, False, 1
    while True:
        n, bins, bound = _state(packed, capacity)
        log.append({"step": "all", "round": round_, "pieces": n, "bins": bins, "bound": bound, "certified": packed.filter("not certified").limit(1).count() == 0})
        if bins == bound:  # proved: no other packing of these has fewer
            packed = packed.withColumn("certified", F.lit(True))
            break
        open_ = packed.filter("not certified")
        everyone = everyone or not open_.limit(1).count()
        taking = packed if everyone else open_
        loose = taking.filter("gap > 0")
        n, bins, bound = _state(loose, capacity)
        entry = {"step": "exchange", "round": round_, "everyone": everyone, "pieces": n, "bins": bins, "bound": bound, "after": bins}
        if bins > bound:
            round_ += 1
            tasks = -(-n // (per_task * wide))
            again = checkpoint(_pack(loose, tasks, round_, capacity, id_col))
            entry["after"] = again.filter("offset = 0").count()
            log.append(entry)
            if entry["after"] < bins:
                # bins without a gap stay for good
                done.append(taking.filter("gap = 0").select(*names).withColumn("certified", F.lit(True)))
                packed = again if everyone else packed.filter("certified").unionByName(again)
                everyone, wide = False, 1
                continue
            if everyone and tasks > 1 and wide < WIDEST:  # larger partitions leave fewer gaps
                wide *= 2
                continue
        else:
            log.append(entry)
        if everyone:
            break
        everyone = True
    out = packed.select(*names)
    for x in done:
        out = out.unionByName(x)
    return out
