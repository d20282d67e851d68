"""Removal of long byte strings that an earlier document has, by suffix arrays over shards of candidate places.

A string of MATCH bytes always holds one of its text's anchors: the places whose hash of GRAM bytes is the smallest
among those that one such string covers. Blocks of documents send the anchor hashes they have to hash buckets, which
name those that several documents share. Around each shared anchor stand all the strings of MATCH bytes that hold
it; blocks send these snippets, equal ones once with their earliest document, to the shard of the anchor. A shard
sorts the suffixes of its snippets (Larsson-Sadakane) in slices of whole anchors, takes common prefixes (Kasai), and so
finds the earliest document of each string; parts of an anchor that fills more than a slice are merged by binary
search. The answers return to the blocks, which cut their texts.

Work is dealt by blocks, buckets and shards of bounded bytes. A string that very many documents share is sent once by
each block, not once by each document. An anchor that stands in many different surroundings would fill its shard; the
buckets see that by the surroundings' codes and call it hot, and the blocks send each string of a hot anchor by its own
128-bit digest, so that its strings spread over all shards.

Defined results: null and empty texts have no bytes; texts shorter than MATCH lose nothing; rows with one id count
as one document, which never cuts itself, with a result for each row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.blocks import block_count, digest_groups, from_planes, planes
from trendloom.llm.hashing import POWERS, POWERS_TWO, mix, windows
from trendloom.llm.suffixes import first_owners

MATCH, GRAM = 50, 25
SPAN = MATCH - GRAM  # bytes of a string on either side of its anchor at most
WIDTH = 2 * SPAN + GRAM
STARTS = WIDTH - MATCH + 1
#: Bytes of text of a block, of which one task holds one at a time; anchors of a bucket and snippets of a shard, on average.
BLOCK_BYTES, BUCKET_ANCHORS, SHARD_BYTES = 4_000_000, 1_000_000, 8_000_000
#: Snippets sorted together.
PER_SORT = 20_000
#: Of 256 codes of surroundings, so many at which an anchor is hot; so many different ones in a block make it so alone.
HOT_CODES, HOT_IN_BLOCK = 128, 64
#: In place of a shard: names of shared anchors; from HOT downward the shards of strings of hot anchors.
NAMES, HOT = -1, -2
NAME = ~np.uint64(3)  # the bits of an anchor's name; the last two are flags


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor of a text: its place, hash, a code of its surroundings, and the first start of the strings that it is the anchor of.

    The anchor of a string of MATCH bytes is the last smallest hash in it, which the string alone decides."""
    h = windows(raw, GRAM)
    n = len(h) - SPAN
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(0, np.int64)
    low = np.uint64((1 << 20) - 1)
    place = np.arange(len(h), dtype=np.uint64)
    value = (h & ~low) | (low - (place & low))  # of equal hashes the last counts as smallest
    for step in (1, 2, 4, 8):
        value = np.minimum(value[:-step], value[step:])
    value = np.minimum(value[:n], value[SPAN + 1 - 16 : SPAN + 1 - 16 + n])
    start = np.arange(n, dtype=np.int64)
    at = start + (((low - (value & low)).astype(np.int64) - start) & int(low))
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    at = at[first]
    before = np.where(at >= GRAM, h[np.maximum(at - GRAM, 0)], 0).astype(np.uint64)
    after = np.where(at + GRAM < len(h), h[np.minimum(at + GRAM, len(h) - 1)], 0).astype(np.uint64)
    return at, h[at], (mix(before * np.uint64(3) + after) >> np.uint64(56)).astype(np.uint8), first


class Block:
    """Rows of a block in a fixed order, with the anchors of all their texts."""

    def __init__(self, rows: pa.Table):
        texts = [(t or "").encode() for t in rows.column("text").to_pylist()]
        ids = rows.column("id").to_pylist()
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.ids = np.array([ids[i] if ids[i] is not None else np.iinfo(np.int64).min for i in self.order], np.int64)
        self.null = [ids[i] is None for i in self.order]
        self.raw = [np.frombuffer(texts[i], np.uint8) for i in self.order]
        found = [anchors(r) for r in self.raw]
        self.row = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        self.place, hashes, self.code, self.first = (np.concatenate([x[i] for x in found] or [np.zeros(0, k)]) for i, k in enumerate((np.int64, np.uint64, np.uint8, np.int64)))
        until = [np.r_[x[3][1:], max(len(r) - MATCH + 1, 0)] for x, r in zip(found, self.raw, strict=True) if len(x[3])]
        self.until = np.concatenate(until) if until else np.zeros(0, np.int64)
        # 46 bits name an anchor: a chance meeting only costs a comparison, as strings decide
        self.hash = (hashes >> np.uint64(16)) & NAME
        self.hot = np.zeros(len(self.hash), bool)

    def keep(self, shared: np.ndarray) -> None:
        """Only anchors whose name is among the sorted shared ones, which carry whether they are hot."""
        if not len(shared):
            use, self.hot = np.zeros(len(self.hash), bool), self.hot
        else:
            at = np.minimum(np.searchsorted(shared & NAME, self.hash), len(shared) - 1)
            use = (shared[at] & NAME) == self.hash
            self.hot = (shared[at] & np.uint64(2)).astype(bool)
        for name in ("row", "place", "hash", "code", "first", "until", "hot"):
            setattr(self, name, getattr(self, name)[use])

    def split(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes the hot anchors out: row, first and last start + 1 of the strings of each."""
        out = self.row[self.hot], self.first[self.hot], self.until[self.hot]
        cold = ~self.hot
        for name in ("row", "place", "hash", "code", "first", "until", "hot"):
            setattr(self, name, getattr(self, name)[cold])
        return out

    def snippets(self, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct snippets by shard: shard, anchor at which each first stands, and of each anchor the snippet's number."""
        if not len(self.row):
            self.bytes = np.zeros((0, WIDTH), np.uint8)
            return (np.zeros(0, np.int64),) * 3
        sizes = np.array([len(r) for r in self.raw], np.int64)
        offset = np.cumsum(sizes + WIDTH) - sizes  # WIDTH zeros before each text
        flat = np.zeros(int(offset[-1] + sizes[-1] + WIDTH), np.uint8)
        for o, r in zip(offset.tolist(), self.raw, strict=True):
            flat[o : o + len(r)] = r + np.uint8(1)
        self.bytes = np.lib.stride_tricks.sliding_window_view(flat, WIDTH)[offset[self.row] + self.place - SPAN]
        code = mix(self.hash ^ row_codes(self.bytes))
        _, first, number = np.unique(code, return_index=True, return_inverse=True)
        shard = ((self.hash[first] >> np.uint64(2)) % np.uint64(shards)).astype(np.int64)
        by_shard = np.lexsort((first, shard))  # in page order, which packs well
        new = np.empty(len(first), np.int64)
        new[by_shard] = np.arange(len(first))
        return shard[by_shard], first[by_shard], new[number]

    def strings(self, hot: tuple[np.ndarray, np.ndarray, np.ndarray], shards: int) -> tuple[np.ndarray, ...]:
        """Of the strings of hot anchors: row and start of each, its number among the distinct ones; of these the shard
        and both halves of the digest, and the string that each first is."""
        rows, starts, high, low = [], [], [], []
        row, first, until = hot
        for r, a, b in _runs(row):
            size = until[a:b] - first[a:b]
            ends = np.cumsum(size)
            at = np.repeat(first[a:b] - (ends - size), size) + np.arange(ends[-1])
            rows.append(np.full(len(at), r))
            starts.append(at)
            high.append(windows(self.raw[r], MATCH)[at])
            low.append(windows(self.raw[r], MATCH, POWERS_TWO)[at])
        if not rows:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        row_, start, hi, lo = (np.concatenate(x) for x in (rows, starts, high, low))
        order, head = digest_groups(hi, lo, np.arange(len(hi)))
        number = np.empty(len(hi), np.int64)
        number[order] = np.cumsum(head) - 1
        of = order[head]
        shard = ((hi[of] >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        new = np.empty(len(of), np.int64)
        new[by] = np.arange(len(of))
        return row_, start, new[number], shard[by], hi[of][by], lo[of][by], of[by]


def row_codes(rows: np.ndarray) -> np.ndarray:
    up, _ = POWERS.of(rows.shape[1])
    out = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        out += rows[:, i].astype(np.uint64) * up[i]
    return out


def packed(codes: np.ndarray) -> bytes:
    """Numbers below 2**48 in six bytes each."""
    return np.ascontiguousarray(codes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def _rows(**columns: pa.Array) -> pa.Table:
    return pa.table(columns)


def _runs(key: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of runs of a sorted array."""
    if not len(key):
        return []
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return list(zip(key[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True))


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the ``spans`` removed (start, end)."""
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks, n_buckets = block_count(total, BLOCK_BYTES), total * 2 // (SPAN + 2) // BUCKET_ANCHORS + 1
    n_shards = total * 2 // SHARD_BYTES + 1
    per_sort, hot_codes, hot_in_block = PER_SORT, HOT_CODES, HOT_IN_BLOCK
    blocks = source.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"), "id", "text")

    def offer(rows: pa.Table) -> pa.Table:
        b = Block(rows)
        order = np.lexsort((b.code, b.hash))
        h, i, c = b.hash[order], b.ids[b.row][order], b.code[order]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
        # an anchor that two documents of the block share is known to be shared
        several = np.maximum.reduceat(i, first) != np.minimum.reduceat(i, first) if len(h) else np.zeros(0, bool)
        fresh = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])] if len(h) else np.zeros(0, bool)
        heavy = (np.add.reduceat(fresh.astype(np.int64), first) > hot_in_block) if len(h) else np.zeros(0, bool)
        value = h[first] | several.astype(np.uint64) | (heavy.astype(np.uint64) << np.uint64(1))
        bucket = ((value >> np.uint64(2)) % np.uint64(n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        runs = _runs(bucket[by])
        blob, codes = packed(value[by]), c[first][by].tobytes()
        block = rows.column("block")[0].as_py()
        return _rows(bucket=pa.array([r[0] for r in runs], pa.int64()), block=pa.array([block] * len(runs), pa.int64()), hashes=pa.array([blob[6 * r[1] : 6 * r[2]] + codes[r[1] : r[2]] for r in runs], pa.binary()))

    def shared(rows: pa.Table) -> pa.Table:
        blobs = rows.column("hashes").to_pylist()
        sizes = [len(x) // 7 for x in blobs]
        value = np.concatenate([unpacked(x[: 6 * n]) for x, n in zip(blobs, sizes, strict=True)])
        code = np.concatenate([np.frombuffer(x, np.uint8, n, 6 * n) for x, n in zip(blobs, sizes, strict=True)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        clean = value & NAME
        order = np.lexsort((code, clean))
        clean, owner, value, code = clean[order], owner[order], value[order], code[order]
        head = np.r_[True, clean[1:] != clean[:-1]]
        first = np.flatnonzero(head)
        size = np.diff(np.r_[first, len(clean)])
        known, heavy = (np.logical_or.reduceat((value & np.uint64(f)).astype(bool), first) for f in (1, 2))
        codes = np.add.reduceat((head | np.r_[True, code[1:] != code[:-1]]).astype(np.int64), first)
        use = np.repeat((size > 1) | known, size)
        named = clean | (np.repeat(heavy | (codes >= hot_codes), size).astype(np.uint64) << np.uint64(1))
        named, owner = named[use], owner[use]
        by = np.argsort(owner, kind="stable")
        runs, blob = _runs(owner[by]), packed(named[by])
        blocks_ = rows.column("block").to_pylist()
        return _rows(block=pa.array([blocks_[r[0]] for r in runs], pa.int64()), shard=pa.array([NAMES] * len(runs), pa.int64()), blob=pa.array([blob[6 * r[1] : 6 * r[2]] for r in runs], pa.binary()))

    def known_anchors(rows: pa.Table, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sent = [unpacked(x) for s, x in zip(rows.column("shard").to_pylist(), rows.column("blob").to_pylist(), strict=True) if s == NAMES]
        b.keep(np.sort(np.concatenate(sent)) if sent else np.zeros(0, np.uint64))
        return b.split()

    def send(rows: pa.Table, names: pa.Table) -> pa.Table:
        out: dict[str, list] = {"shard": [], "block": [], "n": [], "blob": []}

        def put(shard: int, n: int, blob: bytes) -> None:
            for name, value in (("shard", shard), ("block", rows.column("block")[0].as_py()), ("n", n), ("blob", blob)):
                out[name].append(value)

        if rows.num_rows and names.num_rows:
            b = Block(rows)
            hot = known_anchors(names, b)
            shard, first, _ = b.snippets(n_shards)
            for s, x, y in _runs(shard):
                own = first[x:y]
                put(s, y - x, pa.compress(planes(b.ids[b.row[own]]) + b.bytes[own].tobytes(), "zstd", asbytes=True))
            row, _, _, shard, hi, lo, of = b.strings(hot, n_shards)
            for s, x, y in _runs(shard):
                put(HOT - s, y - x, pa.compress(planes(b.ids[row[of[x:y]]]) + hi[x:y].tobytes() + lo[x:y].tobytes(), "zstd", asbytes=True))
        return _rows(shard=pa.array(out["shard"], pa.int64()), block=pa.array(out["block"], pa.int64()), n=pa.array(out["n"], pa.int64()), blob=pa.array(out["blob"], pa.binary()))

    def earlier_strings(sizes: list[int], blobs: list[bytes]) -> list[bytes]:
        raw = [np.frombuffer(pa.decompress(x, 24 * n, "zstd", asbytes=True), np.uint8) for x, n in zip(blobs, sizes, strict=True)]
        owner = np.concatenate([from_planes(x[: 8 * n]) for x, n in zip(raw, sizes, strict=True)])
        hi, lo = (np.concatenate([x[k * n : (k + 8) * n].view(np.uint64) for x, n in zip(raw, sizes, strict=True)]) for k in (8, 16))
        order, head = digest_groups(hi, lo, owner)
        least = np.empty(len(owner), np.int64)
        least[order] = owner[order[head]][np.cumsum(head) - 1]
        flag = (least < owner).astype(np.uint8)
        cut_ = np.cumsum([0, *sizes]).tolist()
        return [flag[x:y].tobytes() for x, y in zip(cut_[:-1], cut_[1:], strict=True)]

    def earlier_starts(sizes: list[int], blobs: list[bytes]) -> list[bytes]:
        total_, at = sum(sizes), 0
        text, owner = np.empty((total_, WIDTH), np.uint8), np.empty(total_, np.int64)
        for x, n in zip(blobs, sizes, strict=True):
            raw = np.frombuffer(pa.decompress(x, n * (8 + WIDTH), "zstd", asbytes=True), np.uint8)
            owner[at : at + n], text[at : at + n] = from_planes(raw[: 8 * n]), raw[8 * n :].reshape(n, WIDTH)
            at += n
        ids, owner = np.unique(owner, return_inverse=True)  # order is all that counts from here on
        owner = owner.astype(np.int32)
        code = row_codes(text)
        order = np.lexsort((owner, code))
        head = np.r_[True, code[order][1:] != code[order][:-1]]
        first = order[head]  # of each distinct snippet the row of its earliest document
        number = np.empty(len(code), np.int32)
        number[order] = np.cumsum(head) - 1
        anchor = row_codes(text[first, SPAN : SPAN + GRAM])
        by = np.argsort(anchor, kind="stable")
        run = np.flatnonzero(np.r_[True, anchor[by][1:] != anchor[by][:-1]])
        size = np.diff(np.r_[run, len(by)])
        # an anchor with one snippet has its answer; the others' suffixes are sorted, in slices of whole anchors
        best = np.repeat(owner[first][:, None], STARTS, 1)
        run, size = run[size > 1], size[size > 1]
        a = 0
        while a < len(run):
            z = max(int(np.searchsorted(np.cumsum(size[a:]), per_sort, "right")), 1) + a
            take = np.concatenate([by[x : x + n] for x, n in zip(run[a:z].tolist(), size[a:z].tolist(), strict=True)])
            best[take] = first_owners(text[first[take]], owner[first[take]], MATCH, per_sort)
            a = z
        bits = np.uint32(1) << np.arange(STARTS, dtype=np.uint32)
        earlier = np.empty(total_, np.uint32)
        for x in range(0, total_, 50_000):
            part = slice(x, x + 50_000)
            earlier[part] = ((best[number[part]] < owner[part, None]) * bits).sum(1)
        cut_ = np.cumsum([0, *sizes]).tolist()
        return [earlier[x:y].tobytes() for x, y in zip(cut_[:-1], cut_[1:], strict=True)]

    def answer(rows: pa.Table) -> pa.Table:
        sizes, blobs = rows.column("n").to_pylist(), rows.column("blob").to_pylist()
        done = (earlier_strings if rows.column("shard")[0].as_py() <= HOT else earlier_starts)(sizes, blobs)
        return _rows(block=rows.column("block"), shard=rows.column("shard"), blob=pa.array(done, pa.binary()))

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows(**{f.name: pa.array([], f.type) for f in result})
        b = Block(rows)
        hot = known_anchors(answers, b)
        shard, first, number = b.snippets(n_shards)
        sent = dict(zip(answers.column("shard").to_pylist(), answers.column("blob").to_pylist(), strict=True))
        mask = np.concatenate([np.frombuffer(sent[s], np.uint32) for s, _, _ in _runs(shard)] or [np.zeros(0, np.uint32)])
        row, start, string, shard, _, _, of = b.strings(hot, n_shards)
        flag = np.concatenate([np.frombuffer(sent[HOT - s], np.uint8) for s, _, _ in _runs(shard)] or [np.zeros(0, np.uint8)]).astype(bool)
        out: list[list] = [[] for _ in range(6)]
        # of one block's rows with a snippet or string, those after its earliest document have all its strings from there
        own = mask[number]
        if len(first):
            own[b.ids[b.row] != b.ids[b.row[first]][number]] = np.uint32((1 << STARTS) - 1)
        gone = flag[string]
        if len(of):
            gone |= b.ids[row] != b.ids[row[of]][string]
        ends = np.searchsorted(b.row, np.arange(len(b.raw) + 1)).tolist()
        hot_ends = np.searchsorted(row, np.arange(len(b.raw) + 1)).tolist()
        for r, raw in enumerate(b.raw):
            n = len(raw)
            starts = np.zeros(n + MATCH + 1, np.int64)
            if ends[r] < ends[r + 1]:
                bit = (own[ends[r] : ends[r + 1], None] >> np.arange(STARTS, dtype=np.uint32)) & np.uint32(1)
                at = (b.place[ends[r] : ends[r + 1], None] - SPAN + np.arange(STARTS))[bit.astype(bool)]
                at = at[(at >= 0) & (at + MATCH <= n)]
                starts[at] = 1
            x, y = hot_ends[r], hot_ends[r + 1]
            starts[start[x:y][gone[x:y]]] = 1
            edges = starts.copy()
            edges[MATCH:] -= starts[:-MATCH]
            covered = np.cumsum(edges)[:n] > 0
            edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
            for column, value in zip(out, (None if b.null[r] else int(b.ids[r]), n, int(covered.sum()), len(edge) // 2, hashlib.sha256(raw[~covered].tobytes()).hexdigest(), edge.astype(np.int64).tolist()), strict=True):
                column.append(value)
        return _rows(**{f.name: pa.array(x, f.type) for f, x in zip(result, out, strict=True)})

    result = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("edges", pa.list_(pa.int64()))])
    grouped = blocks.groupBy("block")
    names = grouped.applyInArrow(offer, "bucket bigint, block bigint, hashes binary").groupBy("bucket").applyInArrow(shared, "block bigint, shard bigint, blob binary")
    snippets = grouped.cogroup(names.groupBy("block")).applyInArrow(send, "shard bigint, block bigint, n bigint, blob binary")
    answers = snippets.groupBy("shard").applyInArrow(answer, "block bigint, shard bigint, blob binary")
    done = grouped.cogroup(names.unionByName(answers).groupBy("block")).applyInArrow(cut, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, edges array<bigint>")
    columns = [F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return done.select(*columns, *([F.col("edges").alias("spans")] if with_text else []))
