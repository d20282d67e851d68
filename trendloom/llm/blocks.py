"""Blocks of documents and hash buckets: the exchange that global digests of small units go through."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text of a block, digests of a bucket, on average; blocks at most. A digest that every block has is offered once by
#: each, so that the number of blocks bounds what one digest brings to its bucket (24 bytes an offer).
BLOCK_BYTES, BUCKET_DIGESTS, MOST_BLOCKS = 4_000_000, 1_000_000, 4_000_000


def text_bytes(source: DataFrame) -> int:
    return source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def block_count(total: int, block_bytes: int | None = None) -> int:
    """Blocks for so many bytes of text: of BLOCK_BYTES, or larger ones where those would be more than MOST_BLOCKS."""
    return min(total // (block_bytes or BLOCK_BYTES) + 1, MOST_BLOCKS)


def blocked(source: DataFrame, total: int) -> DataFrame:
    """Columns id and text with the block that a hash of the id gives: one id is in one block."""
    return source.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(block_count(total))))


def runs_of(key: np.ndarray) -> list[tuple[int, int, int]]:
    """(key, from, to) of the runs of a sorted array."""
    if not len(key):
        return []
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return list(zip(key[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(key)], strict=True))


def digest_groups(high: np.ndarray, low: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of 128-bit digests by digest and owner, and which entries of it begin a digest.

    Only where two digests share their high half alone, the low half is sorted too."""
    order = np.lexsort((owner, high))
    h, low_ = high[order], low[order]
    same = h[1:] == h[:-1]
    if (low_[1:] != low_[:-1])[same].any():
        order = np.lexsort((owner, low, high))
        h, low_ = high[order], low[order]
        same = (h[1:] == h[:-1]) & (low_[1:] == low_[:-1])
    return order, np.r_[True, ~same] if len(h) else np.zeros(0, bool)


def offers(block: int, high: np.ndarray, low: np.ndarray, owner: np.ndarray, buckets: int) -> pa.Table:
    """Rows (bucket, block, blob) with a block's distinct 128-bit digests and the smallest owner of each."""
    order, head = digest_groups(high, low, owner)
    first = order[head]
    high, low, owner = high[first], low[first], owner[first]
    bucket = ((high >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    runs, high, low, owner = runs_of(bucket[by]), high[by], low[by], owner[by]
    return pa.table(
        {
            "bucket": pa.array([r[0] for r in runs], pa.int64()),
            "block": pa.array([block] * len(runs), pa.int64()),
            "blob": pa.array([high[a:b].tobytes() + low[a:b].tobytes() + planes(owner[a:b]) for _, a, b in runs], pa.binary()),
        }
    )


def planes(numbers: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers, all lowest ones first, which packs well."""
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel()


def owned_elsewhere(rows: pa.Table) -> pa.Table:
    """Of a bucket's offers: to each block, those of its digests that another block has with a smaller owner."""
    blobs, blocks_ = rows.column("blob").to_pylist(), rows.column("block").to_pylist()
    sizes = [len(x) // 24 for x in blobs]
    high, low = (np.concatenate([np.frombuffer(x, np.uint64, n, k * n) for x, n in zip(blobs, sizes, strict=True)]) for k in (0, 8))
    owner = np.concatenate([from_planes(np.frombuffer(x, np.uint8, 8 * n, 16 * n)) for x, n in zip(blobs, sizes, strict=True)])
    sender = np.repeat(np.arange(len(sizes)), sizes)
    order, head = digest_groups(high, low, owner)
    late = order[~head]
    late = late[np.argsort(sender[late], kind="stable")]
    runs = runs_of(sender[late])
    return pa.table({"block": pa.array([blocks_[r[0]] for r in runs], pa.int64()), "blob": pa.array([high[late[a:b]].tobytes() + low[late[a:b]].tobytes() for _, a, b in runs], pa.binary())})


def sent_digests(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the digests of blobs from ``owned_elsewhere``, sorted by the first."""
    sizes = [len(x) // 16 for x in blobs]
    if not sizes:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    high, low = (np.concatenate([np.frombuffer(x, np.uint64, n, k * n) for x, n in zip(blobs, sizes, strict=True)]) for k in (0, 8))
    order = np.lexsort((low, high))
    return high[order], low[order]


def among(sent: tuple[np.ndarray, np.ndarray], high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Which digests are among the sorted ones."""
    out = np.zeros(len(high), bool)
    if len(sent[0]):
        at = np.searchsorted(sent[0], high)
        going = np.arange(len(high))
        while len(going):  # one step, unless sorted ones share their first half
            x = at[going]
            same = (x < len(sent[0])) & (sent[0][np.minimum(x, len(sent[0]) - 1)] == high[going])
            going, x = going[same], x[same]
            out[going] |= sent[1][x] == low[going]
            going = going[~out[going]]
            at[going] += 1
    return out


def names(block: int, digest: np.ndarray, buckets: int) -> pa.Table:
    """Rows (bucket, block, blob) with a block's distinct digests alone."""
    bucket = ((digest >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    runs, digest = runs_of(bucket[by]), digest[by]
    return pa.table({"bucket": pa.array([r[0] for r in runs], pa.int64()), "block": pa.array([block] * len(runs), pa.int64()), "blob": pa.array([digest[a:b].tobytes() for _, a, b in runs], pa.binary())})


def named_elsewhere(rows: pa.Table) -> pa.Table:
    """Of a bucket's names: to each block, those of its digests that another block has too."""
    blobs, blocks_ = rows.column("blob").to_pylist(), rows.column("block").to_pylist()
    digest = np.concatenate([np.frombuffer(x, np.uint64) for x in blobs])
    sender = np.repeat(np.arange(len(blobs)), [len(x) // 8 for x in blobs])
    order = np.argsort(digest, kind="stable")
    same = digest[order][1:] == digest[order][:-1]
    both = np.sort(order[np.r_[False, same] | np.r_[same, False]])
    runs = runs_of(sender[both])
    return pa.table({"block": pa.array([blocks_[r[0]] for r in runs], pa.int64()), "blob": pa.array([digest[both[a:b]].tobytes() for _, a, b in runs], pa.binary())})
