"""Hard negatives of anchors by distributed radix selection over integer scores.

Vectors become integers; a score is the exact inner product of a row with an anchor. Rows lie in tiles, anchors in blocks,
and every tile meets every block once a pass (the anchors are the stated query set). An anchor's positives and the negatives
of each anchor and positive are each a selection of the first k rows of a window of scores, found alike:

* a pass counts, for each window and tile, the rows by the next digit of their place (score from the top down, then id
  upwards); a tile reports its buckets only as far as they can hold the k-th row;
* the counts are added for each window and digit, and the bucket that holds the k-th row becomes the window's range, until a
  range holds few rows or a single place;
* a last pass gathers the rows up to the end of that bucket only, of each tile at most k, and ranks them.

So no window's rows meet anywhere but the few that qualify, however many share a score or an anchor, and a pass shuffles counts.
Anchor blocks are broadcast where their counted size is small, else both sides are dealt out by block and tile.

Scores are products in float64 where the counted bounds keep them below 2**53, in 64-bit integers below 2**63; beyond, an error.

Defined results: rows with a null id, label or vector, or with null or non-finite entries, take no part; a shorter vector counts as
ending in zeros; "other" rows have another id than the anchor; repeated ids are rows of their own, each anchor row with its own
result, and rows that agree in score and id are ordered by label; a positive score below zero has an empty window; extra
columns are ignored; an empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendloom.llm.common import checkpoint
from trendloom.llm.vectors import complete, dense, scaled, widest

SCALE, POSITIVES, NEGATIVES = 256, 5, 3
#: Shares of the positive's score between which a negative's lies, in hundredths.
LOW, HIGH = 50, 95
#: Bits of a digit; rows of a last bucket at most unless it is a single place.
BITS, FEW = 12, 64
#: Rows of a tile, anchors of a block, scores held at once.
TILE, BLOCK, SLICE = 8192, 1024, 4_000_000
#: Bytes of anchor blocks that are broadcast at most.
BROADCAST_BYTES = 64_000_000
WINDOW = ["p", "same", "lo", "hi", "id_lo", "id_hi", "top", "above"]


def quantised(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> tuple[DataFrame, int]:
    """(id, label, v) of the rows that take part, v being 64-bit integers in bytes; and the number of components."""
    good = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & complete(F.col("v")))
    dims = widest(good, "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = scaled(dense(b.column("v"), dims), scale)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "label": b.column("label"), "v": pa.array([r.tobytes() for r in x], pa.binary())})

    return good.mapInArrow(pack, "id long, label long, v binary"), dims


def tiles(rows: DataFrame) -> DataFrame:
    """Rows of a partition in tiles of at most TILE: ids, labels and vectors as bytes, the largest magnitude of a component."""

    def blob(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids, labels = t["id"].to_numpy(), t["label"].to_numpy()
        vectors = b"".join(t["v"].to_pylist())
        values = np.frombuffer(vectors, np.int64)
        top = int(np.abs(values).max()) if len(values) else 0
        small = values.astype(np.int32).tobytes() if top < 2**31 else vectors
        return pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "labels": [labels.tobytes()], "vectors": [small], "top_value": [top]})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, TILE - n)
                held, n, at = [*held, part], n + part.num_rows, at + part.num_rows
                if n == TILE:
                    yield blob(held)
                    held, n = [], 0
        if n:
            yield blob(held)

    return rows.mapInArrow(cut, "ids binary, labels binary, vectors binary, top_value long")


def _matrix(vectors: bytes, n: int, top: int) -> np.ndarray:
    values = np.frombuffer(vectors, np.int32 if top < 2**31 else np.int64)
    return values.reshape(n, len(values) // max(n, 1))


def products(a: np.ndarray, b: np.ndarray, top_a: int, top_b: int) -> np.ndarray:
    """a @ b.T as exact 64-bit integers."""
    bound = a.shape[1] * top_a * top_b
    if bound < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ArithmeticError("scores of more than 63 bits")


def _block(group: pd.DataFrame) -> pd.DataFrame:
    """One row with the vectors and open windows of a block of anchors (a row for each window)."""
    group = group.sort_values(["a", "p"])
    first = ~group["a"].duplicated()
    anchors = group[first]
    values = np.frombuffer(b"".join(anchors["v"]), np.int64)
    place = first.cumsum().to_numpy(dtype=np.int64) - 1
    out = {"b": group["b"].iloc[0], "a": anchors["a"].to_numpy(np.int64).tobytes(), "a_ids": anchors["id"].to_numpy(np.int64).tobytes(), "a_labels": anchors["label"].to_numpy(np.int64).tobytes(), "a_vectors": values.tobytes(), "a_top": int(np.abs(values).max()) if len(values) else 0, "at": place.tobytes()}
    return pd.DataFrame([out | {c: group[c].to_numpy(np.int64).tobytes() for c in WINDOW}])


BLOCK_SCHEMA = "b long, a binary, a_ids binary, a_labels binary, a_vectors binary, a_top long, at binary, " + ", ".join(f"{c} binary" for c in WINDOW)


def _each_window(pdf: pd.DataFrame) -> Iterator[tuple]:
    """(anchor number, window values, scores, ids, rows, labels) of every window of the joined tiles and blocks."""
    for r in pdf.itertuples():
        ids, labels = np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64)
        rows = _matrix(r.vectors, len(ids), r.top_value)
        a, a_ids, a_labels = (np.frombuffer(x, np.int64) for x in (r.a, r.a_ids, r.a_labels))
        anchors = _matrix(r.a_vectors, len(a), 2**62)
        at = np.frombuffer(r.at, np.int64)
        windows = np.stack([np.frombuffer(getattr(r, c), np.int64) for c in WINDOW], axis=1).tolist()
        first = np.searchsorted(at, np.arange(len(a) + 1)).tolist()
        step = max(1, SLICE // max(len(ids), 1))
        for low in range(0, len(a), step):
            scores = products(anchors[low : low + step], rows, r.a_top, r.top_value)
            for i in range(low, min(low + step, len(a))):
                kept = None
                for w in windows[first[i] : first[i + 1]]:
                    if kept is None:  # windows of one anchor are of one kind
                        take = np.flatnonzero((labels == a_labels[i]) & (ids != a_ids[i]) if w[1] else labels != a_labels[i])
                        kept = scores[i - low][take], ids[take], labels[take]
                    yield int(a[i]), w, *kept


def _digit(values: np.ndarray, start: int, end: int) -> tuple[np.ndarray, int]:
    """Digits of distances from start, which end has at most; and the bits below a digit."""
    shift = max(0, (end - start).bit_length() - BITS)
    return ((values.astype(np.uint64) - np.uint64(start % 2**64)) >> np.uint64(shift)).astype(np.int64), shift


def _counts(k: int) -> Callable:
    """(a, p, digit, n): rows by the next digit of each open window, as far as the k-th row can lie."""

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
            for a, (p, _, lo, hi, id_lo, id_hi, _, above), scores, ids, _ in _each_window(pdf):
                inside = (scores >= lo) & (scores <= hi)
                if lo < hi:
                    digit, _ = _digit(-scores[inside], -hi, -lo)
                else:
                    digit, _ = _digit(ids[inside & (ids >= id_lo) & (ids <= id_hi)], id_lo, id_hi)
                if len(digit):
                    n = np.bincount(digit)
                    d = np.flatnonzero(n)
                    d = d[: np.searchsorted(np.cumsum(n[d]), k - above) + 1]
                    out.append((a, p, d, n[d]))
            sizes = [len(x[2]) for x in out]
            yield pd.DataFrame({"a": np.repeat([x[0] for x in out], sizes).astype(np.int64), "p": np.repeat([x[1] for x in out], sizes).astype(np.int64), "digit": np.concatenate([x[2] for x in out]) if out else np.zeros(0, np.int64), "n": np.concatenate([x[3] for x in out]) if out else np.zeros(0, np.int64)})

    return count


def _gathered(k: int) -> Callable:
    """(a, p, id, label, score) of the rows from the top of each window to the end of its last bucket, at most k of a tile."""

    def gather(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            out = []
            for a, (p, _, lo, hi, id_lo, id_hi, top, _), scores, ids, labels in _each_window(pdf):
                inside = (scores >= lo) & (scores <= top)
                if lo == hi:
                    inside &= (scores > lo) | ((ids >= id_lo) & (ids <= id_hi)) | (ids < id_lo)
                at = np.flatnonzero(inside)
                at = at[np.lexsort((labels[at], ids[at], -scores[at]))[:k]]
                if len(at):
                    out.append(pd.DataFrame({"a": a, "p": p, "id": ids[at], "label": labels[at], "score": scores[at]}))
            yield pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "p", "id", "label", "score")})

    return gather


def _met(tiled: DataFrame, anchors: DataFrame, windows: DataFrame, n_blocks: int) -> DataFrame:
    """Every tile beside every block of anchors with open windows."""
    open_ = anchors.join(windows, "a").withColumn("b", F.pmod(F.xxhash64("a"), F.lit(n_blocks)))
    blocks = checkpoint(open_.groupBy("b").applyInPandas(_block, BLOCK_SCHEMA))
    size = blocks.agg(F.sum(sum((F.octet_length(c) for c, kind in blocks.dtypes if kind == "binary"), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return tiled.join(F.broadcast(blocks.withColumn("_one", F.lit(1))), F.col("_one") == 1) if n_blocks == 1 else tiled.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1)))).join(F.broadcast(blocks), "b")
    salts = max(1, tiled.count() // 4)
    left = tiled.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1)))).withColumn("_salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))
    right = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1))))
    return left.join(right, ["b", "_salt"]).drop("_salt")


def _narrowed(windows: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """Windows with the bucket of their k-th row as the range, and whether that is the last one (``done``)."""
    total = counts.groupBy("a", "p", "digit").agg(F.sum("n").alias("n"))
    upto = total.join(windows.select("a", "p", "above"), ["a", "p"]).withColumn("upto", F.col("above") + F.sum("n").over(Window.partitionBy("a", "p").orderBy("digit")))
    bucket = upto.filter((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k)).select("a", "p", "digit", F.col("n").alias("held"), "upto")
    by_score = F.col("lo") < F.col("hi")

    def bits(span: Column) -> Column:
        return F.greatest(F.lit(0), F.length(F.regexp_replace(F.bin(span), "^0+", "")) - BITS).cast("int")

    size = F.call_function("shiftleft", F.lit(1).cast("long"), bits(F.when(by_score, F.col("hi") - F.col("lo")).otherwise(F.col("id_hi") - F.col("id_lo"))))
    start = F.when(by_score, F.col("hi") - F.col("digit") * size).otherwise(F.col("id_lo") + F.col("digit") * size)
    joined = windows.join(bucket, ["a", "p"], "left").withColumns({"_start": start, "_size": size})
    found = F.col("digit").isNotNull()
    hi = F.when(found & by_score, F.col("_start")).otherwise(F.col("hi"))
    lo = F.when(found & by_score, F.greatest("lo", F.col("_start") - F.col("_size") + 1)).otherwise(F.col("lo"))
    id_lo = F.when(found & ~by_score, F.col("_start")).otherwise(F.col("id_lo"))
    id_hi = F.when(found & ~by_score, F.least("id_hi", F.col("_start") + F.col("_size") - 1)).otherwise(F.col("id_hi"))
    new = joined.select("a", "p", "same", lo.alias("lo"), hi.alias("hi"), id_lo.alias("id_lo"), id_hi.alias("id_hi"), "top", F.when(found, F.col("upto") - F.col("held")).otherwise(F.col("above")).alias("above"), "held", "upto")
    single = (F.col("lo") == F.col("hi")) & (F.col("id_lo") == F.col("id_hi"))
    # without a k-th row the whole range is taken
    return new.withColumn("done", F.col("held").isNull() | (F.col("upto") <= F.lit(FEW)) | single).drop("held", "upto")


def select_first(tiled: DataFrame, anchors: DataFrame, windows: DataFrame, n_blocks: int, k: int) -> DataFrame:
    """(a, p, id, label, score, rank): the first k rows of each window (a, p, same, lo, hi, id_lo, id_hi)."""
    open_ = checkpoint(windows.filter("lo <= hi").withColumns({"top": F.col("hi"), "above": F.lit(0).cast("long")}).select("a", *WINDOW))
    closed: DataFrame | None = None
    while open_.limit(1).count():  # a pass for each digit that some window needs: six of scores and six of ids at most
        counts = _met(tiled, anchors, open_, n_blocks).mapInPandas(_counts(k), "a long, p long, digit long, n long")
        narrowed = checkpoint(_narrowed(open_, counts, k))
        done = narrowed.filter("done").drop("done")
        closed = done if closed is None else closed.unionByName(done)
        open_ = narrowed.filter("not done").drop("done")
    if closed is None:
        return tiled.sparkSession.createDataFrame([], "a long, p long, id long, label long, score long, rank int")
    found = _met(tiled, anchors, checkpoint(closed), n_blocks).mapInPandas(_gathered(k), "a long, p long, id long, label long, score long")
    order = Window.partitionBy("a", "p").orderBy(F.desc("score"), "id", "label")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_hard_negatives(
    rows: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchor`` is a condition on the column ``id``."""
    packed, dims = quantised(rows, id_col, label_col, vector_col, scale)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    anchors = checkpoint(packed.filter(anchor).withColumn("a", F.monotonically_increasing_id()))
    n = anchors.count()
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    tiled = checkpoint(tiles(packed))
    n_blocks = -(-n // BLOCK)
    # no score lies beyond the product of the largest magnitudes; ids are refined within those that occur
    top = tiled.agg(F.max("top_value")).first()[0]
    reach = min(max(dims, 1) * top * top, 2**62)
    id_lo, id_hi = packed.agg(F.min("id"), F.max("id")).first()
    ends = {"id_lo": F.lit(id_lo).cast("long"), "id_hi": F.lit(id_hi).cast("long")}
    wide = anchors.select("a", F.lit(0).cast("long").alias("p"), F.lit(1).cast("long").alias("same"), F.lit(-reach).cast("long").alias("lo"), F.lit(reach).cast("long").alias("hi")).withColumns(ends)
    near = checkpoint(select_first(tiled, anchors, wide, n_blocks, positives).select("a", F.col("rank").cast("long").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    score = F.col("positive_score").cast("decimal(38,0)")
    # low * positive <= 100 * negative <= high * positive, as whole numbers
    least, most = F.ceil(score * low / 100).cast("long"), F.floor(score * high / 100).cast("long")
    windows = near.select("a", "p", F.lit(0).cast("long").alias("same"), least.alias("lo"), most.alias("hi")).withColumns(ends)
    chosen = select_first(tiled, anchors, windows, n_blocks, negatives)
    out = chosen.join(near, ["a", "p"]).join(anchors.select("a", F.col("id").alias("anchor_id")), "a")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
