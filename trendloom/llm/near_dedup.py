"""Near duplicates by a MinHash LSH forest.

Every distinct shingle set has one sketch of min-hashes. Each tree of the forest sorts all sketches by its own order
of their places; rows that follow each other share the longest prefixes. A run is the rows that share the first DEPTH
places of a tree; of two sets with similarity 0.8 all but one pair in six hundred share a run in some tree. Rows whose
sketches agree well enough are candidates, and only candidates confirmed on the full shingle sets are links.

The first pass compares all rows of a run of up to SMALL rows, and in longer ones the neighbours. The best candidates of
each row are confirmed first, then whatever still lies between different components, so that a large group costs links in
proportion to its rows. The second pass takes the rows of longer runs again, now with their components. A run of one
component needs nothing more; the rows get LONG places more, as sketches tell less apart the more rows are alike. In other runs, each row outside the largest component is compared with the whole
run; where that is more than COMPARISONS, the run is too crowded, and its parts that agree in one more place are taken
instead: the depth adapts to the region. ``comparisons=None`` never goes deeper. Candidates are confirmed best first, in rounds of
growing size, until none is left between two components.

Partitions of a tree follow the order of its rows. The rows at their edges meet once more among themselves, so that the result
does not hang on where the edges lie.

Defined results: rows without words (null, empty, white space) have no shingles and no links; equal sets are one
class from the start, however many rows they have; repeated ids keep a row each and count as one node, confirmed by
the smallest of their texts; an empty table gives no rows; other columns are ignored; texts are hashed and confirmed whole.
Rows without an id take part like others, those of one text as one node; a component of such rows only has no ``component_id``, and
its ``kept`` rows are those of one node. Where a component has ids, its rows without one are not kept. Ids lie below 2**62.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from trendloom.llm.common import checkpoint
from trendloom.llm.components import connected_components
from trendloom.llm.hashing import mix, shingle_hashes

#: Min-hashes of a sketch, one byte each; trees of the forest; min-hashes more for rows in crowded regions.
PLACES, TREES, LONG = 96, 16, 480
#: Places of a run; rows of a run that are all compared in the first pass; neighbours compared in longer ones.
DEPTH, SMALL, NEAR = 5, 32, 3
#: Comparisons that a run of several components may take in the second pass.
COMPARISONS = 4_000_000
#: By how many standard deviations a candidate's sketch may fall short of the similarity sought, in the two passes; best
#: candidates that each row offers in the first round of the second.
SLACK, BEST = (4.0, 3.5), 8
#: Rows of a forest that a task takes on average; rows at each edge of a partition that meet their neighbours later.
PER_TASK, EDGE = 250_000, 32
PAIR, AT_EDGE, CROWDED = 0, 1, 2  # kinds of rows that a first pass yields
#: From here on lie the numbers that rows without an id have inside.
NAMELESS = 2**62

_multiply = mix(np.arange(1, PLACES + LONG + 1, dtype=np.uint64)) | np.uint64(1)
_add = mix(np.arange(10_001, 10_001 + PLACES + LONG, dtype=np.uint64))


def sketch(hashes: np.ndarray, first: int = 0, until: int = PLACES) -> bytes:
    """One byte of each min-hash of a nonempty set."""
    low = np.full(until - first, np.iinfo(np.uint64).max)
    step = max(200_000 // (until - first), 1)
    for i in range(0, len(hashes), step):
        np.minimum(low, (hashes[i : i + step, None] * _multiply[first:until] + _add[first:until]).min(0), out=low)
    return (mix(low) & np.uint64(255)).astype(np.uint8).tobytes()


def tree_order(tree: int) -> np.ndarray:
    """The places in the order of a tree: a head of its own, then the rest from there on."""
    return np.roll(np.arange(PLACES), -tree * (PLACES // TREES))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """id, n_shingles, digest of the set, sketch (both null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, sketched = [], [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), k)
                n.append(len(h))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).digest() if len(h) else None)
                sketched.append(sketch(h) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketched, pa.binary())], names=["id", "n_shingles", "digest", "sketch"])

    return docs.mapInArrow(run, "id bigint, n_shingles bigint, digest binary, sketch binary")


def least_agreement(similarity: float, slack: float, places: int = PLACES) -> int:
    return int(np.floor(places * similarity - slack * np.sqrt(places * similarity * (1 - similarity))))


def long_sketches(texts: DataFrame, k: int) -> DataFrame:
    """id and ``more``: the LONG further places of the sketch of each text (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sketch(shingle_hashes(t.as_py(), k), PLACES, PLACES + LONG) for t in batch.column(1)], pa.binary())], names=["id", "more"])

    return texts.select("id", "text").mapInArrow(run, "id bigint, more binary")


def forest(reps: DataFrame, rows: int) -> DataFrame:
    """label (tree, its order of the places, what the sketch has beyond), id and component of every row (id, sketch, component) and tree, in order."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [tree_order(t) for t in range(TREES)]
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            for t, order in enumerate(orders):
                label = np.concatenate([np.full((len(places), 1), t, np.uint8), places[:, order], places[:, PLACES:]], 1)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in label], pa.binary()), batch.column(0), batch.column(2)], names=["label", "id", "component"])

    planted = reps.select("id", "sketch", "component").mapInArrow(plant, "label binary, id bigint, component bigint")
    n = max(rows * TREES // PER_TASK + 1, TREES, reps.sparkSession.sparkContext.defaultParallelism)
    return planted.repartitionByRange(n, "label", "id").sortWithinPartitions("label", "id")


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """labels, ids and components of sorted rows, in chunks that end with a run."""
    ids = component = np.zeros(0, np.int64)
    labels = None
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        labels = fresh if labels is None else np.concatenate([labels, fresh])
        ids, component = np.r_[ids, batch.column(1).to_numpy()], np.r_[component, batch.column(2).to_numpy()]
        other = np.flatnonzero((labels[:, : DEPTH + 1] != labels[-1, : DEPTH + 1]).any(1))
        end = int(other[-1]) + 1 if len(other) else 0
        if end:
            yield labels[:end], ids[:end], component[:end]
            labels, ids, component = labels[end:], ids[end:], component[end:]
    if len(ids):
        yield labels, ids, component


def run_sizes(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and sizes of the runs of sorted labels."""
    first = np.flatnonzero(np.r_[True, (labels[1:, : DEPTH + 1] != labels[:-1, : DEPTH + 1]).any(1)])
    return first, np.diff(np.r_[first, len(labels)])


def near_rows(ordered: DataFrame, least: int, at_edges: bool) -> DataFrame:
    """First pass over a forest: kind, a, b, agree, label of candidates, of rows at edges, and of rows in long runs."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, a: np.ndarray, b: np.ndarray, agree: np.ndarray, label: list[bytes] | None = None) -> pa.RecordBatch:
            texts = pa.array([None] * len(a) if label is None else label, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(agree.astype(np.int32)), texts], names=["kind", "a", "b", "agree", "label"])

        before: tuple[np.ndarray, np.ndarray] | None = None
        tail: list[tuple[np.ndarray, np.ndarray]] = []
        head = EDGE if at_edges else 0  # rows at the beginning that are still to be told
        for labels, ids, _ in whole_runs(batches):
            first, size = run_sizes(labels)
            run = np.repeat(size, size)
            last = np.repeat(first + size, size)
            found = []
            for step in range(1, min(SMALL, len(ids))):
                i = np.arange(len(ids) - step)
                if step <= NEAR:  # neighbours share the tree and its first place at least
                    i = i[(labels[i, :2] == labels[i + step, :2]).all(1)]
                else:
                    i = i[(run[i] <= SMALL) & (i + step < last[i])]
                agree = (labels[i, 1:] == labels[i + step, 1:]).sum(1)
                i, agree = i[agree >= least], agree[agree >= least]
                found.append((ids[i], ids[i + step], agree))
            if before is not None:  # neighbours across chunks
                for back in range(1, min(NEAR, len(before[1])) + 1):
                    k = min(NEAR + 1 - back, len(ids))
                    x, y = np.full(k, len(before[1]) - back), np.arange(k)
                    ok = (before[0][x, :2] == labels[y, :2]).all(1)
                    agree = (before[0][x, 1:] == labels[y, 1:]).sum(1)
                    ok &= agree >= least
                    found.append((before[1][x[ok]], ids[y[ok]], agree[ok]))
            x, y, agree = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
            ok = x != y
            if ok.any():
                yield out(PAIR, np.minimum(x, y)[ok], np.maximum(x, y)[ok], agree[ok])
            crowd = np.unique(ids[run > SMALL])
            if len(crowd):
                yield out(CROWDED, crowd, crowd, np.zeros(len(crowd)))
            if head:
                yield out(AT_EDGE, ids[:head], ids[:head], np.zeros(len(ids[:head])), [x.tobytes() for x in labels[:head]])
                head -= len(ids[:head])
            if at_edges:
                tail = [*tail, (labels[-EDGE:], ids[-EDGE:])][-EDGE:]
            before = labels[-NEAR:], ids[-NEAR:]
        if tail:
            labels, ids = np.concatenate([t[0] for t in tail])[-EDGE:], np.concatenate([t[1] for t in tail])[-EDGE:]
            yield out(AT_EDGE, ids, ids, np.zeros(len(ids)), [x.tobytes() for x in labels])

    return ordered.mapInArrow(look, "kind int, a bigint, b bigint, agree int, label binary")


def crowded_candidates(labels: np.ndarray, component: np.ndarray, least: tuple[int, int], comparisons: int | None, depth: int = DEPTH) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, other row, agreement) of rows of different components of one run: every row outside the largest component
    with all others, or, where that is too much, the same within the parts that agree in one more place.

    ``least``: how many of the places, and of all with the longer sketch, must agree."""
    todo = [(np.arange(len(component)), depth)]
    while todo:
        rows, depth = todo.pop()
        names, number, size = np.unique(component[rows], return_inverse=True, return_counts=True)
        if len(names) < 2:
            continue
        few = rows[number != size.argmax()]
        if comparisons is not None and len(few) * len(rows) > comparisons and depth < PLACES:
            cut = np.flatnonzero(labels[rows[1:], depth + 1] != labels[rows[:-1], depth + 1]) + 1
            todo += [(part, depth + 1) for part in np.split(rows, cut) if len(part) > 1]
            continue
        width = max(1_000_000 // len(rows), 1)
        for at in range(0, len(few), width):
            own = few[at : at + width]
            agree = np.zeros((len(own), len(rows)), np.int16)
            for place in range(1, PLACES + 1):
                agree += labels[own, place][:, None] == labels[rows, place]
            x, y = np.nonzero((agree >= least[0]) & (component[own][:, None] != component[rows]))
            x, y, agree = own[x], rows[y], agree[x, y]
            for part in range(0, len(x), 20_000):
                p, q = x[part : part + 20_000], y[part : part + 20_000]
                agree[part : part + 20_000] += (labels[p, PLACES + 1 :] == labels[q, PLACES + 1 :]).sum(1).astype(np.int16)
            near = agree >= least[1]
            if near.any():
                yield x[near], y[near], agree[near]


def between_components(ordered: DataFrame, least: tuple[int, int], comparisons: int | None, lo: int, hi: int) -> DataFrame:
    """Second pass over a forest: (a, b, agree) of the candidates between components that are a row's ``lo``-th to ``hi``-th best of a run."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for labels, ids, component in whole_runs(batches):
            first, size = run_sizes(labels)
            for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                for x, y, agree in crowded_candidates(labels[a : a + n], component[a : a + n], least, comparisons):
                    order = np.lexsort((ids[a + y], -agree, x))  # rows come in whole, so that their ranks are known here
                    x, y, agree = x[order], y[order], agree[order]
                    rank = np.arange(len(x)) - np.searchsorted(x, x)
                    take = (rank >= lo) & (rank < hi)
                    p, q = ids[a + x[take]], ids[a + y[take]]
                    if len(p):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(agree[take].astype(np.int32))], names=["a", "b", "agree"])

    return ordered.mapInArrow(look, "a bigint, b bigint, agree int").filter("a <> b").dropDuplicates(["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked) of pairs of ids, by their full shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[object, set] = (None, set())

        def shingles(text: str) -> set:
            w = text.encode().lower().split()
            return set(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) > k else {tuple(w)}

        for batch in batches:
            linked = []
            for a, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if last[0] != a:
                    last = (a, shingles(x))
                other = shingles(y)
                both = len(last[1] & other)
                linked.append(100 * both >= percent * (len(last[1]) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint, linked boolean")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", comparisons: int | None = COMPARISONS) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links of ``percent`` or more), kept, n_links.

    Ids are integers. ``n_links`` counts the confirmed links of the row's set with other sets."""
    nameless = F.shiftrightunsigned(F.xxhash64(text_col), 2) + F.lit(NAMELESS)
    source = docs.select(F.coalesce(F.col(id_col).cast("bigint"), nameless).alias("id"), F.col(text_col).alias("text"))
    rows = checkpoint(sketches(source, k))
    classes = checkpoint(rows.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("sketch").alias("sketch")))
    reps = classes.select(F.col("rep").alias("id"), "sketch")
    n_reps = classes.count()
    alone = reps.withColumn("component", F.col("id"))
    least = least_agreement(percent / 100, SLACK[0])
    least_long = least, least_agreement(percent / 100, SLACK[1], PLACES + LONG)
    seen = checkpoint(near_rows(forest(alone, n_reps), least, True))
    # the rows at the edges of partitions: EDGE at both ends of each
    edges = seen.filter(F.col("kind") == AT_EDGE).select("label", F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    edge_pairs = near_rows(edges.repartitionByRange(edges.count() // PER_TASK + 1, "label", "id").sortWithinPartitions("label", "id"), least, False)
    pairs = checkpoint(seen.filter(F.col("kind") == PAIR).select("a", "b", "agree").unionByName(edge_pairs.filter(F.col("kind") == PAIR).select("a", "b", "agree")).dropDuplicates(["a", "b"]))
    crowded = checkpoint(seen.filter(F.col("kind") == CROWDED).select(F.col("a").alias("id")).distinct())
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(crowded).distinct()
    texts = checkpoint(source.filter("text is not null").join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")))
    links = tested = label = None

    def confirm(left: DataFrame) -> None:
        """Tests candidates that are new and lie between components."""
        nonlocal links, tested, label
        seen = checkpoint(confirmed(left, texts, k, percent))
        tested = seen.select("a", "b") if tested is None else tested.union(seen.select("a", "b"))
        found = seen.filter("linked")
        links = found if links is None else links.union(found)
        if label is None or found.limit(1).count():
            label = checkpoint(connected_components(links))

    def untested(left: DataFrame) -> DataFrame:
        left = left.join(tested, ["a", "b"], "left_anti")
        for end in "ab":
            left = left.join(label.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
        return left.filter("ca <> cb").select("a", "b", "agree")

    # first the two best candidates of each row, then what still lies between components
    by_agreement = Window.partitionBy("x").orderBy(F.desc("agree"), "a", "b")
    ends = pairs.select(F.col("a").alias("x"), "a", "b", "agree").union(pairs.select("b", "a", "b", "agree"))
    confirm(ends.withColumn("n", F.row_number().over(by_agreement)).filter("n <= 2").select("a", "b").distinct())
    confirm(untested(pairs))
    n_crowded, lo, hi = crowded.count(), 0, BEST
    if n_crowded:
        more = long_sketches(texts.join(crowded, "id", "left_semi"), k)
        longer = checkpoint(reps.join(more, "id").select("id", F.concat("sketch", "more").alias("sketch")))
    while n_crowded:
        named = longer.join(label.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        more = checkpoint(between_components(forest(named, n_crowded), least_long, comparisons, lo, hi))
        if not more.limit(1).count():
            break
        confirm(untested(more))
        lo, hi = hi, 3 * hi
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    named = classes.select("digest", "rep").join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").join(degree, "rep", "left")
    out = rows.select("id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.coalesce("component", "rep", "id")
    named = lambda c: F.when(c < NAMELESS, c)
    return out.select(named(F.col("id")).alias(id_col), "n_shingles", named(component).alias("component_id"), (F.col("id") == component).alias("kept"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
