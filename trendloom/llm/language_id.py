"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on windows of a bounded sample of labelled rows. Texts are cut into
windows; the network labels every byte of every window with language probabilities, which are pooled over the
whole document.

Defined results: texts that are null or have no letter are ``und`` with score 0; so is everything where no row is
labelled; of languages with equal probability the first by name is predicted; ids may be of any type, rows without one are never
learned from; repeated ids are judged row by row, and copies of a text are learned from once; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import slices

HIDDEN, WINDOW = 8, 64
#: The bound of the training sample: rows of a language, windows of a row.
SAMPLE_ROWS, SAMPLE_WINDOWS = 300, 8
STEPS, BATCH, RATE = 240, 128, 0.02
#: Windows that are run through the network at once.
WIDE = 4096
UNDETERMINED = "und"
_word_sign = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    """Signs like superscript digits are word signs, but no letters."""
    return any(m[0].isalpha() for m in _word_sign.finditer(text or ""))


class BiGRU:
    """Two gated recurrent layers, one in each direction, and a softmax over their states at each byte.

    Gates are kept as tanh of half their input, so that one tanh serves all three."""

    def __init__(self, classes: int, seed: int = 7):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["E" + d] = r.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p["U" + d] = r.normal(0, 0.3, (h, 3 * h)).astype(np.float32)
        self.p["V"] = r.normal(0, 0.3, (2 * h, classes)).astype(np.float32)
        self.p["c"] = np.zeros(classes, np.float32)

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (time, windows, hidden) of one direction for bytes x (time, windows)."""
        h = HIDDEN
        e, u = self.p["E" + d], self.p["U" + d]
        steps, wide = x.shape
        out = np.empty((steps, wide, h), np.float32)
        s = np.zeros((wide, h), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = e.take(x[t], 0)
            v = s @ u
            g = a[:, : 2 * h]
            g += v[:, : 2 * h]
            g *= 0.5
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            z, r = g[:, :h], g[:, h:]
            n = r * v[:, 2 * h :]
            n += a[:, 2 * h :]
            np.tanh(n, out=n)
            if keep is not None:
                keep.append((t, s, z, r, n, v[:, 2 * h :]))
            s = s - n
            s *= z
            s += n
            out[t] = s
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, windows, classes)"""
        both = np.concatenate([self.states(x, "f"), self.states(x, "b")], 2)
        y = both @ self.p["V"] + self.p["c"]
        y -= y.max(2, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(2, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all bytes under the mask, and its gradients by backpropagation through time."""
        h = HIDDEN
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.states(x, d, kept[d]) for d in "fb"], 2)
        y = both @ self.p["V"] + self.p["c"]
        y -= y.max(2, keepdims=True)
        y = np.exp(y)
        y /= y.sum(2, keepdims=True)
        weight = (mask / mask.sum())[:, :, None]
        right = np.broadcast_to(label, x.shape)[:, :, None]
        loss = -float((np.log(np.take_along_axis(y, right, 2) + 1e-12) * weight).sum())
        np.put_along_axis(y, right, np.take_along_axis(y, right, 2) - 1, 2)
        y = (y * weight).astype(np.float32)
        grad = {"V": both.reshape(-1, 2 * h).T @ y.reshape(-1, y.shape[2]), "c": y.sum((0, 1))}
        down = y @ self.p["V"].T
        hot = np.zeros((x.size, 256), np.float32)
        hot[np.arange(x.size), x.ravel()] = 1
        for d, part in (("f", down[:, :, :h]), ("b", down[:, :, h:])):
            u = self.p["U" + d]
            du = np.zeros_like(u)
            de = np.zeros((*x.shape, 3 * h), np.float32)
            later = np.zeros(part.shape[1:], np.float32)
            for t, s, z, r, n, v in reversed(kept[d]):
                dh = part[t] + later
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (s - n) * z * (1 - z)
                dr = dn * v * r * (1 - r)
                de[t] = np.concatenate([dz, dr, dn], 1)
                gate = np.concatenate([dz, dr, dn * r], 1)
                du += s.T @ gate
                later = dh * z + gate @ u.T
            grad["U" + d] = du
            grad["E" + d] = hot.T @ de.reshape(-1, 3 * h)
        return loss, grad


def train(windows: list[bytes], labels: np.ndarray, classes: int, steps: int = STEPS, seed: int = 7) -> BiGRU:
    """Adam over batches in which every language has the same weight."""
    net, r = BiGRU(classes, seed), np.random.default_rng(seed)
    raw, mask = frame(windows)
    by_label = [np.flatnonzero(labels == k) for k in range(classes)]
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        pick = np.concatenate([r.choice(own, max(1, BATCH // classes)) for own in by_label if len(own)])
        _, grad = net.gradients(raw[:, pick], mask[:, pick], labels[pick])
        rate = RATE * (1 - 0.9 * step / steps)
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def frame(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (time, windows) and which of them are there."""
    raw = np.zeros((len(windows), WINDOW), np.uint8)
    mask = np.zeros((len(windows), WINDOW), np.float32)
    for i, w in enumerate(windows):
        raw[i, : len(w)] = np.frombuffer(w, np.uint8)
        mask[i, : len(w)] = 1
    return np.ascontiguousarray(raw.T), np.ascontiguousarray(mask.T)


def pooled(net: BiGRU, texts: list[str], classes: int) -> np.ndarray:
    """Mean probabilities over all bytes of each text."""
    raws = [t.encode() for t in texts]
    size = np.array([len(r) for r in raws], np.int64)
    count = -(-size // WINDOW)
    flat = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    at = np.cumsum(count) - count
    for a, r in zip((at * WINDOW).tolist(), raws, strict=True):
        flat[a : a + len(r)] = np.frombuffer(r, np.uint8)
    owner = np.repeat(np.arange(len(raws)), count)
    left = np.minimum(WINDOW, size[owner] - (np.arange(len(owner)) - at[owner]) * WINDOW)
    x = flat.reshape(-1, WINDOW)
    out = np.zeros((len(raws), classes))
    for i in range(0, len(x), WIDE):
        y = net.probabilities(np.ascontiguousarray(x[i : i + WIDE].T))
        y *= (np.arange(WINDOW)[:, None] < left[i : i + WIDE])[:, :, None]
        part = y.sum(0, dtype=np.float64)
        for k in range(classes):
            out[:, k] += np.bincount(owner[i : i + WIDE], part[:, k], len(raws))
    return out / np.maximum(size, 1)[:, None]


def held_out(id_: Column) -> Column:
    """Rows that are never learned from."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(4)) == 2


def training_windows(docs: DataFrame) -> tuple[list[bytes], np.ndarray, list[str]]:
    """Windows spread over a bounded sample of labelled rows (columns id, text, lang), their labels, the languages."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~F.coalesce(held_out(F.col("id")), F.lit(True)))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    chance = F.lit(0.0)
    for lang in languages:  # of each language about SAMPLE_ROWS rows, by a hash of ids and texts
        chance = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE_ROWS / sizes[lang]))).otherwise(chance)
    some = known.filter(F.pmod(F.xxhash64("id", "text", F.lit(11)), F.lit(1_000_003)) < chance * 1_000_003)
    some = some.select(F.col("id").cast("string").alias("id"), "text", "lang").dropDuplicates(["text", "lang"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, lang, raw[a : a + WINDOW]) for i, text, lang in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (raw := text.encode()) for a in np.unique(np.linspace(0, max(0, len(raw) - WINDOW), SAMPLE_WINDOWS).astype(int)).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.binary())], names=["id", "lang", "bytes"])

    got = sorted((r["lang"], bytes(r["bytes"]), r["id"]) for r in some.mapInArrow(cut, "id string, lang string, bytes binary").collect())
    number = {lang: i for i, lang in enumerate(languages)}
    return [g[1] for g in got], np.array([number[g[0]] for g in got], np.int64), languages


def identify_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kind = source.schema["id"].dataType.simpleString()
    windows, labels, languages = training_windows(source)
    net = train(windows, labels, len(languages)) if languages else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if has_letter(t) else None for t in batch.column(2).to_pylist()]
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            for a, b in slices(texts, 1_000_000):
                own = [i for i in range(a, b) if texts[i] is not None]
                if net is None or not own:
                    continue
                p = pooled(net, [texts[i] for i in own], len(languages))
                for i, k, score in zip(own, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                    names[i], scores[i] = languages[k], min(1.0, max(0.0, score))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    asked = source.select("id", F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "text")
    return asked.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)
