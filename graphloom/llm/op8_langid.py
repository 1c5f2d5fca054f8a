"""Language ID by a bidirectional gated recurrent network over bytes.

The network is trained on the driver in numpy, by backpropagation through time, from a bounded sample of
labelled windows. It labels every byte of a text; a document's probabilities are the mean over its bytes.
Texts are cut into segments of SEGMENT bytes, in which both directions start anew, so a text of any length
costs memory for one block of segments only, and every byte is labelled exactly once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

SEGMENT, BLOCK = 128, 2048


class ByteGru:
    """Two gated recurrent units of `hidden` cells, one per direction, under a softmax at every byte.

    Arrays are feature-major: a gate of a whole block is one contiguous slice."""

    def __init__(self, classes: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        near = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.classes, self.hidden = classes, hidden
        self.p = {"x0": near(3 * hidden, 256), "u0": near(3 * hidden, hidden), "x1": near(3 * hidden, 256), "u1": near(3 * hidden, hidden), "o": near(len(classes), 2 * hidden), "c": np.zeros((len(classes), 1), np.float32)}

    def run(self, d: int, x: np.ndarray, mask: np.ndarray | None = None, keep: list | None = None) -> np.ndarray:
        """States (steps, hidden, rows) of direction d over bytes x (steps, rows); `mask` holds a state at zero
        beyond a text's end; `keep` gets what backward() needs."""
        n, (steps, rows) = self.hidden, x.shape
        wx, u = self.p[f"x{d}"], self.p[f"u{d}"]
        out = np.empty((steps, n, rows), np.float32)
        h = np.zeros((n, rows), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            a = np.take(wx, x[t], axis=1)
            g = u @ h
            s = a[: 2 * n]
            s += g[: 2 * n]
            np.negative(s, out=s)
            np.exp(s, out=s)
            s += 1
            np.reciprocal(s, out=s)
            z, r, q = s[:n], s[n:], g[2 * n :]
            m = np.tanh(a[2 * n :] + r * q)
            if keep is not None:
                keep.append((t, h, z, r, q, m))
            h = m + z * (h - m)
            if mask is not None:
                h *= mask[t]
            out[t] = h
        return out

    def logits(self, states: np.ndarray) -> np.ndarray:
        return np.matmul(self.p["o"], states) + self.p["c"]

    def probabilities(self, x: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
        """Softmax (steps, classes, rows) at every byte."""
        e = self.logits(np.concatenate([self.run(0, x, mask), self.run(1, x, mask)], axis=1))
        e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(axis=1, keepdims=True)
        return e

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all labelled bytes, and its gradients through time."""
        n, (steps, rows) = self.hidden, x.shape
        kept: list[list] = [[], []]
        states = np.concatenate([self.run(d, x, mask, kept[d]) for d in (0, 1)], axis=1)
        e = self.logits(states)
        e -= e.max(axis=1, keepdims=True)
        p = np.exp(e)
        p /= p.sum(axis=1, keepdims=True)
        right, total = np.arange(rows), mask.sum()
        loss = float(-(np.log(p[:, y, right] + 1e-9) * mask).sum() / total)
        p[:, y, right] -= 1
        p *= (mask / total)[:, None, :]
        out = {"o": np.einsum("tcr,tsr->cs", p, states, optimize=True), "c": p.sum(axis=(0, 2))[:, None]}
        back = np.matmul(self.p["o"].T, p)
        hot = np.zeros((steps * rows, 256), np.float32)
        hot[np.arange(steps * rows), x.ravel()] = 1
        for d in (0, 1):
            u, du = self.p[f"u{d}"], np.zeros_like(self.p[f"u{d}"])
            da = np.zeros((3 * n, steps, rows), np.float32)
            dh = np.zeros((n, rows), np.float32)
            for t, h, z, r, q, m in reversed(kept[d]):
                dh = (dh + back[t, d * n : (d + 1) * n]) * mask[t]
                dm = dh * (1 - z) * (1 - m * m)
                g = np.concatenate([dh * (h - m) * z * (1 - z), dm * q * r * (1 - r), dm * r])
                da[:, t] = np.concatenate([g[: 2 * n], dm])
                du += g @ h.T
                dh = dh * z + u.T @ g
            out[f"u{d}"], out[f"x{d}"] = du, da.reshape(3 * n, -1) @ hot
        return loss, out

    def fit(self, windows: list[bytes], labels: list[int], epochs: int = 12, batch: int = 128, rate: float = 0.03, seed: int = 7) -> ByteGru:
        """Adam over shuffled batches of windows; gradients are clipped."""
        steps = max(map(len, windows))
        x = np.zeros((steps, len(windows)), np.uint8)
        mask = np.zeros((steps, len(windows)), np.float32)
        for i, w in enumerate(windows):
            x[: len(w), i] = np.frombuffer(w, np.uint8)
            mask[: len(w), i] = 1
        y, rng = np.array(labels), np.random.default_rng(seed)
        first, second, k = {n: np.zeros_like(v) for n, v in self.p.items()}, {n: np.zeros_like(v) for n, v in self.p.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(windows))
            for at in range(0, len(order), batch):
                some, k = order[at : at + batch], k + 1
                _, g = self.gradients(x[:, some], y[some], mask[:, some])
                for name, v in g.items():
                    v = np.clip(v, -1, 1)
                    first[name] = 0.9 * first[name] + 0.1 * v
                    second[name] = 0.99 * second[name] + 0.01 * v * v
                    step = rate * (1 - epoch / epochs) * (first[name] / (1 - 0.9**k)) / (np.sqrt(second[name] / (1 - 0.99**k)) + 1e-8)
                    self.p[name] = (self.p[name] - step).astype(np.float32)
        return self

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean class probabilities (texts, classes) of the byte ranges between `offsets` of `data`."""
        sizes = np.diff(offsets).astype(np.int64)
        count = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(sizes)), count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        size = sizes[owner]
        skip = np.where(size >= SEGMENT, np.maximum(0, (nth + 1) * SEGMENT - size), 0)  # the last segment ends with the text; what was seen before isn't counted again
        start = offsets[:-1].astype(np.int64)[owner] + nth * SEGMENT - skip
        room = np.minimum(size, SEGMENT)
        total = np.zeros((len(sizes), len(self.classes)))
        for short in (False, True):
            which = np.flatnonzero((room < SEGMENT) == short)
            for at in range(0, len(which), BLOCK):
                some = which[at : at + BLOCK]
                steps = np.arange(int(room[some].max()))[:, None]
                x = data[np.minimum(start[some] + steps, len(data) - 1)]
                counted = ((steps >= skip[some]) & (steps < room[some])).astype(np.float32)
                p = self.probabilities(x, counted if short else None)
                np.add.at(total, owner[some], np.einsum("tcr,tr->rc", p, counted, optimize=True))
        return total / np.maximum(sizes, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    """Documents whose remainder is 1 are never learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_windows(docs: DataFrame, per_language: int = 384, length: int = 64) -> DataFrame:
    """lang, window: at most `per_language` windows of a language, each of `length` characters from a place
    that a hash picks in the whole text. The aggregate keeps one window per language and hash slot, before
    the shuffle already, so neither the shuffle nor what the driver gets grows with the rows."""
    text = F.col("text").cast("string")
    h = F.xxhash64(text)
    place = F.pmod(F.shiftright(h, 20), F.greatest(F.length(text) - length, F.lit(1))) + 1
    labelled = docs.where(F.col("lang").isNotNull() & text.isNotNull() & ~held_out(F.col("doc_id")))
    cut = labelled.select("lang", F.pmod(h, F.lit(per_language)).alias("slot"), F.shiftright(h, 8).alias("h"), F.substring(text, place.cast("int"), F.lit(length)).alias("window")).where(has_letter(F.col("window")))
    return cut.groupBy("lang", "slot").agg(F.min(F.struct("h", "window")).alias("w")).select("lang", "w.window")


def train(docs: DataFrame, per_language: int = 384) -> ByteGru | None:
    """The network learned from docs (doc_id, text, lang); None if nothing is labelled."""
    rows = sorted((r.lang, r.window) for r in training_windows(docs, per_language).collect())
    if not rows:
        return None
    classes = sorted({lang for lang, _ in rows})
    return ByteGru(classes).fit([w.encode() for _, w in rows], [classes.index(lang) for lang, _ in rows])


def predict(docs: DataFrame, model: ByteGru | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only the text is an input of a prediction.

    `und` with score 0 where the text is null or has no letter, or nothing was learned. Repeated rows get
    equal results; an empty table gives an empty result; other columns are ignored."""
    body = F.when(has_letter(F.col("text").cast("string")), F.col("text").cast("string"))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), body.alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").cast(pa.large_binary())
            if not len(text):
                continue
            lang, score = np.full(len(text), "und", object), np.zeros(len(text))
            if model is not None:
                offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                data = np.frombuffer(text.buffers()[2] or b"\0", np.uint8)
                p = model.pooled(data, offsets)
                known = text.is_valid().to_numpy(zero_copy_only=False)
                lang[known] = np.array(model.classes, object)[p.argmax(axis=1)][known]
                score[known] = np.minimum(p.max(axis=1), 1)[known]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(label, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, min_score: float = 0.35) -> DataFrame:
    """Rows of `docs` whose text the network gives a language with a pooled probability of `min_score`.

    Rows without a letter in their text go. Where no row is labelled nothing is learned, and all others stay."""
    model, lettered = train(docs), docs.where(has_letter(F.col("text").cast("string")))
    if model is None:
        return lettered

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text").cast(pa.large_binary())
            if len(text):
                offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
                p = model.pooled(np.frombuffer(text.buffers()[2] or b"\0", np.uint8), offsets)
                yield b.filter(pa.array(p.max(axis=1) >= min_score))

    return lettered.mapInArrow(kept, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
