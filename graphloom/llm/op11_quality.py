"""Document quality by random-indexing word vectors and a two-layer network with calibrated probabilities.

Every word, hashed into one of BUCKETS places, has a sparse random index vector of -1, 0 and 1. A word's vector is the
sum of the index vectors of the words around it, over all occurrences in all texts; sums of integers, so no order of
tasks changes them. A document is pooled to the weighted mean and deviation of its words' vectors, a two-layer network
in numpy scores that, and a temperature fitted on rows apart makes the scores probabilities.

The network learns from a bounded sample of labelled documents; the word statistics cover every text. What tasks are
handed is one table of BUCKETS x DIMS numbers, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table, text_or_empty

BUCKETS, DIMS, AROUND, NONZERO = 1 << 14, 32, 2, 4
#: Rows of the table of sums that travel together, bytes of text looked at together, words gathered together.
BLOCK, SPAN, STEP = 256, 4 << 20, 1 << 18
SPACE, LETTER, DIGIT, OTHER = range(4)


def _kinds() -> np.ndarray:
    kinds = np.full(256, OTHER, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = SPACE
    kinds[ord("0") : ord("9") + 1] = DIGIT
    for first, last in (("A", "Z"), ("a", "z")):
        kinds[ord(first) : ord(last) + 1] = LETTER
    kinds[128:] = LETTER
    return kinds


KIND = _kinds()


def index_vectors(seed: int = 11) -> np.ndarray:
    """The random index vector of every bucket: NONZERO places of DIMS hold -1 or 1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, DIMS), np.int8)
    places = rng.permuted(np.tile(np.arange(DIMS), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, rng.choice(np.array([-1, 1], np.int8), (BUCKETS, NONZERO)), axis=1)
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of every text between `offsets` of `data`, and where each text's words start.

    A word is a maximal run of letters (bytes over 127 included), digits or other signs, in its own case."""
    found, starts, begin = [], [], int(offsets[0])
    edges = np.zeros(int(offsets[-1]) - begin + 1, bool)
    edges[offsets - begin] = True
    at, end = begin, int(offsets[-1])
    while at < end:
        upto = min(at + SPAN, end)
        while upto < end and not edges[upto - begin] and KIND[data[upto]] == KIND[data[upto - 1]]:
            upto += 1
        kind = KIND[data[at:upto]]
        first = edges[at - begin : upto - begin].copy()
        first[0] = True
        first[1:] |= kind[1:] != kind[:-1]
        heads = np.flatnonzero(first)
        sums = np.empty(len(kind) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_mixed(data[at:upto], heads, first), out=sums[1:])
        tails = np.append(heads[1:], len(kind))
        h = sums[tails] - sums[heads]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        kept = kind[heads] != SPACE
        found.append((h[kept] >> np.uint64(40)).astype(np.int32) % BUCKETS)
        starts.append(heads[kept] + at)
        at = upto
    ids = np.concatenate(found) if found else np.zeros(0, np.int32)
    where = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return ids, np.searchsorted(where, offsets)


def _mixed(data: np.ndarray, heads: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for every byte by its value and its place in its word; their sum is the word's hash."""
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(heads, np.diff(np.append(heads, len(data)))).astype(np.uint64)
    x = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + place * np.uint64(0xD1342543DE82EF95)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def context_sums(ids: np.ndarray, bounds: np.ndarray, index: np.ndarray, out: np.ndarray) -> None:
    """Add to `out` (BUCKETS, DIMS + 1) what the words at most AROUND places off add to each word's vector, within a text,
    and one to its count."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for at in range(0, len(ids), STEP):
        end = min(at + STEP, len(ids))
        got = np.zeros((end - at, DIMS), np.int16)
        for off in (*range(-AROUND, 0), *range(1, AROUND + 1)):
            low, high = max(at, -off), min(end, len(ids) - off)
            if low < high:
                same = text[low:high] == text[low + off : high + off]
                got[low - at : high - at] += index[ids[low + off : high + off]] * same[:, None]
        order = np.argsort(ids[at:end], kind="stable")
        ranked = ids[at:end][order]
        heads = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        out[ranked[heads], :DIMS] += np.add.reduceat(got[order].astype(np.int64), heads, axis=0)
        out[ranked[heads], DIMS] += np.diff(np.append(heads, end - at))


def _texts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text = b.column("text").cast(pa.large_binary())
    return np.frombuffer(text.buffers()[2] or b"\0", np.uint8), np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]


def word_sums(docs: DataFrame) -> np.ndarray:
    """Context sums and counts (BUCKETS, DIMS + 1) over all texts. A task adds up its texts in a table of that size; the
    tables are added block by block, each block in one task that holds its own sum only."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, total = index_vectors(), np.zeros((BUCKETS, DIMS + 1), np.int64)
        for b in batches:
            if b.num_rows:
                context_sums(*words(*_texts(b)), index, total)
        parts = [(i, total[i * BLOCK : (i + 1) * BLOCK].tobytes()) for i in range(BUCKETS // BLOCK) if total[i * BLOCK : (i + 1) * BLOCK, DIMS].any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([s for _, s in parts], pa.binary())], ["block", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, s in zip(b.column("block").to_pylist(), b.column("sums").to_pylist(), strict=True):
                held[i] = held.get(i, 0) + np.frombuffer(s, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([s.tobytes() for s in held.values()], pa.binary())], ["block", "sums"])

    schema, out = "block int, sums binary", np.zeros((BUCKETS, DIMS + 1), np.int64)
    for r in docs.select(text_or_empty().alias("text")).mapInArrow(gather, schema).repartition("block").mapInArrow(add, schema).collect():
        out[r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.sums, np.int64).reshape(BLOCK, DIMS + 1)
    return out


class Pooler:
    """Word vectors of unit length and word weights, from word_sums(): frequent words weigh less.

    Every text is pooled with the weight of `prior` average words of the corpus, so that a few words alone make no
    extreme text."""

    def __init__(self, sums: np.ndarray, rare: float = 1e-3, prior: float = 4.0):
        count = sums[:, DIMS]
        vectors = sums[:, :DIMS] / np.maximum(count, 1)[:, None]
        vectors -= (vectors * count[:, None]).sum(axis=0) / max(count.sum(), 1)
        norm = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
        weight = rare / (rare + count / max(count.sum(), 1))
        self.table = np.concatenate([vectors / np.maximum(norm, 1e-9) * weight[:, None], weight[:, None]], axis=1).astype(np.float32)
        share = prior * count / max(count.sum(), 1)
        self.first = share @ self.table
        self.second = share @ (self.table[:, :DIMS] ** 2 / self.table[:, DIMS:])

    def pooled(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Weighted mean and deviation of the vectors of each text's words, (texts, 2 * DIMS); the corpus's own without words."""
        ids, bounds = words(data, offsets)
        first, second = np.zeros((len(bounds) - 1, DIMS + 1)), np.zeros((len(bounds) - 1, DIMS))
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for at in range(0, len(ids), STEP):
            some, of = self.table[ids[at : at + STEP]], text[at : at + STEP]
            heads = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            first[of[heads]] += np.add.reduceat(some, heads, axis=0, dtype=np.float64)
            some[:, :DIMS] *= some[:, :DIMS]
            some[:, :DIMS] /= some[:, DIMS:]
            second[of[heads]] += np.add.reduceat(some[:, :DIMS], heads, axis=0, dtype=np.float64)
        first, second = first + self.first, second + self.second
        weight = np.maximum(first[:, DIMS:], 1e-9)
        mean = first[:, :DIMS] / weight
        return np.concatenate([mean, np.sqrt(np.maximum(second / weight - mean**2, 0))], axis=1)


class Network:
    """Two layers: tanh units, then one logit, divided by a temperature."""

    def __init__(self, hidden: int = 24, seed: int = 3):
        self.hidden, self.seed, self.temperature = hidden, seed, 1.0
        self.p: dict[str, np.ndarray] = {}

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        return np.tanh(z @ self.p["w"] + self.p["b"]) @ self.p["v"] + self.p["c"]

    def gradients(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted cross-entropy of standardised rows z with a penalty on the layers, and its gradients."""
        h = np.tanh(z @ self.p["w"] + self.p["b"])
        t = h @ self.p["v"] + self.p["c"]
        loss = float((weight * (np.logaddexp(0, t) - y * t)).sum() + decay / 2 * sum((self.p[k] ** 2).sum() for k in "wv"))
        d = weight * (1 / (1 + np.exp(-t)) - y)
        back = np.outer(d, self.p["v"]) * (1 - h * h)
        return loss, {"w": z.T @ back + decay * self.p["w"], "b": back.sum(axis=0), "v": h.T @ d + decay * self.p["v"], "c": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 600, rate: float = 0.02, decay: float = 1e-3) -> Network:
        """Adam on all rows at once; every row weighs the same, so that scores follow the labels' shares."""
        rng = np.random.default_rng(self.seed)
        self.centre, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z, weight = (x - self.centre) / self.scale, np.full(len(y), 1 / len(y))
        self.p = {"w": rng.standard_normal((x.shape[1], self.hidden)) * 0.1, "b": np.zeros(self.hidden), "v": rng.standard_normal(self.hidden) * 0.1, "c": np.zeros(1)}
        first, second = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for k in range(1, steps + 1):
            for name, g in self.gradients(z, y, weight, decay)[1].items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                self.p[name] = self.p[name] - rate * (1 - k / (steps + 1)) * (first[name] / (1 - 0.9**k)) / (np.sqrt(second[name] / (1 - 0.999**k)) + 1e-8)
        return self

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Network:
        """The temperature of least cross-entropy on rows that were not learned from, by golden section on its logarithm."""
        t = self.logit(x)
        loss = lambda u: float(np.mean(np.logaddexp(0, t * np.exp(-u)) - y * t * np.exp(-u)))
        low, high, part = -2.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(60):
            a, b = high - part * (high - low), low + part * (high - low)
            low, high = (low, b) if loss(a) <= loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def held_out(doc_id: Column) -> Column:
    """Documents whose remainder is 1 are never learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def sampled(docs: DataFrame, labels: DataFrame, per_label: int = 2048) -> DataFrame:
    """doc_id, hash, quality: at most `per_label` labelled documents of each quality, the one of least text hash in each slot.

    Only ids and hashes of texts move. Rows with a null label or id and documents held out are not learned from; equal
    texts are one row."""
    told = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    hashes = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(text_or_empty()).alias("hash"))
    slot = F.pmod("hash", F.lit(per_label)).alias("slot")
    picked = hashes.join(told, "doc_id").groupBy("quality", slot).agg(F.min(F.struct(F.shiftrightunsigned("hash", 11).alias("order"), "hash", "doc_id")).alias("one"))
    return picked.select("one.doc_id", "one.hash", "quality")


def learned(docs: DataFrame, labels: DataFrame, per_label: int = 2048) -> tuple[Pooler, Network | None]:
    """The word vectors of all texts, and the network learned from the sample; None where no label is known.

    Four fifths of the sample, by text hash, are fitted, the rest sets the temperature. With one kind of label only
    every score leans to it."""
    pooler, sample = Pooler(word_sums(docs)), sampled(docs, labels, per_label)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("hash"), b.column("quality"), pa.array(list(pooler.pooled(*_texts(b))), pa.list_(pa.float64()))], ["hash", "quality", "x"])

    # At most 2 * per_label rows of numbers.
    chosen = docs.select("doc_id", text_or_empty().alias("text")).withColumn("hash", F.xxhash64("text")).join(F.broadcast(sample), ["doc_id", "hash"]).select("hash", "quality", "text")
    rows = sorted({(r.hash, r.quality): r.x for r in chosen.mapInArrow(pool, "hash long, quality int, x array<double>").collect()}.items())
    if not rows:
        return pooler, None
    x, y = np.array([r for _, r in rows]), np.array([q for (_, q), _ in rows], float)
    apart = np.array([h % 5 == 0 for (h, _), _ in rows])
    if len(set(y[~apart])) < 2 or not apart.any():
        apart[:] = False
    network = Network().fit(x[~apart], y[~apart])
    return pooler, network.calibrate(x[apart], y[apart]) if len(set(y[apart])) == 2 else network


def score_quality(docs: DataFrame, pooler: Pooler, network: Network | None) -> DataFrame:
    """doc_id, held_out, score (that the label is 1), predicted for every row of docs; only the text is an input of a score.

    A null text counts as empty, and a text without words is scored as the corpus's average word; equal texts get equal scores. Without a
    network every score is 0.5. An empty table gives an empty result; other columns are ignored."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                score = np.full(b.num_rows, 0.5) if network is None else network.score(pooler.pooled(*_texts(b)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(label, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, *learned(docs, table(spark, sf_dir, "labels")))
