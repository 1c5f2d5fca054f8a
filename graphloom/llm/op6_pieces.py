"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts fall into units (a run of word marks and what follows up to the next run), as no piece has
a mark behind another character. A long unit also ends where no piece holds both neighbours. The distinct units
are concatenated and indexed by a suffix array, sorted by the first 8 characters of every suffix (4 or 2 where a
batch has many different ones). Binary search gives every piece the range of its occurrences, or of those of its
first characters, in which the further ones are compared; these edges are sorted by position into a table, and
merges relax over the table until no edge joins two symbols. As the vocabulary is a BPE one, the relaxation takes
a unit's best-scored edge first, the leftmost of equals, which gives the library's ids. Other models are refused.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

MARK = "▁"
UNIT = re.compile(f"{MARK}+[^{MARK}]*")
#: Characters of texts that are cut into units together, and of distinct units that share a suffix array (a
#: longer unit has one of its own); units longer than LONG_UNIT are relaxed by a heap each.
BATCH_CHARS, INDEX_CHARS, LONG_UNIT = 2_000_000, 600_000, 48
NONE = np.iinfo(np.int32).max


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The vocabulary of a model: ordinary pieces by score, byte pieces, and all pieces as bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        ordinary = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        ordinary.sort(key=lambda i: (-sp.get_score(i), i))
        self.ids = np.array(ordinary, np.int32)
        names = [sp.id_to_piece(i) for i in ordinary]
        if any(MARK in x.lstrip(MARK) for x in names):
            raise ValueError("a piece has a word mark behind another character, so units are not independent")
        if any(sp.get_score(i) != int(sp.get_score(i)) for i, x in zip(ordinary, names, strict=True) if len(x) > 1):
            raise ValueError("scores that are no ranks: not a BPE model")
        self.pairs = {x[i : i + 2] for x in names for i in range(len(x) - 1)}
        self.longest = max(map(len, names))
        self.size = np.array([len(x) for x in names])
        chars = sorted({c for x in names for c in x})
        self.chars = np.array([ord(c) for c in chars], np.uint32)
        code = {c: i for i, c in enumerate(chars)}
        self.codes = np.full((len(names), self.longest), -1, np.int32)
        for i, x in enumerate(names):
            self.codes[i, : len(x)] = [code[c] for c in x]
        self.single = {x: ordinary[i] for i, x in enumerate(names) if len(x) == 1}
        self.of_byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.of_byte] = True
        self.text = [b"" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        for b, i in enumerate(self.of_byte):
            self.text[i] = bytes([b])


@lru_cache(maxsize=2)
def pieces_of(model: bytes) -> Pieces:
    return Pieces(model)


def packed(codes: np.ndarray, depth: int, wide: int) -> list[np.ndarray]:
    """The `depth` codes from each position on, `8 // wide` of them to a 64-bit key, first ones highest."""
    n, each = codes.shape[-1], 8 // wide
    padded = np.concatenate([codes, np.zeros(depth + each, codes.dtype)]).astype(np.uint64)
    keys = []
    for k in range(0, depth, each):
        key = padded[k : k + n].copy()
        for j in range(1, each):
            key <<= np.uint64(8 * wide)
            key |= padded[k + j : k + j + n]
        keys.append(key)
    return keys


def edge_table(v: Pieces, points: np.ndarray) -> np.ndarray:
    """Rank of the piece that covers each (position, length - 1), NONE without one. `points`: code points of
    units with a break between them.

    The suffix array is sorted by its first key, the first 8 characters (4 or 2 with many different ones).
    A longer piece's range is that of its beginning; its occurrences are those whose further keys agree."""
    at = np.searchsorted(v.chars, points)
    at[at == len(v.chars)] = 0
    known = v.chars[at] == points
    used = np.unique(at[known])
    code = np.zeros(len(v.chars) + 1, np.uint32)
    code[used] = np.arange(1, len(used) + 1)
    wide = 1 if len(used) < 255 else 2 if len(used) < 65535 else 4
    each = 8 // wide
    table_ = np.full((len(points), v.longest), NONE, np.int32)
    keys = packed(np.where(known, code[at], 0).astype(np.uint32), v.longest, wide)
    starts = np.flatnonzero(known)
    order = starts[np.argsort(keys[0][starts])]
    prefixes = keys[0][order]
    mapped = code[v.codes]  # the code at -1 is 0
    there = np.flatnonzero(((mapped > 0) | (v.codes < 0)).all(axis=1) & (v.size > 1))
    if not len(order) or not len(there):
        return table_
    ones = np.uint64((1 << 8 * wide) - 1)
    wanted, masks = [], []
    for k in range(0, v.longest, each):
        want, mask = np.zeros(len(there), np.uint64), np.zeros(len(there), np.uint64)
        for j in range(k, k + each):
            want <<= np.uint64(8 * wide)
            mask <<= np.uint64(8 * wide)
            if j < v.longest:
                want |= mapped[there, j].astype(np.uint64)
                mask |= np.where(v.size[there] > j, ones, np.uint64(0))
        wanted.append(want)
        masks.append(mask)
    begin, end = np.searchsorted(prefixes, wanted[0], "left"), np.searchsorted(prefixes, wanted[0] | ~masks[0], "right")
    count = end - begin
    piece = np.repeat(np.arange(len(there)), count)
    place = order[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(piece))]
    right = v.size[there][piece] <= each
    further = np.flatnonzero(~right)
    agree = np.ones(len(further), bool)
    for key, want, mask in zip(keys[1:], wanted[1:], masks[1:], strict=True):
        agree &= (key[place[further]] & mask[piece[further]]) == want[piece[further]]
    right[further] = agree
    piece, place = there[piece[right]], place[right]
    cell = place * v.longest + v.size[piece] - 1
    sort = np.argsort(cell)
    table_.ravel()[cell[sort]] = piece[sort]
    return table_


def relax(edges: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every symbol, by position, of the units [starts, ends): all units take their best
    edge in a round, until none has one."""
    longest = edges.shape[1]
    size = ends - starts
    unit = np.repeat(np.arange(len(starts)), size)
    at = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size) + starts[unit]
    done_s, done_e = [], []
    while len(at):
        head = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        last = np.r_[unit[1:] != unit[:-1], True]
        stop = np.where(last, ends[unit], np.r_[at[1:], 0])
        joined = np.r_[stop[1:], 0]
        length = joined - at
        can = ~last & (length <= longest)
        rank = np.full(len(at), NONE, np.int64)
        rank[can] = edges[at[can], length[can] - 1]
        best = np.minimum.reduceat(rank << 32 | np.arange(len(at)), head)
        merges = best >> 32 < NONE
        grown = np.repeat(merges, np.diff(np.r_[head, len(at)]))
        done_s.append(at[~grown])
        done_e.append(stop[~grown])
        keep = grown.copy()
        keep[(best[merges] & 0xFFFFFFFF) + 1] = False
        at, unit = at[keep], unit[keep]
    s, e = np.concatenate([[], *done_s]).astype(np.int64), np.concatenate([[], *done_e]).astype(np.int64)
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def relax_long(edges: np.ndarray, start: int, end: int) -> tuple[list[int], list[int]]:
    """relax() for one long unit: a heap of edges by (rank, position) over linked symbols."""
    longest = edges.shape[1]
    stop = {i: i + 1 for i in range(start, end)}
    before = {i: i - 1 for i in range(start + 1, end)}
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = stop[i]
        if j < end and stop[j] - i <= longest and (r := int(edges[i, stop[j] - i - 1])) != NONE:
            heapq.heappush(heap, (r, i, stop[j]))

    for i in range(start, end):
        offer(i)
    while heap:
        _, i, k = heapq.heappop(heap)
        j = stop.get(i)
        if j is None or j >= end or stop.get(j) != k:
            continue
        stop[i] = k
        del stop[j]
        if k < end:
            before[k] = i
        offer(i)
        if i > start:
            offer(before[i])
    s = sorted(stop)
    return s, [stop[i] for i in s]


def encode_units(v: Pieces, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units one after the other, and where each unit's ids begin (one more entry at the end)."""
    joined = "\0".join([*units, ""])
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.array([len(u) for u in units], np.int64)
    starts = np.cumsum(size + 1) - size - 1
    ends = starts + size
    breaks = points.copy()
    breaks[ends] = 0xFFFFFFFF
    edges = edge_table(v, breaks)
    short = size <= LONG_UNIT
    s, e = relax(edges, starts[short], ends[short])
    for i in np.flatnonzero(~short):
        a, b = relax_long(edges, int(starts[i]), int(ends[i]))
        s, e = np.concatenate([s, a]), np.concatenate([e, b])
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    ids = np.empty(len(s), np.int32)
    many = e - s > 1
    ids[many] = v.ids[edges[s[many], e[many] - s[many] - 1]]
    chars, back = np.unique(points[s[~many]], return_inverse=True)
    one = [[v.single[chr(c)]] if chr(c) in v.single else v.of_byte[list(chr(c).encode("utf-8", "surrogatepass"))].tolist() for c in chars.tolist()]
    width = np.ones(len(s), np.int64)
    width[~many] = np.array([len(x) for x in one], np.int64)[back] if len(one) else 0
    at = np.cumsum(width) - width
    out = np.empty(int(width.sum()), np.int32)
    out[at[many]] = ids[many]
    where = at[~many]
    first = np.array([x[0] for x in one], np.int32)
    out[where] = first[back] if len(one) else 0
    for n in range(1, 4):
        more = np.array([x[n] if len(x) > n else -1 for x in one], np.int32)
        if (more >= 0).any():
            hit = more[back] >= 0
            out[where[hit] + n] = more[back][hit]
    begin = np.r_[at, len(out)][np.searchsorted(s, np.r_[starts, len(points)])]
    return out, begin


def encode_blocks(v: Pieces, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """encode_units() by blocks of about INDEX_CHARS characters, as units don't depend on one another."""
    sizes = np.cumsum([len(u) + 1 for u in units])
    cuts = np.flatnonzero(np.diff(sizes // INDEX_CHARS)) + 1
    ids, begins, at = [], [np.zeros(1, np.int64)], 0
    for a, b in zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(units)].tolist(), strict=True):
        some, begin = encode_units(v, units[a:b])
        ids.append(some)
        begins.append(begin[1:] + at)
        at += len(some)
    return np.concatenate(ids), np.concatenate(begins)


def shorter(v: Pieces, unit: str) -> list[str]:
    """A long unit, cut where no piece holds both neighbours, so that no merge crosses a cut."""
    cuts = [0, *(i for i in range(1, len(unit)) if unit[i - 1 : i + 1] not in v.pairs), len(unit)]
    return [unit[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def encode_batch(v: Pieces, texts: list[str]) -> list[np.ndarray]:
    """Ids of every text; an empty text has none."""
    all_units: list[str] = []
    per_text = np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            for unit in UNIT.findall(MARK + t.replace(" ", MARK)):
                if len(unit) > LONG_UNIT:
                    all_units += shorter(v, unit)
                else:
                    all_units.append(unit)
        per_text[i + 1] = len(all_units)
    if not all_units:
        return [np.empty(0, np.int32) for _ in texts]
    index = dict.fromkeys(all_units)
    index = dict(zip(index, range(len(index)), strict=True))
    ids, begin = encode_blocks(v, list(index))
    unit = np.fromiter(map(index.__getitem__, all_units), np.int64, len(all_units))
    count = np.diff(begin)[unit]
    after = np.cumsum(count)
    joined = ids[np.repeat(begin[unit] - (after - count), count) + np.arange(int(after[-1]))]
    return np.split(joined, np.r_[0, after][per_text[1:-1]])


def decode(v: Pieces, ids: np.ndarray) -> str:
    """Text of ids: pieces as bytes, without the leading space that encoding adds."""
    joined = b"".join([v.text[i] for i in ids.tolist()])
    return (joined[1:] if joined[:1] == b" " else joined).decode("utf-8", "replace")


def parts(texts: list[str]) -> Iterator[slice]:
    """Slices of about BATCH_CHARS characters; a longer text is a slice of its own."""
    begin = chars = 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > BATCH_CHARS:
            yield slice(begin, i)
            begin, chars = i, 0
        chars += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def _read(model: str | None) -> bytes:
    with open(model or default_model(), "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (array of int) for every row; a null or empty text has no ids.

    Whole texts are encoded. Repeated rows get equal results; an empty table gives an empty result; other
    columns are ignored. A text's word marks (U+2581) are encoded as spaces, as the library does."""
    return encode_corpus(docs, model, ())


def encode_corpus(docs: DataFrame, model: str | None = None, keep: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the columns `keep`, n_tokens and ids (array of int) for every row, in one pass over the texts.

    Rows as in encode_documents()."""
    proto = _read(model)
    held = docs.select("doc_id", *keep, F.col("text").cast("string").alias("text"))
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema if f.name != "text"), "n_tokens long, ids array<int>"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces_of(proto)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for part in parts(texts):
                ids = encode_batch(v, texts[part])
                at = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
                kept = [b.column(c)[part] for c in ("doc_id", *keep)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([len(x) for x in ids], pa.int64()), pa.ListArray.from_arrays(at, pa.array(np.concatenate(ids)))], ["doc_id", *keep, "n_tokens", "ids"])

    return held.mapInArrow(encode, kind)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of every row (doc_id, ids); null ids give a null text, and so do ids of which one is null or beyond
    the vocabulary."""
    proto, kind = _read(model), encoded.schema["doc_id"].dataType.simpleString()

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces_of(proto)
        for b in batches:
            known = lambda x: x is not None and all(i is not None and 0 <= i < len(v.text) for i in x)
            texts = [decode(v, np.array(x, np.int64)) if known(x) else None for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(back, f"doc_id {kind}, text string")


def digest_documents(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_fallback, ids_crc32, round_trip for every row: encoded and decoded again in a task.

    round_trip compares with the text whose word marks (U+2581) are spaces. Rows as in encode_documents()."""
    proto, kind = _read(model), docs.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces_of(proto)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows = []
            for part in parts(texts):
                for t, ids in zip(texts[part], encode_batch(v, texts[part]), strict=True):
                    rows.append((len(ids), int(v.is_byte[ids].sum()), zlib.crc32(ids.tobytes()), decode(v, ids) == t.replace(MARK, " ")))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", "n_tokens", "n_fallback", "ids_crc32", "round_trip"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(digest, f"doc_id {kind}, n_tokens long, n_fallback long, ids_crc32 long, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
