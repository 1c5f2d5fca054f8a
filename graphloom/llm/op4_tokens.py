"""Token counts per section by offset-mapped attribution.

A document is encoded once, whole. Token lengths give every token's byte span; sections are character spans,
mapped to bytes by counting first bytes of characters. Tokens are interval-joined to sections; one that
crosses a boundary goes to a single section by an explicit rule, so the counts of a document's sections sum
up to its token count.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table, text_or_empty

RULES = ("majority", "first", "last")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def encoder(ranks_file: bytes, pattern: str):
    """The encoding and the byte length of every token; built once in a Python worker."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Byte bounds of lines; a line feed ends its line. An empty text has no line."""
    ends = np.flatnonzero(data == 10) + 1
    return np.unique(np.concatenate([[0], ends, [len(data)]]))


def span_bounds(data: np.ndarray, spans: list[dict | None]) -> tuple[np.ndarray, np.ndarray]:
    """Byte bounds and the section number of each piece between them, -1 outside all sections.

    Sections are character spans [start, end), clipped to the text; null ones, and those with a null bound, hold
    nothing. A character of several sections belongs to the one that starts first, of equals the first in the list."""
    first = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    bounds, owner, at = [0], [], 0
    told = [(max(0, s["start"]), i, s["end"]) for i, s in enumerate(spans) if s and s["start"] is not None and s["end"] is not None]
    for start, i, end in sorted(told):
        for upto, who in ((first[min(start, len(first) - 1)], -1), (first[min(max(start, end), len(first) - 1)], i)):
            if upto > at:
                bounds.append(int(upto))
                owner.append(who)
                at = int(upto)
    if at < len(data):
        bounds.append(len(data))
        owner.append(-1)
    return np.array(bounds), np.array(owner, np.int64)


def allocate(lengths: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Piece between `bounds` that each token goes to, and the number of tokens that cross a bound.

    first, last: the piece of its first or last byte. majority: the piece with most of its bytes, the
    earlier one of equals."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    low, high = np.searchsorted(bounds, starts, "right") - 1, np.searchsorted(bounds, ends - 1, "right") - 1
    crossing = np.flatnonzero(low != high)
    chosen = high if rule == "last" else low.copy()
    if rule == "majority" and len(crossing):
        spread = high[crossing] - low[crossing] + 1
        token = np.repeat(crossing, spread)
        piece = low[token] + np.arange(len(token)) - np.repeat(np.cumsum(spread) - spread, spread)
        shared = np.minimum(ends[token], bounds[piece + 1]) - np.maximum(starts[token], bounds[piece])
        order = np.lexsort((piece, -shared, token))
        kept = order[np.unique(token[order], return_index=True)[1]]
        chosen[token[kept]] = piece[kept]
    return chosen, len(crossing)


def attribute_tokens(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, rule: str = "majority", sections: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, section_tokens (array), outside_tokens for every row.

    Sections are lines, or the column `sections` (array of struct start, end in characters; null: none), as
    span_bounds() takes them. A null or empty text has no token, and no line. No rows give an empty result. Texts of any length are encoded
    whole, one at a time. Repeated rows get equal results; other columns are ignored."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary or default_vocabulary(), "rb") as f:
        ranks_file, pattern_ = f.read(), pattern or default_pattern()
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_or_empty().alias("text"), *([F.col(sections).alias("sections")] if sections else []))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, token_bytes = encoder(ranks_file, pattern_)
        for b in batches:
            out: list[tuple] = []
            spans = b.column("sections").to_pylist() if sections else [None] * b.num_rows
            for text, own in zip(b.column("text"), spans, strict=True):
                body = text.as_py()
                data = np.frombuffer(body.encode(), np.uint8)
                tokens = np.array(encoding.encode_ordinary(body), np.int64)
                if sections:
                    bounds, owner = span_bounds(data, own or [])
                    n = len(own or [])
                else:
                    bounds = line_bounds(data)
                    n = len(bounds) - 1
                    owner = np.arange(n)
                if not len(tokens):
                    out.append((0, n, 0, [0] * n, 0))
                    continue
                chosen, crossing = allocate(token_bytes[tokens], bounds, rule)
                per = np.bincount(owner[chosen] + 1, minlength=n + 1)
                out.append((len(tokens), n, crossing, per[1:].tolist(), int(per[0])))
            names = ["n_tokens", "n_sections", "n_crossing", "section_tokens", "outside_tokens"]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64()]
            columns = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], ["doc_id", *names])

    return rows.mapInArrow(count, f"doc_id {kind}, n_tokens long, n_sections int, n_crossing int, section_tokens array<int>, outside_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_tokens(table(spark, sf_dir, "documents"))
