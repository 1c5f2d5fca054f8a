"""N-gram Jaccard join of whole texts: a size-aware heavy-light join without pair lists of hot groups.

A set holds the distinct word shingles of a text, hashed to 64 bits. With threshold t, two linked sets A, B
have |A - B| <= f(a) = a - ceil(t a), and |A ^ B| <= r (a + b) with r = (1 - t) / (1 + t).

1. Equal texts and equal sets are one class; classes are joined, not documents.
2. Lonely sets go: a class with more than f(a) shingles that no other class has can't be linked. This is
   counted over a fixed quarter of the hash space first, and over all shingles of what is left.
3. Shingles are ordered by how many classes have them, rare ones first. Linked sets share c shingles of the
   f(a) + c first ones. Small sets (light) enumerate the 2-subsets of their f(a) + 2 first shingles, large
   ones (heavy) scan the inverted lists of their f(a) + 1 first ones; the boundary is the size at which
   both together cost least by counts taken from the data.
4. A list isn't expanded into pairs: its members are compared with one pivot. Members linked to it are one
   component. Where a pivot's members are in several components, a member is described by its difference to
   the pivot: D(A) = A ^ P, and |A ^ B| = |D(A) ^ D(B)|. A pair that isn't joined through the pivot has to
   share one of the K + 1 first shingles of its differences, and one of the K / 2 + 1 first ones of the
   smaller of both, rare ones of the pivot's group first. In a group of copies with changes of their own these
   lists are few and short, however large the group is.
5. A list of differences that still spans several components gets one pivot, then 16, 256 and so on, which
   leave it after they have been compared with its members; until no list spans two components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, cut_into, drop, fresh_name, marked, table, text_or_empty

#: Bytes of text that are hashed together, and tokens that a bucket of the uniqueness count holds on average.
PART_BYTES, BUCKET_TOKENS = 500_000, 700_000
#: Share of the hash space of the first count, as a number of top bits: a quarter.
FIRST_BITS = 2
#: Set sizes that may be the boundary of light and heavy sets.
BOUNDARIES = (0, 4, 8, 12, 16, 20, 24, 32, 40, 48, 64, 96, 128, 192, 256)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, extended when a longer part comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)], dtype=np.uint64)


POWERS = Powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words between `offsets` of `data` (from 0 on), and the first word of every text."""
    n = len(data)
    POWERS.reach(n + 1)
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & (~np.r_[False, word[:-1]] | edge[:n]))
    ends = np.flatnonzero(word & (~np.r_[word[1:], False] | edge[1:])) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * POWERS.up[:n], dtype=np.uint64, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * POWERS.down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets)


def long_word_hashes(data: np.ndarray) -> np.ndarray:
    """word_hashes() of one text longer than PART_BYTES, in slices that end at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(at + PART_BYTES, len(data))
        while end < len(data) and not (space := _SPACE[data[end : end + PART_BYTES]]).any():
            end = min(end + PART_BYTES, len(data))  # a word of such a length is hashed whole
        if end < len(data):
            end += int(space.argmax())
        out.append(word_hashes(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text between `offsets`, whole texts with white space as in
    [\\x20\\x09-\\x0D] and A-Z lower-cased; a text with fewer than k words is one shingle."""
    base, data = int(offsets[0]), data[offsets[0] : offsets[-1]]
    offsets = (offsets - base).astype(np.int64)
    if len(data) == 0:
        return [np.empty(0, np.uint64)] * (len(offsets) - 1)
    if len(offsets) == 2 and len(data) > PART_BYTES:
        hashes = long_word_hashes(data)
        first = np.array([0, len(hashes)])
    else:
        hashes, first = word_hashes(data, offsets)
    grams = hashes[: max(0, len(hashes) - k + 1)].copy()
    for j in range(1, k):
        grams = mix(grams * _BASE + hashes[j : j + len(grams)])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            g = np.sort(grams[a : b - k + 1])
            out.append(g[np.r_[True, g[1:] != g[:-1]]])
        elif b > a:
            whole = hashes[a : a + 1]
            for j in range(a + 1, b):
                whole = mix(whole * _BASE + hashes[j : j + 1])
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def parts(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, data, offsets) of slices of a text column of about PART_BYTES."""
    text = column.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PART_BYTES, "right")) - 1)
        end = min(end, len(text))
        yield at, data, offsets[at : end + 1]
        at = end


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, id (of the set), n (its size) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes = [], []
            for _, data, offsets in parts(b.column("text")):
                for s in shingle_sets(data, offsets, k):
                    ids.append(set_id(s))
                    sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64())], ["doc_id", "text_hash", "id", "n"])

    return docs.mapInArrow(work, f"doc_id {kind}, text_hash long, id long, n long")


def lonely_counts(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """id, lonely: shingles in the first share of the hash space that no other set has, per set.

    A task combines its batch first: of a shingle that several sets have it sends one entry, marked as
    shared, so a shingle of a third of all texts is sent once per batch. Buckets hold shingles, shares hold
    sets; both have as many entries as fit in a task, and counts go from the ones to the others packed."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, owners, seen = [], [], set()
            for _, data, offsets in parts(b.column("text")):
                for s in shingle_sets(data, offsets, k):
                    owner = set_id(s)
                    if owner in seen:
                        continue
                    seen.add(owner)
                    low = s[: np.searchsorted(s, np.uint64(1 << 64 - FIRST_BITS))]
                    tokens.append(low)
                    owners.append(np.full(len(low), owner, np.int64))
            token, owner = (np.concatenate(x) if x else np.empty(0, d) for x, d in ((tokens, np.uint64), (owners, np.int64)))
            if not len(token):
                continue
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            head = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
            shared = np.diff(np.r_[head, len(token)]) > 1  # within a batch every set comes once
            token, owner = token[head], owner[head]
            bucket = (mix(token) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(order[a:z], i) for i, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)) if z > a]
            blob = lambda x, rows=rows: pa.array([x[o].tobytes() for o, _ in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([i for _, i in rows], pa.int64()), blob(token), blob(owner), blob(shared)], ["bucket", "tokens", "owners", "shared"])

    def count(group: pa.Table) -> pa.Table:
        token, owner, shared = (np.frombuffer(b"".join(group.column(c).to_pylist()), d) for c, d in (("tokens", np.uint64), ("owners", np.int64), ("shared", bool)))
        order = np.argsort(token)
        token, owner, shared = token[order], owner[order], shared[order]
        head = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        alone = ~np.logical_or.reduceat(shared, head) & (np.minimum.reduceat(owner, head) == np.maximum.reduceat(owner, head))
        ids, counts = np.unique(owner[head[alone]], return_counts=True)
        share = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(share, kind="stable")
        at = np.searchsorted(share[order], np.arange(buckets + 1))
        rows = [(order[a:z], i) for i, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)) if z > a]
        blob = lambda x: pa.array([x[o].tobytes() for o, _ in rows], pa.binary())
        return pa.table({"share": pa.array([i for _, i in rows], pa.int64()), "ids": blob(ids), "counts": blob(counts.astype(np.uint32))})

    def add_up(group: pa.Table) -> pa.Table:
        ids, counts = (np.frombuffer(b"".join(group.column(c).to_pylist()), d) for c, d in (("ids", np.int64), ("counts", np.uint32)))
        ids, back = np.unique(ids, return_inverse=True)
        return pa.table({"id": ids, "lonely": np.bincount(back, counts, len(ids)).astype(np.int64)})

    sent = docs.mapInArrow(send, "bucket long, tokens binary, owners binary, shared binary")
    counted = sent.groupBy("bucket").applyInArrow(count, "share long, ids binary, counts binary")
    return counted.groupBy("share").applyInArrow(add_up, "id long, lonely long")


def token_rows(docs: DataFrame, k: int) -> DataFrame:
    """id, n, tokens (sorted, as longs) for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, data, offsets in parts(b.column("text")):
                sets = shingle_sets(data, offsets, k)
                at = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
                tokens = pa.ListArray.from_arrays(at, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(list(map(set_id, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int64()), tokens], ["id", "n", "tokens"])

    return docs.select("text").mapInArrow(work, "id long, n long, tokens array<bigint>")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (least id that links reach) of every vertex; edges: a, b with both in `vertices`.

    Labels take the least label around them and then their label's label, so that long chains halve in each
    round. Every round is checkpointed. The number of labels is known from the first round on, so each
    checkpoint has as many files as its rows need, and not one for every shuffle partition."""
    edges = edges.select("a", "b").where("a != b")
    n = edges.count()
    if not n:
        return vertices.select("id", F.col("id").alias("component"))
    both = cut_into(edges.union(edges.select(F.col("b"), F.col("a"))).distinct(), 2 * n)
    labels = cut_into(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), F.lit(None).cast("long").alias("old"), "label"), 2 * n)
    size = labels.count()
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("around"))
        stepped = labels.join(around.withColumnRenamed("a", "id"), "id").select("id", F.col("label").alias("old"), F.least("label", "around").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("label").alias("further"))
        labels = cut_into(stepped.join(jump, "new", "left").select("id", "old", F.least("new", F.coalesce("further", "new")).alias("label")), size, labels)
        if labels.where("old != label").isEmpty():
            break
    drop(both)
    return vertices.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component"))


class Join:
    """The join of `sets` (id, n, tokens), whose links are |A & B| * den >= num * |A | B|."""

    def __init__(self, sets: DataFrame, num: int, den: int):
        self.sets, self.num, self.den = sets, num, den

    def spare(self, n: Column) -> Column:
        """f(n): shingles that a linked set may lack."""
        return n - F.ceil(n * self.num / F.lit(self.den))

    def prefixes(self) -> DataFrame:
        """id, n, alone (shingles that no other set has), common: the others as (df, token), rare ones first,
        cut to the f(n) + 2 first of all; sets with more than f(n) lonely shingles are gone.

        The counts are written first, so that the join with them has an exchange on both sides: a shingle of a
        third of all sets is a skewed key then, which AQE splits. Shingles go to their sets as rows: the
        more parts there are, the fewer of a set meet in one, and short lists take more than rows."""
        rows = self.sets.select("id", F.explode("tokens").alias("token"))
        df = cut(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
        common = rows.join(df, "token").repartition("id").groupBy("id").agg(F.collect_list(F.struct("df", "token")).alias("common")).join(self.sets.select("id", "n"), "id")
        alone = F.col("n") - F.size("common")
        kept = common.withColumn("alone", alone).where(alone <= self.spare(F.col("n")))
        return kept.withColumn("common", F.slice(F.array_sort("common"), 1, (self.spare(F.col("n")) + 2 - F.col("alone")).cast("int")))

    def boundary(self, prefixes: DataFrame) -> int:
        """The set size up to which enumerating 2-subsets, and scanning lists beyond, costs least: entries that
        are written, and for a scanned list the comparison of each member with the pivot."""
        m = F.size("common")
        light, heavy = m * (m - 1) / 2, 2 * m
        costs = prefixes.agg(*[F.sum(F.when(F.col("n") <= x, light).otherwise(heavy)).alias(f"c{x}") for x in BOUNDARIES]).first()
        return min(BOUNDARIES, key=lambda x: (costs[f"c{x}"] or 0, x))

    def lists(self, prefixes: DataFrame, boundary: int) -> DataFrame:
        """key, id, n, weight: members of the lists of 2-subsets and of single shingles. Light sets that may be
        linked to a heavy one are on both. weight: how common a set's first shingles are."""
        rows = prefixes.withColumn("weight", F.aggregate("common", F.lit(0).cast("bigint"), lambda s, x: s + x["df"]))
        light = rows.where(F.col("n") <= boundary)
        pairs = F.flatten(F.transform("common", lambda x, i: F.transform(F.slice("common", i + 2, F.size("common")), lambda y: F.xxhash64(F.least(x["token"], y["token"]), F.greatest(x["token"], y["token"])))))
        # Below a similarity of one half two small sets may be linked by a single shingle, which no 2-subset holds.
        tiny = F.col("n") * self.num <= self.den if 2 * self.num <= self.den else F.lit(False)
        heavy = rows.where((F.col("n") * self.den >= boundary * self.num) | tiny)
        single = F.slice("common", 1, F.greatest(F.lit(0), self.spare(F.col("n")) + 1 - F.col("alone")).cast("int"))
        pick = lambda df, keys, tag: df.select(F.lit(tag).alias("kind"), F.explode(keys).alias("key"), "id", "n", "weight")
        return pick(light, pairs, 2).union(pick(heavy, F.transform(single, lambda x: x["token"]), 1))

    def pivots(self, lists: DataFrame, keys: list[str]) -> DataFrame:
        """Distinct (a, p) of every list with several members: p is the member of most weight. Pivots are written, so
        that a list of a third of all members is a skewed key which AQE splits."""
        best = lists.groupBy(*keys).agg(F.max(F.struct("weight", "id")).alias("best"), F.min("id").alias("low"), F.max("id").alias("high"))
        best = cut(best.where("low != high").select(*keys, F.col("best.id").alias("pivot")))
        return lists.join(best, keys).where("id != pivot").select(F.col("id").alias("a"), F.col("pivot").alias("p")).distinct()

    def compared(self, pairs: DataFrame) -> DataFrame:
        """a, p, linked of every pair (a, p), by the exact overlap."""
        num, den = self.num, self.den

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                linked = []
                for x, y in zip(arrays(b.column("of_a")), arrays(b.column("of_p")), strict=True):
                    both = overlap(x, y)
                    linked.append(both * den >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("p"), pa.array(linked, pa.bool_())], ["a", "p", "linked"])

        return self.with_sets(pairs, ["a", "p"]).mapInArrow(work, "a long, p long, linked boolean")

    def needed(self, ids: DataFrame) -> DataFrame:
        """id, tokens of the sets of `ids` (one column) and of few others: all that moves for a join with them."""
        return marked(self.sets.select("id", "tokens"), F.xxhash64("id"), ids.select(F.xxhash64(ids.columns[0]).alias("key")), "needed").where("needed").drop("needed")

    def with_sets(self, pairs: DataFrame, columns: list[str]) -> DataFrame:
        """`columns` of `pairs`, a result of cut(), and the shingles of both sides."""
        own = self.needed(pairs.select("a").union(pairs.select("p")))
        for c in ("a", "p"):
            pairs = pairs.join(own.select(F.col("id").alias(c), F.col("tokens").alias(f"of_{c}")), c)
        return pairs.select(*columns, "of_a", "of_p")

    def differences(self, pairs: DataFrame) -> DataFrame:
        """p, id, n, size, token: the differences D of sets to their pivot, a row for each shingle; `size` is that of D."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [np.setxor1d(x, y, True) for x, y in zip(arrays(b.column("of_a")), arrays(b.column("of_p")), strict=True)]
                n = np.diff(b.column("of_a").offsets.to_numpy())
                size = np.array([len(d) for d in found])
                each = lambda x: pa.array(np.repeat(np.asarray(x, np.int64), size))
                tokens = pa.array(np.concatenate([np.empty(0, np.int64), *found]))
                yield pa.RecordBatch.from_arrays([each(b.column("p").to_numpy()), each(b.column("a").to_numpy()), each(n), each(size), tokens], ["p", "id", "n", "size", "token"])

        return self.with_sets(pairs, ["a", "p"]).mapInArrow(work, "p long, id long, n long, size long, token long")

    def most(self, n: str) -> Column:
        """The symmetric difference that a set linked with one of size `n` may have to it."""
        return F.expr(f"{n} * {self.den - self.num} div {self.num}")

    def difference_lists(self, pairs: DataFrame) -> DataFrame:
        """p, token, id, n, size, pos: lists of the first most + 1 shingles of differences to a pivot, rare ones of
        the pivot's group first; those that no other difference has stand before all and only count."""
        rows = cut(self.differences(pairs))
        df = cut(rows.groupBy("p", "token").agg(F.count("*").alias("df")).where("df > 1"))
        common = rows.join(df, ["p", "token"]).groupBy("p", "id").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.collect_list(F.struct("df", "token")).alias("common"))
        alone = F.col("size") - F.size("common")
        first = F.slice(F.array_sort("common"), 1, (self.most("n") + 1 - alone).cast("int"))
        kept = common.where(alone <= self.most("n")).select("p", "id", "n", "size", alone.alias("alone"), F.posexplode(first))
        return kept.select("p", "col.token", "id", "n", "size", (F.col("pos") + F.col("alone")).alias("pos"))

    def unresolved(self, lists: DataFrame, keys: list[str], of: DataFrame) -> DataFrame:
        """Rows of `lists`, with their components, of lists whose members are in several components."""
        labelled = lists.join(of, "id")
        open_ = labelled.groupBy(*keys).agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select(*keys)
        return labelled.join(open_, keys)

    def met(self, lists: DataFrame, ways: int) -> tuple[DataFrame, DataFrame]:
        """Distinct (a, p) of members in several components that may be linked, one of which is a pivot of their
        list; and the rows of `lists` without the pivots. A list has as many pivots as `ways`, by shares of its ids.

        The first list that a linked pair shares stands in the first half of the smaller difference, and leaves
        behind it as many shingles in both as the pair still has to share."""
        num, den = self.num, self.den
        keys, own = ["p", "token"], ["id", "n", "size", "pos", "component"]
        chosen = lists.withColumn("way", F.pmod(F.xxhash64("id"), F.lit(ways))).groupBy(*keys, "way").agg(F.max(F.struct(-F.col("size"), *own)).alias("m"))
        pivots = chosen.select(*keys, *[F.col(f"m.{c}").alias(f"{c}_b") for c in own])
        x = lists.join(pivots, keys).where(F.col("component") != F.col("component_b"))
        x = x.where(((F.col("size") <= F.col("size_b")) & (2 * F.col("pos") <= self.most("n"))) | ((F.col("size_b") <= F.col("size")) & (2 * F.col("pos_b") <= self.most("n_b"))))
        x = x.where(F.least("n", "n_b") * den >= F.greatest("n", "n_b") * num)
        left = F.least(F.col("size") - F.col("pos"), F.col("size_b") - F.col("pos_b"))
        x = x.where((F.col("size") + F.col("size_b") - 2 * left) * (den + num) <= (F.col("n") + F.col("n_b")) * (den - num))
        pairs = x.select(F.least("id", "id_b").alias("a"), F.greatest("id", "id_b").alias("p")).distinct()
        return pairs, lists.join(pivots.select(*keys, F.col("id_b").alias("id")), [*keys, "id"], "left_anti").drop("component")

    def links(self) -> DataFrame:
        """(id, component) of the sets that have a prefix; all others are linked with nothing."""
        prefixes = cut(self.prefixes())
        vertices = cut(prefixes.select("id"))
        size = vertices.count()
        lists = cut(self.lists(prefixes, self.boundary(prefixes)), prefixes)
        pairs = cut(self.pivots(lists, ["kind", "key"]), lists)
        starred = cut(self.compared(pairs), pairs)
        edges = starred.where("linked").select("a", "p")
        of = cut_into(components(vertices, edges.toDF("a", "b")), size)

        group = starred.select(F.col("a").alias("id"), "p").union(starred.select(F.col("p").alias("id"), "p").distinct())
        apart = cut(self.unresolved(group, ["p"], of).where("id != p").select(F.col("id").alias("a"), "p"))
        if apart.isEmpty():
            return of
        open_ = cut(self.unresolved(self.difference_lists(apart), ["p", "token"], of))
        ids = cut(open_.select("id").distinct())
        open_sets, ways = Join(cut(self.needed(ids).join(ids, "id", "left_semi"), ids), self.num, self.den), 1
        seen = starred.select(F.least("a", "p").alias("a"), F.greatest("a", "p").alias("p"))
        while not open_.isEmpty():
            pairs, rest = self.met(open_, ways)
            pairs = cut(pairs.join(seen, ["a", "p"], "left_anti"))
            fresh = cut(open_sets.compared(pairs), pairs)
            seen, ways = seen.union(fresh.select("a", "p")), 16 * ways
            linked = fresh.where("linked").select("a", "p")
            if not linked.isEmpty():
                edges = edges.union(linked)
                of = cut_into(components(vertices, edges.toDF("a", "b")), size, of)
            open_ = cut(self.unresolved(rest, ["p", "token"], of), open_)
        return of


def arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The numpy arrays of a list column of longs."""
    flat, at = column.flatten().to_numpy(), column.offsets.to_numpy()
    at = at - at[0]
    return (flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]))
    return int(np.count_nonzero(both[1:] == both[:-1]))


def told(doc_id: Column) -> Column:
    """An id of any type as text, and a null one as none."""
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def candidate_tokens(rows: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """id, n, tokens, once for every set of `sets` that may be linked with another one."""
    # A set of s shingles can have a partner other than itself only if f(s + 1) >= 1.
    least = next(s for s in range(1, 2 * den) if (s + 1) * num <= s * den or s * num <= (s - 1) * den)
    total = sets.agg(F.sum("n")).first()[0] or 0
    classes = sets.where(F.col("n") >= least).groupBy("id").agg(F.min("n").alias("n"), F.min("text_hash").alias("text_hash"))
    lonely = lonely_counts(rows, k, max(1, math.ceil(total / (1 << FIRST_BITS) / BUCKET_TOKENS)))
    spare = F.col("n") - F.ceil(F.col("n") * num / F.lit(den))
    kept = classes.join(lonely, "id", "left").where(F.coalesce("lonely", F.lit(0)) <= spare)
    one = sets.join(kept.select("id", "text_hash"), ["id", "text_hash"]).groupBy("id", "text_hash").agg(F.min(told(F.col("doc_id"))).alias("of"))
    # Cut here, the files of the count go before texts move; only texts of candidates, and of few others, move.
    one = cut_into(one.select("text_hash", "of"), sets.count())
    key = F.xxhash64("text_hash", "of")
    texts = marked(rows.withColumn("of", told(F.col("doc_id"))), key, one.select(key.alias("key")), "needed").where("needed")
    texts = texts.join(one, ["text_hash", "of"]).dropDuplicates(["text_hash", "of"])
    return token_rows(texts, k)


def labelled_sets(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, id (of the set), n (its size) of every row; and id, component of the sets that may be
    linked. A set without a component, and one without words, is linked with nothing."""
    rows = docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sets = cut(set_rows(rows, k))
    tokens = cut(candidate_tokens(rows, sets, k, num, den))
    of = Join(tokens, num, den).links()
    drop(tokens)
    return sets, of


def named_classes(sets: DataFrame, of: DataFrame, name: Column) -> DataFrame:
    """id, name, rows of every class of equal sets with words: the least `name` and the number of rows of its
    component. Rows are summed up per class and then per component, each before its shuffle, and the names are
    written, so that a hot class or component is a skewed key which AQE splits."""
    classes = sets.where("n > 0").groupBy("id").agg(F.min(name).alias("name"), F.count("*").alias("rows")).join(of, "id", "left")
    classes = cut(classes.withColumn("component", F.coalesce("component", "id")))
    several = cut(classes.groupBy("component").agg(F.min("name").alias("name"), F.sum("rows").alias("rows")).where("rows > 1"))
    return cut(classes.select("id", "component").join(several, "component").select("id", "name", "rows"), classes, several)


def jaccard_classes(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id for every row: a component is what links of
    |A & B| * den >= num * |A | B| reach, and its id the least doc_id in it.

    A null or empty text, or one of white space, has an empty set, is linked with nothing and is its own
    component. Rows of equal sets are one class, repeated rows included; null ids belong to their class
    but never name it (unless it has no other). Ids may be of any type with an order. Texts are whole, of any
    length. An empty table gives an empty result; other columns are ignored."""
    sets, of = labelled_sets(docs, k, num, den)
    names = named_classes(sets, of, F.col("doc_id")).select("id", F.col("name").alias("component_id"))
    return sets.join(names, "id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.col("id").alias("set_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Rows of `docs` without near duplicates: of a component one row stays, that of the least doc_id, nulls last,
    and among equal ids of the least hashes of text and row. Repeated rows are copies like any other; rows
    without words stay all. An empty table gives an empty result; all columns stay, whatever their names.

    A row is told by doc_id and the hash of its text, so an id on several texts loses only those that go. Only
    rows that go or are repeated, and few others, move for that; and of repeated ones one is chosen, summed up before
    the shuffle."""
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    sets, of = labelled_sets(docs, k, num, den)
    first = named_classes(sets, of, key)
    hash_, row = fresh_name(docs, "hash"), fresh_name(docs, "row")
    judged = sets.select("id", key.alias("key")).join(first.select("id", "name"), "id").groupBy("key").agg(F.bool_or(F.col("key") == F.col("name")).alias("stays"), F.count("*").alias("rows"))
    judged = cut(judged.where("NOT stays OR rows > 1").select(F.col("key.doc_id").alias("judged_id"), F.col("key.text_hash").alias("judged_hash"), "stays"), sets, of, first)
    may = fresh_name(docs, "may")
    hashed = docs.withColumn(hash_, F.xxhash64(text_or_empty()))
    hashed = marked(hashed, F.xxhash64("doc_id", F.col(hash_)), judged.select(F.xxhash64("judged_id", "judged_hash").alias("key")), may)
    clear, hashed = hashed.where(~F.col(may)).select(*[F.col(f"`{c}`") for c in docs.columns]), hashed.where(may).alias("d")
    own = [F.col(f"d.`{c}`") for c in docs.columns]

    def same(other: DataFrame) -> Column:
        return F.col("d.doc_id").eqNullSafe(other["judged_id"]) & (F.col(f"d.{hash_}") == other["judged_hash"])

    single = clear.unionByName(hashed.join(judged, same(judged), "left_anti").select(*own))
    repeated = judged.where("stays")
    if repeated.isEmpty():
        return single
    copies = hashed.join(repeated, same(repeated), "left_semi")
    one = copies.groupBy("d.doc_id", f"d.{hash_}").agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias(row))
    return single.unionByName(one.select(*[F.col(row)[c].alias(c) for c in docs.columns]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def brute_force(texts: dict[int, str | None], k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), by comparing all pairs; for tests."""
    import re

    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(upper))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in texts}

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    ids = sorted(texts, key=lambda i: len(sets[i]))
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if len(sets[j]) * num > len(sets[i]) * den:
                break
            both = len(sets[i] & sets[j])
            if both and both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in texts}
