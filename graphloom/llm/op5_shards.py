"""Sharding by jump consistent hashing, in DataFrame expressions only.

The published loop draws from a 64-bit linear congruential generator. Its product is taken in limbs of
22, 22 and 20 bits, so no intermediate overflows under ANSI arithmetic. The chain of draws does not
depend on the number of shards, so one walk yields the shard for n and for n + 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import table

#: Multiplier and increment of the generator in the published jump hash.
MULTIPLIER, INCREMENT = 2862933555777941757, 1

M22, M20 = (1 << 22) - 1, (1 << 20) - 1
A0, A1, A2 = MULTIPLIER & M22, MULTIPLIER >> 22 & M22, MULTIPLIER >> 44

#: Rows that one window group may hold on average, and groups of a shard at least.
ROWS_PER_GROUP, LEAST_GROUPS = 50_000, 16
#: Offsets are broadcast up to so many rows, and joined by shuffle beyond.
BROADCAST_ROWS = 1_000_000


def _hex(c: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(c, start, length), 16, 10).cast("bigint")


def jump(key_hex: Column, shards: int) -> Column:
    """Struct (shard, grown): the shard of a key for `shards` and for `shards + 1`; the key is 16 hex digits."""
    low = _hex(key_hex, 9, 8)
    high = _hex(key_hex, 1, 8)
    start = F.struct(
        low.bitwiseAND(F.lit(M22)).alias("k0"),
        F.shiftright(low, 22).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(4095)), 10)).alias("k1"),
        F.shiftright(high, 12).alias("k2"),
        F.lit(0).cast("bigint").alias("j"),
        F.lit(0).cast("bigint").alias("shard"),
        F.lit(0).cast("bigint").alias("grown"),
    )

    def step(s: Column, _: Column) -> Column:
        c0 = s["k0"] * F.lit(A0) + F.lit(INCREMENT)
        c1 = F.shiftright(c0, 22) + s["k0"] * F.lit(A1) + s["k1"] * F.lit(A0)
        c2 = F.shiftright(c1, 22) + s["k0"] * F.lit(A2) + s["k1"] * F.lit(A1) + s["k2"] * F.lit(A0)
        r1, r2 = c1.bitwiseAND(F.lit(M22)), c2.bitwiseAND(F.lit(M20))
        draw = F.shiftleft(r2, 11).bitwiseOR(F.shiftright(r1, 11)) + F.lit(1)
        jumped = ((s["j"] + F.lit(1)).cast("double") * (F.lit(float(1 << 31)) / draw.cast("double"))).cast("bigint")
        moved = F.struct(
            c0.bitwiseAND(F.lit(M22)).alias("k0"),
            r1.alias("k1"),
            r2.alias("k2"),
            jumped.alias("j"),
            F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"),
            s["j"].alias("grown"),
        )
        return F.when(s["j"] < shards + 1, moved).otherwise(s)

    steps = F.array_repeat(F.lit(0), shards + 1)  # each draw moves at least one shard on
    return F.aggregate(steps, start, step, lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))


def assign_shards(df: DataFrame, key: str, shards: int) -> DataFrame:
    """`df` with shard, grown_shard (with one shard more) and key_hash. Only the key and the number of
    shards decide, so equal keys meet, and a further shard takes rows only into itself. A null key counts
    as the empty string."""
    h = df.withColumn("key_hash", F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")))
    return h.withColumn("jumped", jump(F.col("key_hash"), shards)).select(*h.columns, F.col("jumped.shard").alias("shard"), F.col("jumped.grown").alias("grown_shard"))


def number_slots(df: DataFrame, shards: int, order: list[str]) -> DataFrame:
    """`df` (with shard and key_hash) with slot: gapless from 0 in each shard, by hash group and then by `order`.

    A shard is cut into hash groups, whose number follows the row count, so no window group grows with the
    data; group sizes are summed up first and give each group its first slot."""
    groups = max(LEAST_GROUPS, math.ceil(df.count() / (shards * ROWS_PER_GROUP)))
    grouped = df.withColumn("slot_group", _hex(F.col("key_hash"), 17, 8) % F.lit(groups))
    counts = grouped.groupBy("shard", "slot_group").count()
    before = Window.partitionBy("shard").orderBy("slot_group").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "slot_group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first_slot"))
    if shards * groups <= BROADCAST_ROWS:
        first = F.broadcast(first)
    within = Window.partitionBy("shard", "slot_group").orderBy(*order)
    ranked = grouped.withColumn("slot_rank", F.row_number().over(within) - 1)
    return ranked.join(first, ["shard", "slot_group"]).withColumn("slot", (F.col("first_slot") + F.col("slot_rank")).cast("bigint"))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    A null text has no bytes: size 16, CRC 0. Equal doc_ids share a shard and take slots of their own; fully
    equal rows take neighbouring slots in any order. An empty table gives an empty result. Other columns of
    `docs` are ignored. Texts are read once for size and CRC; only ids and numbers are shuffled."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(body) + 16).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    placed = number_slots(assign_shards(rows, "doc_id", shards), shards, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), draws(r, k, j, shard, grown) AS (
    SELECT r, ('0x' || h[1:16])::UBIGINT::HUGEINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM docs
    UNION ALL
    SELECT r, nk, floor((j + 1) * (2147483648.0::DOUBLE / (nk // 8589934592 + 1)::DOUBLE))::BIGINT, CASE WHEN j < 40 THEN j ELSE shard END, j
    FROM (SELECT *, (k * {MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS nk FROM draws WHERE j < 41)
), placed AS (
    SELECT r, max(shard) AS shard, max(grown) AS grown FROM draws GROUP BY r
), poly AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) AS s(i))
), sized AS (
    SELECT d.r, doc_id, octet_length(encode(body)) + 16 AS size, h,
        xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(body))), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
            lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS crc
    FROM (SELECT *, hex(encode(body)) AS x FROM docs) d, poly
), grouped AS (
    SELECT *, ('0x' || h[17:24])::BIGINT % greatest({LEAST_GROUPS}, ceil((SELECT count(*) FROM docs) / (40 * {ROWS_PER_GROUP}.0)))::BIGINT AS g FROM sized JOIN placed USING (r)
)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
    (row_number() OVER (PARTITION BY shard ORDER BY g, doc_id NULLS FIRST, crc, size) - 1)::BIGINT AS slot, grown::INTEGER AS grown_shard
FROM grouped
"""
