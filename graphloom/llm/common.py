"""What the operators of this package share: reading tables, checkpoints, byte-level text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut, cut_into, drop

__all__ = ["ascii_lower", "cut", "cut_into", "drop", "fresh_name", "marked", "table", "text_or_empty"]

#: Bits that marked() has for a key at least, and the powers of two between which all are: a row of bits, and 8 MB.
BITS_OF_KEY, LEAST_BITS, MOST_BITS = 16, 15, 26
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh_name(df: DataFrame, base: str) -> str:
    """`base` with as many underscores behind it as make it no column of `df`, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"{base}__"
    while name.lower() in taken:
        name += "_"
    return name


def marked(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """`df` with `name`: true where the 64-bit hash `key` is in `keys` (one column of such), and for few of the other rows.

    An exact join of what is marked follows; what is not marked needs none, so wide rows do not move for it. What is
    broadcast are not keys but two bits of each in one of many rows of 32,768 bits, 8 MB at most: beyond 4 million keys
    more of the other rows are marked."""
    bits = 1 << min(MOST_BITS, max(LEAST_BITS, (BITS_OF_KEY * keys.count()).bit_length()))
    row, held = fresh_name(df, "row"), fresh_name(df, "held")

    def place(c: Column, first: int, n: int) -> Column:
        return F.shiftrightunsigned(c, first).bitwiseAND(F.lit(n - 1)).cast("int")

    def holds(at: Column) -> Column:
        byte = F.substring(F.col(held), F.shiftright(at, 3) + 1, F.lit(1))
        return F.substring(F.lpad(F.conv(F.hex(byte), 16, 2), 8, "0"), 8 - at.bitwiseAND(F.lit(7)), F.lit(1)) == "1"

    of, size = F.col(keys.columns[0]), 1 << LEAST_BITS
    spots = keys.select(place(of, 32, bits // size).alias(row), F.explode(F.array(place(of, 0, size).cast("long"), place(of, 16, size).cast("long"))).alias("at"))
    rows = spots.groupBy(row).agg(F.bitmap_construct_agg("at").alias(held))
    found = df.withColumn(row, place(key, 32, bits // size)).join(F.broadcast(rows), row, "left")
    both = holds(place(key, 0, size)) & holds(place(key, 16, size))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(both, F.lit(False)).alias(name))
