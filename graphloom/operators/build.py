"""From extracted rows to a graph: deduplication, integrity, edge numbers, library tags.

What shuffles whole graphs is written as a table at once, so that a task's share of a shuffle has a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import is_library
from graphloom.operators.lineage import cut, numbered


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: the first by seq."""
    w = Window.partitionBy("id").orderBy("seq")
    return cut(nodes.withColumn("nth__", F.row_number().over(w)).where("nth__ = 1").drop("nth__"), fine=True)


def merged_edges(edges: DataFrame) -> DataFrame:
    """One row per (source, type, target): the content of the last one, at the place of the first."""
    key = ["source", "type", "target"]
    rest = [c for c in edges.columns if c not in (*key, "seq")]
    grouped = edges.groupBy(*key).agg(F.min("seq").alias("seq"), F.max_by(F.struct(*rest), "seq").alias("last"))
    return cut(grouped.select(*[F.col(f"last.{c}") if c in rest else F.col(c) for c in edges.columns]), fine=True)


def intact_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select("id")
    known = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return cut(known.select(*edges.columns), fine=True)


def numbered_edges(edges: DataFrame, order: list[str]) -> DataFrame:
    """Edges with id e_0, e_1, ... by `order`."""
    return numbered(edges, order, "nth__").withColumn("id", F.concat(F.lit("e_"), F.col("nth__").cast("string"))).drop("nth__")


def tagged_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with is_library."""
    return nodes.withColumn("is_library", is_library(F.col("file"), F.col("type"), F.col("label")))


def build_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a graph from raw rows with seq, which may repeat or dangle."""
    kept = tagged_nodes(first_nodes(nodes))
    return kept, numbered_edges(intact_edges(kept, merged_edges(edges)), ["seq"])
