"""Sinks: nodes and edges as nested JSON documents, and as Parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.lineage import numbered


def node_document(columns: list[str]) -> Column:
    """{"data": {...}} of a node with `columns`; null fields stay, but a null parent goes."""
    fields = [c for c in columns if c != "parent"]
    whole = F.to_json(F.struct(F.struct(*fields).alias("data")), {"ignoreNullFields": "false"})
    if "parent" in columns:
        led = F.to_json(F.struct(F.struct(*fields, "parent").alias("data")), {"ignoreNullFields": "false"})
        whole = F.when(F.col("parent").isNull(), whole).otherwise(led)
    return F.make_valid_utf8(whole)


def edge_document(columns: list[str | Column]) -> Column:
    """{"data": {...}} of an edge with `columns`, without null fields."""
    return F.to_json(F.struct(F.struct(*columns).alias("data")))


def node_documents(nodes: DataFrame) -> DataFrame:
    """id, document: {"data": {...}} per node; null fields stay, but a null parent goes."""
    return nodes.select("id", node_document(nodes.columns).alias("document"))


def edge_documents(edges: DataFrame) -> DataFrame:
    """id, document: {"data": {...}} per edge, without null fields."""
    return edges.select("id", edge_document(edges.columns).alias("document"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet tables `nodes` and `edges` and JSON lines of documents, each written by all tasks."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")
    node_documents(nodes).select("document").write.mode("overwrite").text(f"{path}/node_documents")
    edge_documents(edges).select("document").write.mode("overwrite").text(f"{path}/edge_documents")


def document(plugin: DataFrame, nodes: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """One row, document: {plugin, nodes, edges, cycles}, compound nodes first, in the order of seq. Keys of the
    metadata stay with null; an edge's null fields, and a node's null parent, go.

    The document is one value, so this is for graphs that one reader takes whole; write_graph() has no such limit."""
    listed = lambda df, value, order: df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("text")))), lambda x: x["text"]), ",").alias("text"))
    ordered = nodes.select("seq", "id").join(node_documents(nodes.drop("seq")), "id")
    parts = listed(ordered, "document", ["seq", "id"]).withColumnRenamed("text", "n")
    parts = parts.crossJoin(listed(edges.select("seq", "id").join(edge_documents(edges.drop("seq")), "id"), "document", ["seq", "id"]).withColumnRenamed("text", "e"))
    parts = parts.crossJoin(listed(cycles.select("component", "nth", F.to_json("path").alias("path")), "path", ["component", "nth"]).withColumnRenamed("text", "c"))
    told = plugin.agg(F.first(F.to_json(F.struct(*plugin.columns), {"ignoreNullFields": "false"})).alias("p"))
    return parts.crossJoin(told).select(F.concat(F.lit('{"plugin":'), F.coalesce("p", F.lit("{}")), F.lit(',"nodes":['), "n", F.lit('],"edges":['), "e", F.lit('],"cycles":['), "c", F.lit("]}")).alias("document"))


def document_lines(plugin: DataFrame, nodes: DataFrame, edges: DataFrame, cycles: DataFrame, order: tuple[list[str], list[str]] = (["seq", "id"], ["seq", "id"]), edge_id: Column | None = None) -> DataFrame:
    """section, n, text: the lines of document(), so that all texts by section and n, one after the other, are the JSON.

    Nodes and edges are in the two `order`s; `edge_id` is the id of edges that have no such column. What moves and is
    written is a row's columns; texts and `edge_id` are worked out when lines are read. Only the sizes of partitions
    are summed up in one place; no task holds more than its own lines."""
    spark = plugin.sparkSession
    told = plugin.agg(F.first(F.to_json(F.struct(*plugin.columns), {"ignoreNullFields": "false"})).alias("p"))
    head = told.select(F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("n"), F.concat(F.lit('{"plugin":'), F.coalesce("p", F.lit("{}")), F.lit(',"nodes":[')).alias("text"))
    between = spark.createDataFrame([(2, 0, '],"edges":['), (4, 0, '],"cycles":['), (6, 0, "]}")], "section int, n long, text string")

    def listed(rows: DataFrame, order: list[str], section: int, text: Column) -> DataFrame:
        placed = numbered(rows, order, "n__")
        return placed.select(F.lit(section).alias("section"), F.col("n__").alias("n"), F.concat(F.when(F.col("n__") > 0, ",").otherwise(""), text).alias("text"))

    shown = listed(nodes, order[0], 1, node_document(nodes.drop("seq").columns))
    joined = listed(edges, order[1], 3, edge_document([*([] if edge_id is None else [edge_id.alias("id")]), *edges.drop("seq").columns]))
    rings = listed(cycles.select("component", "nth", "path"), ["component", "nth"], 5, F.to_json("path"))
    return head.union(between).union(shown).union(joined).union(rings)


def write_document(lines: DataFrame, path: str) -> None:
    """document_lines() as text files, whose concatenation in the order of their names is the JSON document."""
    placed = lines.repartitionByRange("section", "n").sortWithinPartitions("section", "n")
    placed.select("text").write.mode("overwrite").text(path)
