"""Views of a graph: degrees, caps, focus, modes, search, neighbourhoods, legends."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.catalog import EDGE_TYPES
from graphloom.operators.build import intact_edges
from graphloom.operators.lineage import cut, drop

COMPOUND = ("namespace", "dir")


def edge_registry(df: DataFrame, types: Sequence[tuple[str, str, tuple[str, ...]]] = EDGE_TYPES) -> DataFrame:
    """type, family, mode: a row for every mode of an edge type. A fixed dimension of a few dozen rows."""
    return df.sparkSession.createDataFrame([(t, f, m) for t, f, modes in types for m in modes], "type string, family string, mode string")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with degree: incoming and outgoing edges; a loop counts twice."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def leaves(nodes: DataFrame, hide_library: bool = False) -> DataFrame:
    """Nodes that aren't groups, without library nodes if asked."""
    kept = nodes.where(~F.col("type").isin(*COMPOUND))
    return kept.where(~F.col("is_library")) if hide_library else kept


def capped(nodes: DataFrame, edges: DataFrame, cap: int = 1500) -> tuple[DataFrame, DataFrame]:
    """Own nodes, and library nodes by degree up to `cap` nodes in all; edges with both ends kept."""
    own, library = nodes.where(~F.col("is_library")), degrees(nodes.where("is_library"), edges)
    room = max(0, cap - own.count())
    kept = cut(own.unionByName(library.orderBy(F.desc("degree"), "id").limit(room).select(*nodes.columns)))
    return kept, intact_edges(kept, edges)


def focus_seeds(nodes: DataFrame, edges: DataFrame, main_file: str | None = None, seeds: int = 40) -> DataFrame:
    """id: nodes of the main file, and the `seeds` nodes of highest degree."""
    top = degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(seeds).select("id")
    return top.union(nodes.where(F.col("file").endswith(main_file)).select("id")).distinct() if main_file else top


def focus(nodes: DataFrame, edges: DataFrame, main_file: str | None = None, seeds: int = 40, cap: int = 100, hide_library: bool = False) -> tuple[DataFrame, DataFrame]:
    """Seeds and their neighbours by degree up to `cap` nodes, with primary; and the edges among them.

    Edges and degrees are worked out once and read from tables."""
    shown = leaves(nodes, hide_library)
    edges = cut(edges, fine=True)
    shown = cut(degrees(shown, edges), fine=True)
    top = shown.orderBy(F.desc("degree"), "id").limit(seeds).select("id")
    first = cut(top.union(shown.where(F.col("file").endswith(main_file)).select("id")).distinct() if main_file else top)
    around = edges.join(first.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("target").alias("id"))
    around = around.union(edges.join(first.withColumnRenamed("id", "target"), "target", "left_semi").select(F.col("source").alias("id"))).distinct()
    outer = shown.join(around, "id", "left_semi").join(first, "id", "left_anti")
    room = max(0, cap - first.count())  # a number of at most the seeds and the nodes of one file
    more = outer.orderBy(F.desc("degree"), "id").limit(room).select("id", F.lit(False).alias("primary"))
    kept = cut(shown.drop("degree").join(first.withColumn("primary", F.lit(True)).union(more), "id"))
    found = intact_edges(kept, edges)
    drop(edges, shown, first)
    return kept, found


def mode_edges(edges: DataFrame, mode: str, registry: DataFrame) -> DataFrame:
    """Edges that a view mode shows; `all` shows every edge."""
    if mode == "all":
        return edges
    return edges.join(F.broadcast(registry.where(F.col("mode") == mode).select("type")), "type", "left_semi").select(*edges.columns)


def mode_counts(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """mode, n: edges that each view mode shows."""
    return edges.groupBy("type").count().join(F.broadcast(registry), "type").groupBy("mode").agg(F.sum("count").alias("n"))


def legend(edges: DataFrame, registry: DataFrame) -> DataFrame:
    """family, type, n of the known edge types."""
    return edges.groupBy("type").agg(F.count("*").alias("n")).join(F.broadcast(registry.select("type", "family").distinct()), "type").select("family", "type", "n")


def unlinked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge; groups never count as such."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"))
    return nodes.where(~F.col("type").isin(*COMPOUND)).join(ends, "id", "left_anti")


def matches(query: str, types: Iterable[str] | None = None, hide_library: bool = False) -> Column:
    """Whether a node's label (or id) contains the query in any case, among active types."""
    found = F.contains(F.lower(F.coalesce("label", "id")), F.lit(query.lower()))
    if types is not None:
        found = found & F.col("type").isin(*types)
    return found & ~F.col("is_library") if hide_library else found


def match_counts(nodes: DataFrame, rendered: DataFrame, query: str) -> DataFrame:
    """n_all, n_rendered: nodes that match in the graph and among the rendered ones."""
    shown = nodes.join(rendered.select("id").withColumn("shown", F.lit(True)), "id", "left")
    return shown.agg(F.count_if(matches(query)).alias("n_all"), F.count_if(matches(query) & F.col("shown").isNotNull()).alias("n_rendered"))


def connections(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """direction, type, other, label: edges of one node; a label falls back to the id."""
    out = edges.where(F.col("source") == node).select(F.lit("out").alias("direction"), "type", F.col("target").alias("other"))
    into = edges.where(F.col("target") == node).select(F.lit("in").alias("direction"), "type", F.col("source").alias("other"))
    names = nodes.select(F.col("id").alias("other"), "label")
    return out.union(into).join(names, "other", "left").select("direction", "type", "other", F.coalesce("label", "other").alias("label"))


def neighbourhood(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """A node and all that one edge joins it to."""
    near = edges.where((F.col("source") == node) | (F.col("target") == node)).select(F.explode(F.array("source", "target")).alias("id"))
    return nodes.join(near, "id", "left_semi")


def density(nodes: DataFrame, edges: DataFrame, focused: bool = False) -> DataFrame:
    """n_nodes, n_edges, density, layout of a graph."""
    n, e = nodes.agg(F.count("*").alias("n_nodes")), edges.agg(F.count("*").alias("n_edges"))
    share = F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1) / 2)).otherwise(F.col("n_edges").cast("double"))
    layout = F.when(F.col("n_nodes") > 1000, "grid").when((F.col("n_nodes") > 300) | F.lit(focused) | (F.col("density") < 0.08), "fcose").otherwise("dagre")
    return n.crossJoin(e).withColumn("density", F.round(share, 9)).withColumn("layout", layout)  # one row each


def first_labels(nodes: DataFrame) -> DataFrame:
    """label, seq: distinct labels with the first place they are seen."""
    return nodes.groupBy("label").agg(F.min("seq").alias("seq"))


def top_connections(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """id, nth, text: the first edges out of each node, as text."""
    w = Window.partitionBy("source").orderBy("type", "target")
    first = edges.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most)
    names = nodes.select(F.col("id").alias("target"), F.col("label").alias("name"))
    return first.join(names, "target", "left").select(F.col("source").alias("id"), "nth", F.concat_ws(" ", "type", F.coalesce("name", "target")).alias("text"))


def edge_index(edges: DataFrame) -> DataFrame:
    """id, type, n_in, n_out, n: edges by type at both of their ends."""
    out = edges.select(F.col("source").alias("id"), "type", F.lit(0).alias("i"), F.lit(1).alias("o"))
    into = edges.select(F.col("target").alias("id"), "type", F.lit(1).alias("i"), F.lit(0).alias("o"))
    return out.union(into).groupBy("id", "type").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"), F.count("*").alias("n"))


def type_counts(nodes: DataFrame) -> DataFrame:
    """type, n, first_id."""
    return nodes.groupBy("type").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
