"""A source tree as a graph, end to end: scan, extract, build, link, annotate, describe, find cycles, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import catalog
from graphloom.functions.text import capability, count_calls, doc_summary, is_js_file, verifies_nonce
from graphloom.operators import algorithms, build, describe, export, views, xref
from graphloom.operators.lineage import cut
from graphloom.sources import blocks, js, php, tree

#: Files of one kind whose places in seq are apart from those of the next.
FILES_OF_A_KIND = 1 << 27


@dataclass
class Graph:
    """plugin: one row. nodes: with metadata, description, is_library, parent, compound nodes first by seq. edges: with
    id. cycles: component, nth, path. errors: path, line, error of files that can't be read."""

    plugin: DataFrame
    nodes: DataFrame
    edges: DataFrame
    cycles: DataFrame
    errors: DataFrame


def extract(files: DataFrame, root: str = "/plugin") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw nodes and edges of analysed files (path, content, kind): blocks first, then scripts, then PHP; and the errors."""
    of = lambda kind: files.where(F.col("kind") == kind).select("path", "content")
    most = files.groupBy("kind").count().agg(F.max("count")).first()[0] or 0
    if most > FILES_OF_A_KIND:
        raise ValueError(f"{most} files of a kind; their order holds for {FILES_OF_A_KIND}")
    parts = [blocks.entities(of("block"), root), js.entities_and_errors(of("js"), files.select("path"), root, FILES_OF_A_KIND), php.entities_and_errors(of("php"), root, 2 * FILES_OF_A_KIND)]
    nodes, edges = ([p[i] for p in parts] for i in (0, 1))
    return nodes[0].unionByName(nodes[1]).unionByName(nodes[2]), edges[0].unionByName(edges[1]).unionByName(edges[2]), parts[1][2].union(parts[2][2])


def linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`edges` and those across languages, which come last: calls to endpoints and AJAX actions, blocks of one name."""
    first = build.first_nodes(nodes).select("id", "seq", "type", "file", F.col("metadata.route").alias("route"), F.col("metadata.hook_name").alias("hook_name"), F.col("metadata.block_name").alias("name"))
    of = lambda *t: first.where(F.col("type").isin(*t))
    script = is_js_file(F.col("file"))
    ends = xref.match_endpoints(of("js_api_call"), of("rest_endpoint")).select("id", F.col("endpoint").alias("target"), F.lit("calls_endpoint").alias("type"), F.lit("REST").alias("label"), F.lit(0).alias("way"))
    actions = xref.match_actions(of("fetch_call", "axios_call"), of("ajax_handler")).select("id", F.col("handler").alias("target"), F.lit("calls_ajax_handler").alias("type"), F.lit("AJAX").alias("label"), F.lit(1).alias("way"))
    names = xref.match_names(of("gutenberg_block").where(script), of("gutenberg_block").where(~script)).select("id", F.col("match").alias("target"), F.lit("js_block_matches_php").alias("type"), F.lit("block").alias("label"), F.lit(2).alias("way"))
    found = ends.union(actions).union(names).join(first.select("id", "seq"), "id")
    place = F.lit(3 * FILES_OF_A_KIND).cast("bigint") * (1 << 32) + F.shiftleft(F.col("way").cast("bigint"), 61) + F.col("seq")
    more = found.select(F.col("id").alias("source"), "target", "type", "label", place.cast("bigint").alias("seq"), F.lit(None).cast(edges.schema["metadata"].dataType).alias("metadata"))
    return edges.unionByName(more)


def secured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes whose metadata tells what functions check, and endpoints what the functions that register them do."""
    text = F.col("source_preview")
    scanned = F.col("type").isin("function", "method") & (text != "")
    told = F.col("metadata").withField("capability", F.when(scanned, F.coalesce(capability(text), F.col("metadata.capability"))).otherwise(F.col("metadata.capability")))
    told = told.withField("nonce_verified", F.when(scanned & verifies_nonce(text), True)).withField("sanitization_count", F.when(scanned, F.nullif(count_calls(text).cast("int"), F.lit(0))))
    own = cut(nodes.withColumn("metadata", told))
    m = lambda name: F.col(f"metadata.{name}").alias(name)
    ends = own.where("type IN ('rest_endpoint', 'ajax_handler')").select("id", m("capability"), m("nonce_verified"), m("sanitization_count"))
    register = edges.where("type IN ('registers', 'registers_rest', 'registers_ajax')").select("source", "target", "seq")
    given = xref.propagated(ends, register, own.select("id", m("capability"), m("nonce_verified"), m("sanitization_count")).where("capability IS NOT NULL OR nonce_verified OR sanitization_count > 0"))
    both = own.join(given.select("id", F.struct("capability", "nonce_verified", "sanitization_count").alias("given")), "id", "left")
    field = lambda n: F.when(F.col("given").isNull(), F.col(f"metadata.{n}")).otherwise(F.col(f"given.{n}"))
    changed = F.col("metadata")
    for n in ("capability", "nonce_verified", "sanitization_count"):
        changed = changed.withField(n, field(n))
    return both.withColumn("metadata", changed).select(*nodes.columns)


def grouped(nodes: DataFrame, root: str = "/plugin") -> DataFrame:
    """Nodes with parent, and the compound nodes of groups with two members or more in front (seq below all)."""
    inner = F.regexp_replace(F.replace("file", F.lit(root.rstrip("/")), F.lit("")), "^/+", "")
    folder = F.when(inner.contains("/"), F.regexp_replace(inner, "/[^/]*$", ""))
    keyed = nodes.withColumns({"namespace": F.when(F.col("type").isin(*catalog.PHP_GROUPED), F.col("metadata.namespace")), "directory": F.when(F.col("type").isin(*catalog.JS_GROUPED), folder)})
    groups = cut(xref.grouped_members(keyed))
    void = {f.name: F.lit(None).cast(f.dataType) for f in nodes.schema}
    shown = groups.withColumns({k: v for k, v in void.items() if k != "label"}).withColumns({"id": F.col("group_id"), "type": F.col("kind"), "seq": F.lit(-1).cast("bigint"), "is_library": F.lit(False)}).select(*nodes.columns).withColumn("parent", F.lit(None).cast("string"))
    return shown.unionByName(xref.with_parents(keyed, groups).select(*nodes.columns, "parent"))


def analyze(files: DataFrame, root: str = "/plugin", globs: tuple[str, ...] = (), directory: str | None = None, strict: bool = False) -> Graph:
    """The graph of files (path, content) of a tree that is mounted at `root`.

    Ignored, minified and generated files go first; `strict` reads ignore lines by git's rules. Files with a syntax
    error give no entities and a row of errors. No files give an empty graph."""
    kept = cut(tree.analysed(files, globs, strict))
    nodes, edges, errors = extract(kept, root)
    nodes, edges = build.build_graph(nodes, linked(nodes, edges))
    edges = cut(edges)
    nodes = cut(secured(nodes, edges))
    index = views.edge_index(edges).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("n_edges"))
    at = lambda t: F.try_element_at("n_edges", F.lit(t))
    text = F.coalesce(doc_summary(F.col("docblock")), describe.description(at))
    nodes = nodes.join(index, "id", "left").withColumn("description", text).drop("n_edges")
    structural = edges.where(F.col("type").isin(*catalog.STRUCTURAL_EDGES))
    cycles = algorithms.dfs_cycles(structural, algorithms.weak_components(nodes.select("id"), structural))
    nodes = cut(grouped(nodes, root))
    plugin = tree.main_file(kept, directory or root.rstrip("/").rsplit("/", 1)[-1])
    counts = kept.agg(F.count("*").alias("total_files"), F.count_if(F.col("kind") == "php").alias("php_files"), F.count_if(F.col("kind") == "js").alias("js_files")).crossJoin(nodes.agg(F.count_if(F.col("seq") >= 0).alias("total_entities")))
    plugin = counts.join(plugin.withColumnRenamed("path", "main_file"), F.lit(True), "left")
    return Graph(plugin, nodes, edges, cut(cycles), errors)


def analyze_tree(spark: SparkSession, path: str, root: str = "/plugin") -> Graph:
    """analyze() of the files below `path`, with its ignore files; without a main file, a theme's header names it."""
    graph = analyze(tree.read_tree(spark, path), root, tuple(tree.ignore_lines(spark, path)), path.rstrip("/").rsplit("/", 1)[-1])
    theme = tree.theme_header(spark, path) if graph.plugin.first()["main_file"] is None else {}
    for name, value in theme.items():
        graph.plugin = graph.plugin.withColumn(name, F.lit(value))
    return graph


def export_graph(graph: Graph, path: str) -> None:
    """The graph and its errors as Parquet tables, and the JSON document {plugin, nodes, edges, cycles} as the
    concatenation of the files of path/document by their names."""
    export.write_graph(graph.nodes, graph.edges, path)
    graph.cycles.write.mode("overwrite").parquet(f"{path}/cycles")
    graph.errors.write.mode("overwrite").parquet(f"{path}/errors")
    export.write_document(export.document_lines(graph.plugin, graph.nodes, graph.edges, graph.cycles), f"{path}/document")
