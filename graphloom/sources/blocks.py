"""Entities of block.json files as rows: the block, and the files that it renders and loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import base_name
from graphloom.operators.lineage import cut, numbered
from graphloom.sources.code import edge_rows, lexical, node_rows, packed, plus

#: Keys that name assets, and those of them that name scripts.
ASSETS, SCRIPTS = ("editorScript", "script", "viewScript", "editorStyle", "style"), ("editorScript", "script", "viewScript")
KIND = "name string, title string, category string, description string, render string, attributes string, " + ", ".join(f"{a} string" for a in ASSETS)


def entities(files: DataFrame, root: str = "/plugin", first: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, with seq, of block.json files (path, content) mounted at `root`; invalid and nameless ones go."""
    order = numbered(files.select("path"), ["path"], "file_seq", 1 + first).withColumn("file_seq", F.col("file_seq").cast("int"))
    mount = root.rstrip("/") + "/"
    parsed = F.from_json("content", KIND)
    rows = files.join(order, "path").select("file_seq", "path", F.lit(0).alias("i"), F.lit(0).alias("line"), F.concat(F.lit(mount), "path").alias("file"), parsed.alias("b"), F.get_json_object("content", "$.attributes").alias("attributes")).where("b.name IS NOT NULL")
    rows = cut(rows)
    own = F.concat(F.lit("block_"), "b.name")
    pairs = F.create_map(*[x for a in ASSETS for x in (F.lit(a), F.col(f"b.{a}"))])
    assets = F.map_filter(pairs, lambda _, v: v.isNotNull())
    label = F.coalesce("b.title", "b.name")
    nodes = node_rows(rows, 0, id=own, label=label, type=F.lit("gutenberg_block"), line=F.lit(0), block_name=F.col("b.name"), block_category=F.col("b.category"), block_attributes=F.col("attributes"), render_template=F.col("b.render"), js_assets=F.when(F.size(assets) > 0, assets), namespace=F.split("b.name", "/")[0], docblock=F.col("b.description"))
    named = F.array(F.struct(F.lit("render").alias("key"), F.col("b.render").alias("ref")), *[F.struct(F.lit(a).alias("key"), F.col(f"b.{a}").alias("ref")) for a in SCRIPTS])
    used = rows.select("*", F.posexplode(named).alias("nth", "n")).where("n.ref IS NOT NULL").withColumn("asset", asset_path(F.col("n.ref"), F.col("file")))
    file_id = F.concat(F.lit("file_"), "asset")
    step = 1 + 2 * F.col("nth")
    nodes = plus(nodes, node_rows(used, 0, step, id=file_id, label=base_name(F.col("asset")), type=F.lit("file"), file=F.col("asset"), line=F.lit(0)))
    render = F.col("n.key") == "render"
    return cut(packed(nodes)), cut(edge_rows(used, 0, own, file_id, F.when(render, "renders_block").otherwise("enqueues_script"), F.when(render, "renders").otherwise("enqueues"), step + 1))


def asset_path(ref: Column, block_file: Column) -> Column:
    """A `file:` reference below the block's folder; anything else as it stands."""
    folder = F.substring(block_file, F.lit(1), F.length(block_file) - F.length(base_name(block_file)))
    return F.when(ref.startswith("file:"), F.concat(F.lit("/"), lexical(F.concat(folder, F.regexp_replace(ref, r"^file:[./]*", ""))))).otherwise(ref)
