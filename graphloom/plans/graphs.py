"""Graphs derived from the star tables, with the same expressions in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(df: DataFrame, kind: str, key: str, label: str, library: str = "false") -> DataFrame:
    return df.select(F.concat(F.lit(f"{kind}_"), F.col(key).cast("string")).alias("id"), F.expr(label).alias("label"), F.lit(kind).alias("type"), F.lit(f"{kind}.tbl").alias("file"), F.expr(library).alias("is_library"))


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    parts = [
        _nodes(t("region"), "region", "r_regionkey", "r_name"),
        _nodes(t("nation"), "nation", "n_nationkey", "n_name"),
        _nodes(t("supplier"), "supplier", "s_suppkey", "s_name"),
        _nodes(t("customer"), "customer", "c_custkey", "c_name"),
        _nodes(t("part"), "part", "p_partkey", "p_name", "p_size < 10"),
        _nodes(t("orders"), "order", "o_orderkey", "concat('Order ', o_orderstatus)"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _edges(df: DataFrame, source: str, source_key: str, target: str, target_key: str, kind: str) -> DataFrame:
    return df.select(F.concat(F.lit(f"{source}_"), F.col(source_key).cast("string")).alias("source"), F.concat(F.lit(f"{target}_"), F.col(target_key).cast("string")).alias("target"), F.lit(kind).alias("type"))


def star_edges(spark: SparkSession, sf_dir: str, repeats: bool = False) -> DataFrame:
    """Edges of the star tables, each once; with `repeats` as often as rows of `lineitem` have it, both edges of a row together."""
    t = lambda name: read(spark, sf_dir, name)
    out = _edges(t("nation"), "nation", "n_nationkey", "region", "n_regionkey", "in_region")
    out = out.union(_edges(t("supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "in_nation"))
    out = out.union(_edges(t("customer"), "customer", "c_custkey", "nation", "c_nationkey", "in_nation"))
    out = out.union(_edges(t("orders"), "order", "o_orderkey", "customer", "o_custkey", "placed_by"))
    contains, supplied = ("order", "l_orderkey", "part", "l_partkey", "contains"), ("part", "l_partkey", "supplier", "l_suppkey", "supplied_by")
    if repeats:
        ends = lambda a, k, b, m, kind: F.struct(F.concat(F.lit(f"{a}_"), F.col(k)).alias("source"), F.concat(F.lit(f"{b}_"), F.col(m)).alias("target"), F.lit(kind).alias("type"))
        return out.union(t("lineitem").select(F.inline(F.array(ends(*contains), ends(*supplied)))))
    # Keys are made distinct before they are ids, which are longer.
    pairs = lambda *keys: t("lineitem").select(*keys).distinct()
    out = out.union(_edges(pairs("l_orderkey", "l_partkey"), *contains))
    return out.union(_edges(pairs("l_partkey", "l_suppkey"), *supplied))


def place_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star_nodes(spark, sf_dir).where(F.col("type").isin("region", "nation", "supplier"))


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: read(spark, sf_dir, name)
    out = _edges(t("nation").where("n_regionkey < 3"), "nation", "n_nationkey", "region", "n_regionkey", "in_region")
    return out.union(_edges(t("supplier").where("s_nationkey % 2 = 0"), "supplier", "s_suppkey", "nation", "s_nationkey", "in_nation"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, seq: frequent successions of event types of a user, by rank of their names."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    after = read(spark, sf_dir, "events").select(F.col("event_type").alias("source"), F.lead("event_type").over(w).alias("target")).where("target IS NOT NULL")
    counted = after.groupBy("source", "target").agg(F.count("*").alias("n"))
    mean = counted.groupBy("source").agg(F.avg("n").alias("mean"))
    kept = counted.join(mean, "source").where("n > mean")
    return kept.select("source", "target", F.lit("calls").alias("type"), F.xxhash64("source", "target").alias("seq"))


NODES = """
nodes AS (
    SELECT 'region_' || r_regionkey AS id, r_name AS label, 'region' AS type, 'region.tbl' AS file, false AS is_library FROM region
    UNION ALL SELECT 'nation_' || n_nationkey, n_name, 'nation', 'nation.tbl', false FROM nation
    UNION ALL SELECT 'supplier_' || s_suppkey, s_name, 'supplier', 'supplier.tbl', false FROM supplier
    UNION ALL SELECT 'customer_' || c_custkey, c_name, 'customer', 'customer.tbl', false FROM customer
    UNION ALL SELECT 'part_' || p_partkey, p_name, 'part', 'part.tbl', p_size < 10 FROM part
    UNION ALL SELECT 'order_' || o_orderkey, 'Order ' || o_orderstatus, 'order', 'order.tbl', false FROM orders
)"""
EDGES = """
edges AS (
    SELECT 'nation_' || n_nationkey AS source, 'region_' || n_regionkey AS target, 'in_region' AS type FROM nation
    UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'in_nation' FROM supplier
    UNION ALL SELECT 'customer_' || c_custkey, 'nation_' || c_nationkey, 'in_nation' FROM customer
    UNION ALL SELECT 'order_' || o_orderkey, 'customer_' || o_custkey, 'placed_by' FROM orders
    UNION ALL SELECT DISTINCT 'order_' || l_orderkey, 'part_' || l_partkey, 'contains' FROM lineitem
    UNION ALL SELECT DISTINCT 'part_' || l_partkey, 'supplier_' || l_suppkey, 'supplied_by' FROM lineitem
)"""
DEGREES = "ends AS (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges), deg AS (SELECT id, count(*) AS degree FROM ends GROUP BY id)"
PLACES = """
pn AS (SELECT 'region_' || r_regionkey AS id FROM region UNION ALL SELECT 'nation_' || n_nationkey FROM nation UNION ALL SELECT 'supplier_' || s_suppkey FROM supplier),
pe AS (SELECT 'nation_' || n_nationkey AS source, 'region_' || n_regionkey AS target FROM nation WHERE n_regionkey < 3
    UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey FROM supplier WHERE s_nationkey % 2 = 0)"""
TRANSITIONS = """
after_ AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events),
counted AS (SELECT source, target, count(*) AS n FROM after_ WHERE target IS NOT NULL GROUP BY ALL),
te AS (SELECT source, target FROM (SELECT *, avg(n) OVER (PARTITION BY source) AS mean FROM counted) WHERE n > mean)"""
