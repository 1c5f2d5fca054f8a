"""References across languages: calls to endpoints, AJAX actions, blocks. The first target in order wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import bare_action, query_param, route_key, static_route


def route_prefixes(key: Column) -> Column:
    """All beginnings of a route key that end before a slash or at its end."""
    parts = F.split(key, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def match_endpoints(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """id, endpoint: the first endpoint (by seq) whose route, or static beginning, a call's route has.

    calls: id, route. endpoints: id, route, seq. The prefix test is an equi-join on exploded prefixes, so no
    pair of call and endpoint is tried that doesn't match."""
    called = calls.select("id", route_key(F.col("route")).alias("key")).where("key != ''").select("id", F.explode(F.array_distinct(route_prefixes(F.col("key")))).alias("key"), (F.col("key")).alias("whole"))
    routes = endpoints.select(F.col("id").alias("endpoint"), "seq", route_key(F.col("route")).alias("route_key")).where("route_key != ''")
    whole = routes.select("endpoint", "seq", F.col("route_key").alias("key"), F.lit(True).alias("exact"))
    static = routes.select("endpoint", "seq", static_route(F.col("route_key")).alias("key"), F.lit(False).alias("exact"))
    targets = whole.union(static).groupBy("key", "exact").agg(F.min_by("endpoint", "seq").alias("endpoint"), F.min("seq").alias("seq"))
    hit = called.join(targets, "key").where(~F.col("exact") | (F.col("key") == F.col("whole")))
    return hit.groupBy("id").agg(F.min_by("endpoint", "seq").alias("endpoint"))


def match_actions(calls: DataFrame, handlers: DataFrame) -> DataFrame:
    """id, handler: the first handler (by seq) of the action in a call's AJAX url. handlers: id, hook_name, seq."""
    asked = calls.where(F.col("route").contains("admin-ajax.php")).select("id", query_param(F.col("route"), "action").alias("action")).where("action IS NOT NULL")
    first = handlers.groupBy(bare_action(F.col("hook_name")).alias("action")).agg(F.min_by("id", "seq").alias("handler"))
    return asked.join(first, "action").select("id", "handler")


def match_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """id, match: the first row of `right` (by seq) with the same name. left: id, name; right: id, name, seq."""
    first = right.groupBy("name").agg(F.min_by("id", "seq").alias("match"))
    return left.join(first, "name").select("id", "match")


def propagated(endpoints: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """id, capability, nonce_verified, sanitization_count of endpoints, from the nodes that register them.

    An own capability stays, else the first by seq counts; nonces are or-ed; counts take the maximum."""
    seen = edges.select(F.col("target").alias("id"), "source", "seq").join(sources.select(F.col("id").alias("source"), F.col("capability").alias("cap"), F.col("nonce_verified").alias("nonce"), F.col("sanitization_count").alias("cleaned")), "source")
    told = seen.groupBy("id").agg(F.min_by("cap", F.when(F.col("cap").isNotNull(), F.col("seq"))).alias("cap"), F.bool_or("nonce").alias("nonce"), F.max("cleaned").alias("cleaned"))
    both = endpoints.join(told, "id", "left")
    return both.select("id", F.coalesce("capability", "cap").alias("capability"), F.coalesce(F.col("nonce_verified") | F.coalesce("nonce", F.lit(False)), F.col("nonce")).alias("nonce_verified"), F.greatest("sanitization_count", "cleaned").alias("sanitization_count"))


def grouped_members(nodes: DataFrame, least: int = 2) -> DataFrame:
    """group_id, label, kind, n: groups by namespace, else by directory, with `least` members or more."""
    own = nodes.select("id", "seq", group_id().alias("group_id"), F.coalesce(F.nullif(F.col("namespace"), F.lit("")), F.col("directory")).alias("name")).where("group_id IS NOT NULL")
    kind = F.when(F.col("group_id").startswith("ns_"), "namespace").otherwise("dir")
    return own.groupBy("group_id").agg(F.count("*").alias("n"), F.min_by("name", "seq").alias("label")).where(F.col("n") >= least).withColumn("kind", kind)


def group_id() -> Column:
    from graphloom.functions.text import sanitize_id

    namespace, directory = F.nullif(F.col("namespace"), F.lit("")), F.nullif(F.col("directory"), F.lit(""))
    return F.when(namespace.isNotNull(), F.concat(F.lit("ns_"), sanitize_id(namespace))).when(directory.isNotNull(), F.concat(F.lit("dir_"), sanitize_id(directory)))


def with_parents(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Nodes with parent: their group, if it is one."""
    return nodes.withColumn("parent__", group_id()).join(groups.select(F.col("group_id").alias("parent__"), F.col("group_id").alias("parent")), "parent__", "left").drop("parent__")
