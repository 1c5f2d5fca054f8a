"""Registered queries of the graph library over the star tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import catalog, text
from graphloom.operators import algorithms, build, describe, views, xref
from graphloom.plans import graphs
from graphloom.plans.graphs import DEGREES, EDGES, NODES, PLACES, TRANSITIONS, place_edges, place_nodes, read, star_edges, star_nodes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Edge types of the star graph with a family and view modes of their own.
STAR_TYPES = (("in_region", "Place", ("requirements",)), ("in_nation", "Place", ("requirements", "web")), ("placed_by", "Trade", ("data",)), ("contains", "Trade", ("data", "web")))
STAR_SQL = "dim AS (SELECT * FROM (VALUES ('in_region','Place','requirements'),('in_nation','Place','requirements'),('in_nation','Place','web'),('placed_by','Trade','data'),('contains','Trade','data'),('contains','Trade','web')) v(type, family, mode))"
USED = "'nation_3'"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("pr1_sanitize_id", "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS id FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", text.sanitize_id(F.col("url")).alias("id"))


@query("ag1_first_nodes", "SELECT 'part_' || l_partkey AS id, arg_min('supplier_' || l_suppkey, l_orderkey * 100 + l_linenumber) AS label FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_partkey) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) GROUP BY l_partkey")
def _(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"))
    nodes = rows.select(F.concat(F.lit("part_"), "l_partkey").alias("id"), F.concat(F.lit("supplier_"), "l_suppkey").alias("label"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return build.first_nodes(nodes).select("id", "label")


@query("ag2_merged_edges", "SELECT 'part_' || l_partkey AS source, 'supplies' AS type, 'supplier_' || l_suppkey AS target, min(s)::BIGINT AS seq, arg_max(q, s) AS quantity FROM (SELECT l_partkey, l_suppkey, l_orderkey * 100 + l_linenumber AS s, max(l_quantity) AS q FROM lineitem GROUP BY ALL) GROUP BY l_partkey, l_suppkey")
def _(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq")).agg(F.max("l_quantity").alias("quantity"))
    edges = rows.select(F.concat(F.lit("part_"), "l_partkey").alias("source"), F.lit("supplies").alias("type"), F.concat(F.lit("supplier_"), "l_suppkey").alias("target"), "seq", "quantity")
    return build.merged_edges(edges)


INTACT = f"WITH {NODES}, {EDGES}, kept AS (SELECT id FROM nodes WHERE label <> 'Order P'), whole AS (SELECT * FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept))"


@query("jn1_tk7_intact_edges", f"{INTACT} SELECT 'e_' || (row_number() OVER (ORDER BY type, source, target) - 1) AS id, source, target, type FROM whole")
def _(spark, d):
    nodes = star_nodes(spark, d).where("label != 'Order P'")
    return build.numbered_edges(build.intact_edges(nodes, star_edges(spark, d)), ["type", "source", "target"])


@query("ag3_degrees", f"WITH {NODES}, {EDGES}, {DEGREES} SELECT id, coalesce(degree, 0) AS degree FROM nodes LEFT JOIN deg USING (id)")
def _(spark, d):
    return views.degrees(star_nodes(spark, d), star_edges(spark, d)).select("id", "degree")


SEEDS = f"WITH {NODES}, {EDGES}, {DEGREES}, top AS (SELECT id FROM deg JOIN nodes USING (id) ORDER BY degree DESC, id LIMIT 40), seeds AS (SELECT id FROM top UNION SELECT id FROM nodes WHERE file LIKE '%region.tbl')"


@query("tk2_focus_seed", f"{SEEDS} SELECT id, label, degree FROM seeds JOIN nodes USING (id) JOIN deg USING (id)")
def _(spark, d):
    nodes, edges = star_nodes(spark, d), star_edges(spark, d)
    seeds = views.focus_seeds(nodes, edges, "region.tbl")
    return views.degrees(nodes.join(F.broadcast(seeds), "id"), edges).select("id", "label", "degree")


FOCUS = f"""{SEEDS}, around AS (SELECT target AS id FROM edges WHERE source IN (SELECT id FROM seeds) UNION SELECT source FROM edges WHERE target IN (SELECT id FROM seeds)),
more AS (SELECT id FROM around JOIN deg USING (id) WHERE id NOT IN (SELECT id FROM seeds) ORDER BY degree DESC, id LIMIT greatest(0, 100 - (SELECT count(*) FROM seeds))),
shown AS (SELECT id, true AS "primary" FROM seeds UNION ALL SELECT id, false FROM more)"""


@query("tk3_focus_nodes", f"{FOCUS} SELECT id, label, type, \"primary\" FROM shown JOIN nodes USING (id)")
def _(spark, d):
    return views.focus(star_nodes(spark, d), star_edges(spark, d), "region.tbl")[0].select("id", "label", "type", "primary")


@query("tk4_focus_edges", f"{FOCUS} SELECT source, target, type FROM edges WHERE source IN (SELECT id FROM shown) AND target IN (SELECT id FROM shown)")
def _(spark, d):
    return views.focus(star_nodes(spark, d), star_edges(spark, d), "region.tbl")[1]


@query("tk1_render_cap", f"WITH {NODES}, {EDGES}, {DEGREES}, own AS (SELECT id FROM nodes WHERE NOT is_library), lib AS (SELECT id FROM nodes LEFT JOIN deg USING (id) WHERE is_library ORDER BY coalesce(degree, 0) DESC, id LIMIT greatest(0, (SELECT count(*) FROM own WHERE id LIKE 'never%') + 25)) SELECT id FROM nodes WHERE type = 'part' AND NOT is_library UNION ALL SELECT id FROM lib")
def _(spark, d):
    nodes = star_nodes(spark, d).where("type = 'part'")
    cap = nodes.where("NOT is_library").count() + 25
    return views.capped(nodes, star_edges(spark, d), cap)[0].select("id")


@query("pr7_mode_edges", f"WITH {EDGES} SELECT * FROM edges WHERE type IN ('in_nation', 'contains')")
def _(spark, d):
    edges = star_edges(spark, d)
    return views.mode_edges(edges, "web", views.edge_registry(edges, STAR_TYPES))


@query("ag9_mode_counts", f"WITH {EDGES}, {STAR_SQL} SELECT mode, count(*) AS n FROM edges JOIN dim USING (type) GROUP BY mode")
def _(spark, d):
    edges = star_edges(spark, d)
    return views.mode_counts(edges, views.edge_registry(edges, STAR_TYPES))


@query("ag8_legend", f"WITH {EDGES}, {STAR_SQL} SELECT family, type, count(*) AS n FROM edges JOIN (SELECT DISTINCT type, family FROM dim) USING (type) GROUP BY ALL")
def _(spark, d):
    edges = star_edges(spark, d)
    return views.legend(edges, views.edge_registry(edges, STAR_TYPES))


@query("jn14_unlinked", f"WITH {NODES}, {EDGES}, few AS (SELECT * FROM edges WHERE type IN ('in_region', 'placed_by')) SELECT id, type FROM nodes WHERE id NOT IN (SELECT source FROM few UNION SELECT target FROM few)")
def _(spark, d):
    return views.unlinked(star_nodes(spark, d), star_edges(spark, d).where("type IN ('in_region', 'placed_by')")).select("id", "type")


@query("pr6_label_search", f"WITH {NODES} SELECT id, label FROM nodes WHERE contains(lower(label), 'widget') AND type IN ('part', 'order') AND NOT is_library")
def _(spark, d):
    return star_nodes(spark, d).where(views.matches("Widget", ("part", "order"), True)).select("id", "label")


@query("ag11_match_counts", f"WITH {NODES} SELECT count(*) AS n_all, count(*) FILTER (NOT is_library) AS n_rendered FROM nodes WHERE contains(lower(label), 'cold')")
def _(spark, d):
    nodes = star_nodes(spark, d)
    return views.match_counts(nodes, nodes.where("NOT is_library"), "COLD")


@query("jn15_visible_edges", f"WITH {NODES}, {EDGES}, vis AS (SELECT id FROM nodes WHERE type <> 'order') SELECT * FROM edges WHERE source IN (SELECT id FROM vis) AND target IN (SELECT id FROM vis)")
def _(spark, d):
    return build.intact_edges(star_nodes(spark, d).where("type != 'order'"), star_edges(spark, d))


@query("jn9_connections", f"WITH {NODES}, {EDGES}, c AS (SELECT 'out' AS direction, type, target AS other FROM edges WHERE source = {USED} UNION ALL SELECT 'in', type, source FROM edges WHERE target = {USED}) SELECT direction, c.type, other, coalesce(label, other) AS label FROM c LEFT JOIN nodes ON id = other")
def _(spark, d):
    return views.connections(star_nodes(spark, d), star_edges(spark, d), "nation_3")


@query("jn10_neighbourhood", f"WITH {NODES}, {EDGES} SELECT id, label FROM nodes WHERE id IN (SELECT target FROM edges WHERE source = {USED} UNION SELECT source FROM edges WHERE target = {USED} UNION SELECT {USED})")
def _(spark, d):
    return views.neighbourhood(star_nodes(spark, d), star_edges(spark, d), "nation_3").select("id", "label")


@query("ag5_edge_index", f"WITH {EDGES} SELECT id, type, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out, count(*) AS n FROM (SELECT source AS id, type, 0 AS i, 1 AS o FROM edges UNION ALL SELECT target, type, 1, 0 FROM edges) GROUP BY ALL")
def _(spark, d):
    return views.edge_index(star_edges(spark, d))


@query("ag7_type_counts", f"WITH {NODES} SELECT type, count(*) AS n, min(id) AS first_id FROM nodes GROUP BY type")
def _(spark, d):
    return views.type_counts(star_nodes(spark, d))


@query("ag13_totals", f"WITH {NODES}, {EDGES} SELECT count(*) AS n_nodes, count(*) FILTER (is_library) AS n_library, (SELECT count(*) FROM edges) AS n_edges FROM nodes")
def _(spark, d):
    n = star_nodes(spark, d).agg(F.count("*").alias("n_nodes"), F.count_if("is_library").alias("n_library"))
    return n.crossJoin(star_edges(spark, d).agg(F.count("*").alias("n_edges")))


@query("ag14_pr14_density", f"WITH {NODES}, {EDGES}, c AS (SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM edges) AS n_edges) SELECT n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1) / 2), 9) AS density, CASE WHEN n_nodes > 1000 THEN 'grid' WHEN n_nodes > 300 OR n_edges / (n_nodes * (n_nodes - 1) / 2) < 0.08 THEN 'fcose' ELSE 'dagre' END AS layout FROM c")
def _(spark, d):
    return views.density(star_nodes(spark, d), star_edges(spark, d))


@query("jn13_top_connections", f"WITH {NODES}, {EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY type, target) AS nth FROM edges) SELECT source AS id, nth::INTEGER AS nth, r.type || ' ' || coalesce(label, target) AS text FROM r LEFT JOIN nodes ON nodes.id = target WHERE nth <= 10")
def _(spark, d):
    return views.top_connections(star_nodes(spark, d), star_edges(spark, d))


@query("ag10_first_labels", "SELECT o_orderpriority AS label, min(o_orderkey) AS seq FROM orders GROUP BY o_orderpriority")
def _(spark, d):
    return views.first_labels(read(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("seq")))


ROUTES = [("r0", "example.org/none", 0), ("r1", "/en/(?P<id>\\d+)", 1), ("r2", "en", 2), ("r3", "/de/", 3), ("r4", "/de/1(?P<x>.)", 4), ("r5", "https://host/fr", 5)]


@query(
    "jn2_route_match",
    """WITH p AS (SELECT page_id, lower(trim(regexp_replace(regexp_replace(url, '^https?://[^/]+', ''), '[?#].*$', ''), '/')) AS key FROM pages),
    r AS (SELECT * FROM (VALUES ('r1', 'en', 1), ('r2', 'en', 2), ('r3', 'de', 3), ('r4', 'de/1', 4), ('r5', 'fr', 5)) v(endpoint, pre, seq))
    SELECT page_id AS id, arg_min(endpoint, seq) AS endpoint FROM p JOIN r ON key = pre OR starts_with(key, pre || '/') WHERE key <> '' GROUP BY page_id""",
)
def _(spark, d):
    return xref.match_endpoints(read(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("route")), spark.createDataFrame(ROUTES, "id string, route string, seq int"))


@query("jn3_ajax_match", """WITH c AS (SELECT page_id AS id, page_id % 5 AS a FROM pages WHERE page_id % 3 < 2), h AS (SELECT * FROM (VALUES ('ajax_a1', 1), ('ajax_a2', 2), ('ajax_a4', 4)) v(handler, a)) SELECT id, handler FROM c JOIN h USING (a)""")
def _(spark, d):
    route = F.expr("CASE page_id % 3 WHEN 0 THEN concat('/wp-admin/admin-ajax.php?action=a', page_id % 5) WHEN 1 THEN concat('https://h.org/wp-admin/admin-ajax.php?x=1&action=a', page_id % 5, '&y') ELSE concat('/other?action=a', page_id % 5) END")
    handlers = [("ajax_late", "wp_ajax_a1", 9), ("ajax_a1", "wp_ajax_nopriv_a1", 1), ("ajax_a2", "wp_ajax_a2", 2), ("ajax_a4", "wp_ajax_a4", 3), ("ajax_a9", "wp_ajax_a9", 4)]
    return xref.match_actions(read(spark, d, "pages").select(F.col("page_id").alias("id"), route.alias("route")), spark.createDataFrame(handlers, "id string, hook_name string, seq int"))


@query("jn4_first_name", "SELECT 'part_' || a.p_partkey AS id, 'part_' || b.p AS match FROM part a JOIN (SELECT p_name, min(p_partkey) AS p FROM part WHERE p_size >= 25 GROUP BY p_name) b USING (p_name) WHERE a.p_size < 25")
def _(spark, d):
    rows = read(spark, d, "part").select(F.concat(F.lit("part_"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"), "p_size")
    return xref.match_names(rows.where("p_size < 25"), rows.where("p_size >= 25"))


#: Source text of a page's row: a check of a capability in one of its forms or none, a nonce or none, and some calls.
SCANNED = """concat(CASE page_id % 4 WHEN 0 THEN concat('if (current_user_can( "edit_', CASE page_id % 2 WHEN 0 THEN 'posts' ELSE 'pages' END, '" )) {') WHEN 1 THEN 'user_can($u, ''read'')' WHEN 2 THEN 'current_user_can($x)' ELSE '' END,
    CASE page_id % 3 WHEN 0 THEN ' wp_verify_nonce($n);' WHEN 1 THEN ' check_admin_referer();' ELSE ' nonce' END, repeat(' esc_html( absint($a) );', CAST(page_id % 5 AS INT)), ' wp_kses_post($b); wp_kses($c); esc_html ($d);')"""
_COUNTS = " + ".join(f"(length(src) - length(replace(src, '{n}(', ''))) // {len(n) + 1}" for n in catalog.SANITIZERS)


@query("an1_an2_ag12_source_scan", f"""WITH t AS (SELECT page_id, {SCANNED.replace("AS INT", "AS BIGINT")} AS src FROM pages)
    SELECT page_id, coalesce(nullif(regexp_extract(src, 'current_user_can\\s*\\(\\s*[''"]([a-z_]+)[''"]\\s*\\)', 1), ''), nullif(regexp_extract(src, 'user_can\\s*\\([^,]+,\\s*[''"]([a-z_]+)[''"]\\s*\\)', 1), '')) AS capability,
        contains(src, 'wp_verify_nonce') OR contains(src, 'check_admin_referer') AS nonce, ({_COUNTS})::BIGINT AS cleaned FROM t""")
def _(spark, d):
    src = F.expr(SCANNED)
    return read(spark, d, "pages").select("page_id", text.capability(src).alias("capability"), text.verifies_nonce(src).alias("nonce"), text.count_calls(src).cast("bigint").alias("cleaned"))


@query("jn8_ag4_propagated", """WITH e AS (SELECT o_custkey AS c, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS cap, o_orderstatus = 'P' AS nonce, (o_orderkey % 7)::INTEGER AS cleaned FROM orders)
    SELECT 'customer_' || c_custkey AS id, arg_min(cap, seq) FILTER (cap IS NOT NULL) AS capability, bool_or(nonce) AS nonce_verified, greatest(0, max(cleaned))::INTEGER AS sanitization_count FROM customer LEFT JOIN e ON c = c_custkey GROUP BY c_custkey""")
def _(spark, d):
    orders = read(spark, d, "orders")
    ends = read(spark, d, "customer").select(F.concat(F.lit("customer_"), "c_custkey").alias("id"), F.lit(None).cast("string").alias("capability"), F.lit(None).cast("boolean").alias("nonce_verified"), F.lit(0).alias("sanitization_count"))
    edges = orders.select(F.concat(F.lit("order_"), "o_orderkey").alias("source"), F.concat(F.lit("customer_"), "o_custkey").alias("target"), F.col("o_orderkey").alias("seq"))
    sources = orders.select(F.concat(F.lit("order_"), "o_orderkey").alias("id"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END").alias("capability"), F.expr("o_orderstatus = 'P'").alias("nonce_verified"), F.expr("cast(o_orderkey % 7 AS int)").alias("sanitization_count"))
    return xref.propagated(ends, edges, sources)


GROUPS = "WITH n AS (SELECT doc_id, CASE WHEN lang <> '' THEN 'ns_' || regexp_replace(lang, '[^a-zA-Z0-9_-]', '_', 'g') WHEN source <> '' THEN 'dir_' || regexp_replace(source, '[^a-zA-Z0-9_-]', '_', 'g') END AS group_id, coalesce(nullif(lang, ''), source) AS name FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, source FROM documents)), g AS (SELECT group_id, count(*) AS n, arg_min(name, doc_id) AS label, CASE WHEN group_id LIKE 'ns\\_%' ESCAPE '\\' THEN 'namespace' ELSE 'dir' END AS kind FROM n WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(*) >= 2)"


def _members(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("seq"), F.expr("CASE WHEN doc_id % 2 = 0 THEN lang END").alias("namespace"), F.col("source").alias("directory"))


@query("ag6_groups", f"{GROUPS} SELECT * FROM g")
def _(spark, d):
    return xref.grouped_members(_members(spark, d))


@query("jn11_parents", f"{GROUPS} SELECT doc_id::VARCHAR AS id, g.group_id AS parent FROM n LEFT JOIN g USING (group_id)")
def _(spark, d):
    nodes = _members(spark, d)
    return xref.with_parents(nodes, xref.grouped_members(nodes)).select("id", "parent")


@query("pr2_library", "SELECT page_id, list_bool_or(list_transform(string_split(url, '/')[:-2], lambda s: lower(s) IN ('vendor', 'libraries', 'external') OR regexp_matches(s, '^(?i)[a-z][a-z0-9_-]+-\\d+\\.\\d+'))) AS is_library FROM (SELECT page_id, url || '/x/chart-' || page_id || '.css' AS url FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/vendor' WHEN 1 THEN 'a/ext-2.' || page_id || '/b' WHEN 2 THEN 'src/libraries' ELSE 'src/x' END AS url FROM pages))")
def _(spark, d):
    path = F.concat(F.expr("CASE page_id % 4 WHEN 0 THEN 'a/vendor' WHEN 1 THEN concat('a/ext-2.', page_id, '/b') WHEN 2 THEN 'src/libraries' ELSE 'src/x' END"), F.lit("/x/chart-"), F.col("page_id").cast("string"), F.lit(".css"))
    return read(spark, d, "pages").select("page_id", text.is_library(path).alias("is_library"))


@query("an3_doc_summary", r"SELECT doc_id, nullif(trim(string_split(trim(text, ' '), chr(10))[1], ' ')[:300], '') AS summary FROM documents")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", text.doc_summary(F.col("text")).alias("summary"))


@query("an4_describe", """SELECT 'supplier_' || s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Custom post type ''' || s_name || '''.' WHEN 1 THEN 'Outbound HTTP GET request to ' || s_name || '.' WHEN 2 THEN 'Writes to WordPress option ''' || s_name || '''.' ELSE 'PHP class in namespace ' || s_name || '.' END AS description FROM supplier""")
def _(spark, d):
    null = lambda kind: F.lit(None).cast(kind)
    k = lambda i: F.when(F.col("s_suppkey") % 4 == i, F.col("s_name"))
    meta = F.struct(
        k(3).alias("namespace"), null("string").alias("extends"), null("array<string>").alias("implements"), null("string").alias("visibility"), null("array<struct<name:string,type:string>>").alias("params"), null("string").alias("return_type"), null("int").alias("priority"), null("string").alias("hook_name"), null("string").alias("http_method"), k(1).alias("route"),
        F.lit("write").alias("operation"), k(2).alias("key"), null("string").alias("block_name"), null("string").alias("block_category"), null("string").alias("capability"), null("boolean").alias("nonce_verified"), null("int").alias("sanitization_count"),
    )
    kind = F.expr("element_at(array('post_type', 'http_call', 'data_source', 'class'), cast(s_suppkey % 4 AS int) + 1)")
    rows = read(spark, d, "supplier").select(F.concat(F.lit("supplier_"), "s_suppkey").alias("id"), F.col("s_name").alias("label"), kind.alias("type"), F.lit("option").alias("subtype"), F.lit(None).cast("string").alias("file"), meta.alias("metadata"))
    return rows.select("id", describe.description().alias("description"))


#: Nodes of every type, with {n} for a name and {k} for a number, and the text of each.
TEMPLATES = [
    ({"type": "class", "namespace": "{n}", "extends": "B{k}", "implements": ["I", "J{k}"]}, "PHP class in namespace {n}. Extends B{k}, implements I, J{k}."),
    ({"type": "class"}, "PHP class."),
    ({"type": "interface", "namespace": "{n}"}, "PHP interface in namespace {n}."),
    ({"type": "trait", "namespace": "{n}"}, "PHP trait in namespace {n}."),
    ({"type": "function", "params": [("a{k}", "int"), ("$b", None)], "return_type": "R{k}"}, "Standalone PHP function accepting 2 parameters (int $a{k}, $b), returns R{k}."),
    ({"type": "method", "id": "method_K{k}_run", "visibility": "private", "params": [("a", None)], "return_type": "void"}, "Private method of K{k}. Accepts 1 parameter ($a), returns void."),
    ({"type": "method", "id": "method_K{k}_run", "return_type": "void"}, "Method of K{k}. returns void."),
    ({"type": "hook", "subtype": "filter", "hook_name": "h_{n}", "priority": 5}, "WordPress filter hook 'h_{n}' registered with priority 5."),
    ({"type": "hook", "label": "h{k}", "hook_name": "h{k}", "priority": 10}, "WordPress action hook."),
    ({"type": "rest_endpoint", "http_method": "POST", "route": "/r/{k}", "capability": "edit", "nonce_verified": True, "sanitization_count": 2}, "REST API endpoint: POST /r/{k}. Requires 'edit' capability. Nonce-verified. 2 sanitization calls."),
    ({"type": "rest_endpoint", "capability": "__return_true"}, "REST API endpoint: GET {n}. Public (no auth required)."),
    ({"type": "ajax_handler", "hook_name": "wp_ajax_nopriv_x"}, "AJAX handler for action '{n}'. Accessible to unauthenticated users (nopriv)."),
    ({"type": "ajax_handler", "hook_name": "wp_ajax_x", "sanitization_count": 1}, "AJAX handler for action '{n}'. Authenticated users only (wp_ajax_*). 1 sanitization call."),
    ({"type": "data_source", "subtype": "post_meta", "operation": "read", "key": "k{k}"}, "Reads post meta 'k{k}'."),
    ({"type": "data_source", "subtype": "option", "operation": "write", "key": "{n}"}, "Writes to WordPress option '{n}'."),
    ({"type": "data_source", "subtype": "transient", "operation": "delete", "key": "k{k}"}, "Deletes WordPress transient 'k{k}'."),
    ({"type": "http_call", "http_method": "PUT", "route": "/r/{k}"}, "Outbound HTTP PUT request to /r/{k}."),
    ({"type": "gutenberg_block", "block_name": "b/{k}", "block_category": "widgets"}, "Gutenberg block 'b/{k}'. Category: widgets."),
    ({"type": "js_api_call", "route": "/r/{k}"}, "JavaScript API call to /r/{k}."),
    ({"type": "fetch_call", "http_method": "GET", "route": "/r/{k}"}, "Fetch GET request to /r/{k}."),
    ({"type": "axios_call", "http_method": "POST"}, "Axios POST request."),
    ({"type": "file", "file": "/p/{k}.jsx"}, "JavaScript file."),
    ({"type": "file", "file": "/p/{k}.php"}, "PHP file."),
    ({"type": "shortcode"}, "WordPress shortcode [{n}]."),
    ({"type": "admin_page"}, "WordPress admin page '{n}'."),
    ({"type": "cron_job"}, "Scheduled cron event '{n}'."),
    ({"type": "post_type"}, "Custom post type '{n}'."),
    ({"type": "taxonomy"}, "Custom taxonomy '{n}'."),
    ({"type": "react_component"}, "React component '{n}'."),
    ({"type": "react_hook"}, "React hook '{n}'."),
    ({"type": "js_function"}, "JavaScript function."),
    ({"type": "js_class"}, "JavaScript class."),
    ({"type": "js_hook"}, "WordPress JS hook '{n}'."),
    ({"type": "wp_store"}, "WordPress data store '{n}'."),
]
_TOLD = ", ".join("(%d, '%s')" % (i, t.replace("'", "''")) for i, (_, t) in enumerate(TEMPLATES))


@query("an4_an8_templates", f"SELECT c_custkey, replace(replace(t, '{{n}}', c_name), '{{k}}', c_custkey::VARCHAR) AS description FROM customer JOIN (VALUES {_TOLD}) v(i, t) ON i = c_custkey % {len(TEMPLATES)}")
def _(spark, d):
    own = "id string, label string, type string, subtype string, file string"
    meta = "namespace string, extends string, implements array<string>, visibility string, params array<struct<name:string,type:string>>, return_type string, priority int, hook_name string, http_method string, route string, operation string, key string, block_name string, block_category string, capability string, nonce_verified boolean, sanitization_count int"
    names = [x.split(" ")[0] for x in f"{own}, {meta}".split(", ")]
    rows = [(i, *[t.get(c, {"id": "x", "label": "{n}"}.get(c)) for c in names]) for i, (t, _) in enumerate(TEMPLATES)]
    dim = spark.createDataFrame(rows, f"i int, {own}, {meta}")
    whole = lambda c: F.replace(F.replace(c, F.lit("{n}"), F.col("c_name")), F.lit("{k}"), F.col("c_custkey").cast("string"))
    filled = {c: whole(F.col(c)) for c, kind in dim.dtypes if kind == "string"} | {"implements": F.transform("implements", whole), "params": F.transform("params", lambda p: F.struct(whole(p["name"]).alias("name"), p["type"].alias("type")))}
    met = read(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % len(TEMPLATES)).cast("int").alias("i")).join(F.broadcast(dim), "i").withColumns(filled)
    fields = [x.split(" ")[0] for x in meta.split(", ")]
    return met.withColumn("metadata", F.struct(*fields)).select("c_custkey", describe.description().alias("description"))


@query("tk5_batches", "SELECT doc_id AS id, (row_number() OVER (ORDER BY doc_id) - 1) // 25 AS batch FROM documents")
def _(spark, d):
    return describe.batches(read(spark, d, "documents").select(F.col("doc_id").alias("id")), ["id"])


@query("tk6_samples", f"WITH {NODES}, t AS (SELECT id, CASE type WHEN 'region' THEN 'class' WHEN 'nation' THEN 'rest_endpoint' WHEN 'supplier' THEN 'hook' ELSE type END AS type FROM nodes) SELECT id, type FROM t ORDER BY CASE type WHEN 'class' THEN 0 WHEN 'rest_endpoint' THEN 1 WHEN 'hook' THEN 2 ELSE 99 END, id LIMIT 20")
def _(spark, d):
    kind = F.expr("CASE type WHEN 'region' THEN 'class' WHEN 'nation' THEN 'rest_endpoint' WHEN 'supplier' THEN 'hook' ELSE type END")
    return describe.samples(star_nodes(spark, d).withColumns({"type": kind, "description": F.col("label"), "seq": F.col("id")})).select("id", "type")


@query("tk1_render_cap_all", f"WITH {NODES}, {EDGES}, {DEGREES}, own AS (SELECT id FROM nodes WHERE NOT is_library), lib AS (SELECT id FROM nodes LEFT JOIN deg USING (id) WHERE is_library ORDER BY coalesce(degree, 0) DESC, id LIMIT greatest(0, 1500 - (SELECT count(*) FROM own))) SELECT id FROM own UNION ALL SELECT id FROM lib")
def _(spark, d):
    return views.capped(star_nodes(spark, d), star_edges(spark, d))[0].select("id")


@query("sc6_generated_marker", "SELECT page_id, contains(lower(html[:512]), 'charset') OR contains(lower(html[:512]), 'do not edit') AS generated FROM pages")
def _(spark, d):
    from graphloom.sources.tree import has_marker

    return read(spark, d, "pages").select("page_id", has_marker(F.col("html"), ("charset", "do not edit")).alias("generated"))


@query("sc10_header", "SELECT page_id, CASE WHEN page_id % 3 < 2 THEN 'Kit ' || page_id END AS name, CASE page_id % 3 WHEN 0 THEN '1.' || page_id END AS version FROM pages")
def _(spark, d):
    from graphloom.sources.tree import header

    content = F.expr("concat('<?php /*\n * ', CASE page_id % 3 WHEN 0 THEN concat('Plugin Name : Kit ', page_id, '  \n * VERSION:1.', page_id) WHEN 1 THEN concat('plugin name:Kit ', page_id) ELSE 'Plugin: none' END, '\n*/', repeat('x', 9000), 'Version: 9')")
    return read(spark, d, "pages").select("page_id", header(content, "Plugin Name").alias("name"), header(content, "Version").alias("version"))


@query("ex38_imports", "SELECT 'p' || page_id || '.js' AS path, './m' || (page_id % 7) AS source FROM pages UNION ALL SELECT 'p' || page_id || '.js', 'pkg' FROM pages UNION ALL SELECT 'p' || page_id || '.js', './s.css' FROM pages WHERE page_id % 2 = 0")
def _(spark, d):
    from graphloom.sources import js

    content = F.expr("concat('// import z from ''./no''\nimport a, { b as c } from ''./m', page_id % 7, ''';import \"pkg\"\n', CASE page_id % 2 WHEN 0 THEN 'import ''./s.css'';' ELSE 'import(''./lazy'')' END)")
    files = read(spark, d, "pages").select(F.format_string("p%s.js", "page_id").alias("path"), content.alias("content"))
    return js.imports(js.JsFiles(files)).select("path", "source")


@query("ex_php_edges", """WITH p AS (SELECT page_id, 'func_f' || page_id AS f FROM pages), e AS (
    SELECT f AS source, 'reads_data' AS type, 'data_read_k' || (page_id % 5) AS target FROM p UNION ALL SELECT f, 'registers_hook', 'hook_action_h' || (page_id % 3) FROM p UNION ALL SELECT f, 'calls', 'func_f' || (page_id - 1) FROM p WHERE page_id > 0
    UNION ALL SELECT 'method_C' || page_id || '_m', 'triggers_hook', 'hook_filter_t' || (page_id % 4) FROM p WHERE page_id % 2 = 0 UNION ALL SELECT 'class_N_C' || page_id, 'has_method', 'method_C' || page_id || '_m' FROM p WHERE page_id % 2 = 0
    UNION ALL SELECT 'class_N_C' || page_id, 'extends', 'class_N_Base' FROM p WHERE page_id % 2 = 0) SELECT source, type, target FROM e""")
def _(spark, d):
    from graphloom.sources import php

    content = F.expr("""concat('<?php namespace N; /* get_option("no") */ function f', page_id, '($a) { $x = get_option("k', page_id % 5, '", array(1, [2])); f', page_id - 1, '($x); }\n add_action("h', page_id % 3, '", "f', page_id, '", 5);\n',
        CASE page_id % 2 WHEN 0 THEN concat('class C', page_id, ' extends Base { public function m() { return apply_filters("t', page_id % 4, '", 1); } }') ELSE '' END)""")
    files = read(spark, d, "pages").select(F.format_string("p%s.php", "page_id").alias("path"), content.alias("content"))
    return php.entities(files)[1].select("source", "type", "target")


HEADS = "p AS (SELECT p_partkey AS k, p_size % 41 AS n, p_partkey % 31 AS t, p_partkey % 4 AS d FROM part)"


@query("ex1_ex9_ex27_heads", f"""WITH {HEADS} SELECT 'class_C' || k AS source, 'extends' AS type, 'class_B' || (k % 50) AS target FROM p UNION ALL SELECT 'class_C' || k, 'implements', 'class_I' || i FROM p, LATERAL (SELECT unnest(range(1, n + 1)) AS i)
    UNION ALL SELECT 'class_C' || k, 'uses_trait', 'class_T' || i FROM p, LATERAL (SELECT unnest(range(1, t + 1)) AS i) UNION ALL SELECT 'file_d_p' || k || '_php', 'includes', 'file_d_inc_x' || (k % 7) || '_php' FROM p
    UNION ALL SELECT 'method_C' || k || '_m', 'returns', (SELECT string_agg('R' || i, '|' ORDER BY i) FROM range(1, n + 2) AS r(i)) FROM p""")
def _(spark, d):
    from graphloom.sources import php

    listed = lambda letter, n: f"array_join(transform(sequence(1, greatest({n}, 1)), i -> concat('{letter}', i)), CASE k % 3 WHEN 0 THEN ', ' WHEN 1 THEN ',' ELSE ' /* ; */ ,' END)"
    content = F.expr(f"""concat('<?php abstract class C', k, ' extends B', k % 50, IF(n > 0, concat(' implements ', {listed('I', 'n')}), ''), ' {{ ', IF(t > 0, concat('use ', {listed('T', 't')}, IF(t % 2 = 0, ';', ' {{ a as b; }}')), ''),
        ' public function m($a): ', array_join(transform(sequence(1, n + 1), i -> concat('R', i)), ' | '), ' {{ }} }}\\ninclude ', repeat('dirname(', d), '__FILE__', repeat(')', d), ' . "/inc/x', k % 7, '.php";')""")
    rows = read(spark, d, "part").selectExpr("p_partkey AS k", "p_size % 41 AS n", "cast(p_partkey % 31 AS int) AS t", "cast(p_partkey % 4 AS int) AS d")
    nodes, edges = php.entities(rows.select(F.format_string("d/p%s.php", "k").alias("path"), content.alias("content")))
    returns = nodes.where("type = 'method'").select(F.col("id").alias("source"), F.lit("returns").alias("type"), F.col("metadata.return_type").alias("target"))
    return edges.where("type IN ('extends', 'implements', 'uses_trait', 'includes')").select("source", "type", "target").union(returns)


@query("sc12_broken_files", """SELECT 'p' || page_id || '.php' AS path, page_id % 5 + 1 AS line, CASE page_id % 4 WHEN 1 THEN 'a string is not closed' WHEN 2 THEN 'unexpected }' ELSE '( is not closed' END AS error FROM pages WHERE page_id % 4 > 0""")
def _(spark, d):
    from graphloom.sources import php

    content = F.expr("concat('<?php', repeat('\n', cast(page_id % 5 AS int)), ' $a = f(', page_id, CASE page_id % 4 WHEN 0 THEN ');' WHEN 1 THEN ', ''open);' WHEN 2 THEN ') }' ELSE ';' END)")
    files = read(spark, d, "pages").select(F.format_string("p%s.php", "page_id").alias("path"), content.alias("content"))
    return php.entities_and_errors(files)[2].withColumn("line", F.col("line").cast("bigint"))


@query("ex29_ex37_js_forms", """SELECT 'p' || page_id || '.tsx' AS file, 'file' AS type, 'p' || page_id || '.tsx' AS label FROM pages UNION ALL SELECT 'p' || page_id || '.tsx', CASE page_id % 4 WHEN 0 THEN 'react_component' WHEN 1 THEN 'js_api_call' WHEN 2 THEN 'js_function' ELSE 'js_hook' END,
    CASE page_id % 4 WHEN 0 THEN 'V' || page_id WHEN 1 THEN 'PUT /v/' || page_id WHEN 2 THEN 'F' || page_id ELSE 'h' || (page_id % 9) END FROM pages UNION ALL SELECT 'p' || page_id || '.tsx', 'react_hook', 'useStuff' || page_id FROM pages WHERE page_id % 4 = 2 UNION ALL SELECT 'p' || page_id || '.tsx', 'fetch_call', 'GET /in/' || page_id FROM pages WHERE page_id % 4 = 0""")
def _(spark, d):
    from graphloom.sources import js

    forms = r"""element_at(array(
        'const V%: React.FC<P<string>> = ({ a }: P): JSX.Element => <p title="it''s {no}">Don''t <b>{`a@{`b@{fetch("/in/%")}`}`}</b></p>;\nconst n: Array<{ k: string }> = [];',
        'apiFetch<Item[]>({ path: `/v/%`, method: "PUT" }); const r = /[''"`<]/.test(a < 3 && b > (2));',
        'export function F%<T>(x: T): T { return useStuff%<T>(x); }',
        'const pick: (x: number) => void = (x) => { doAction(`h@{x}`); wp.hooks.doAction("h#"); };'), cast(page_id % 4 AS int) + 1)"""
    content = F.expr(f"replace(replace(replace({forms}, '%', page_id), '#', page_id % 9), '@', char(36))")
    files = read(spark, d, "pages").select(F.format_string("p%s.tsx", "page_id").alias("path"), content.alias("content"))
    return js.entities(files, files.select("path"))[0].select(F.regexp_replace("file", "^/plugin/", "").alias("file"), "type", "label")


@query("ex39_js_nodes", "SELECT 'p' || page_id || '.js' AS file, type, label FROM pages, (VALUES ('file', 'p'), ('js_function', 'run'), ('react_component', 'View'), ('js_api_call', 'POST /v/'), ('js_hook', 'go')) v(type, l), LATERAL (SELECT CASE type WHEN 'file' THEN 'p' || page_id || '.js' WHEN 'js_api_call' THEN l || (page_id % 9) WHEN 'js_hook' THEN l || (page_id % 4) ELSE l END AS label)")
def _(spark, d):
    from graphloom.sources import js

    content = F.expr("concat('function run() { apiFetch({ path: `/v/', page_id % 9, '`, method: \"post\" }); }\nconst View = () => <p>{run()}</p>;\nwp.hooks.doAction(\"go', page_id % 4, '\");')")
    files = read(spark, d, "pages").select(F.format_string("p%s.js", "page_id").alias("path"), content.alias("content"))
    nodes = js.entities(files, files.select("path"))[0]
    return nodes.select(F.regexp_replace("file", "^/plugin/", "").alias("file"), "type", "label")


@query("sc14_block_files", "SELECT 'block_n-' || s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN s_name ELSE 'n-' || s_suppkey END AS label FROM supplier WHERE s_suppkey % 4 < 2")
def _(spark, d):
    from graphloom.sources import blocks

    content = F.expr("CASE s_suppkey % 4 WHEN 0 THEN concat('{\"name\": \"n-', s_suppkey, '\", \"title\": \"', s_name, '\", \"script\": [\"a\", \"b\"], \"attributes\": {\"x\": [1]}}') WHEN 1 THEN concat('{\"name\": \"n-', s_suppkey, '\"}') WHEN 2 THEN '{\"title\": \"nameless\"}' ELSE '{\"name\": ' END")
    files = read(spark, d, "supplier").select(F.format_string("b%s/block.json", "s_suppkey").alias("path"), content.alias("content"))
    return blocks.entities(files)[0].where("type = 'gutenberg_block'").select("id", "label")


@query("ga4_cycle_nodes", f"WITH RECURSIVE {TRANSITIONS}, walk(a, b) AS (SELECT source, target FROM te UNION SELECT a, target FROM walk JOIN te ON b = source) SELECT a AS id FROM walk WHERE a = b")
def _(spark, d):
    return algorithms.cycle_nodes(graphs.transitions(spark, d))


TRADE = """te AS (SELECT DISTINCT 'part_' || l_partkey AS source, 'supplier_' || l_suppkey AS target FROM lineitem UNION SELECT 'supplier_' || s_suppkey, 'part_' || s_suppkey FROM supplier WHERE s_suppkey % 3 > 0)"""


@query("ga4_trade_cycles", f"WITH RECURSIVE {TRADE}, inner_ AS (SELECT * FROM te WHERE source IN (SELECT target FROM te) AND target IN (SELECT source FROM te)), walk(a, b) AS (SELECT source, target FROM inner_ UNION SELECT a, target FROM walk JOIN inner_ ON b = source) SELECT a AS id FROM walk WHERE a = b")
def _(spark, d):
    link = lambda a, k, b, m: [F.concat(F.lit(f"{a}_"), F.col(k).cast("string")).alias("source"), F.concat(F.lit(f"{b}_"), F.col(m).cast("string")).alias("target")]
    there = read(spark, d, "lineitem").select(*link("part", "l_partkey", "supplier", "l_suppkey"))
    return algorithms.cycle_nodes(there.union(read(spark, d, "supplier").where("s_suppkey % 3 > 0").select(*link("supplier", "s_suppkey", "part", "s_suppkey"))))


@query("ga3_components", f"WITH RECURSIVE {PLACES}, pair AS (SELECT source AS a, target AS b FROM pe UNION SELECT target, source FROM pe), walk(id, r) AS (SELECT id, id FROM pn UNION SELECT walk.id, b FROM walk JOIN pair ON r = a) SELECT id, min(r) AS component FROM walk GROUP BY id")
def _(spark, d):
    return algorithms.weak_components(place_nodes(spark, d), place_edges(spark, d))


_RANKS = ["r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM pn) AS rank FROM pn), outs AS (SELECT source, count(*) AS n FROM pe GROUP BY source)"]
for _i in range(10):
    _RANKS.append(f"g{_i} AS MATERIALIZED (SELECT target AS id, sum(rank / n) AS got FROM pe JOIN outs USING (source) JOIN r{_i} ON r{_i}.id = source GROUP BY target), r{_i + 1} AS MATERIALIZED (SELECT id, 0.15 / (SELECT count(*) FROM pn) + 0.85 * (coalesce(got, 0) + (SELECT sum(rank) FROM r{_i} WHERE id NOT IN (SELECT source FROM outs)) / (SELECT count(*) FROM pn)) AS rank FROM pn LEFT JOIN g{_i} USING (id))")


@query("ga2_pagerank", f"WITH {PLACES}, {', '.join(_RANKS)} SELECT id, round(rank / (SELECT max(rank) FROM r10), 6) AS importance, CASE WHEN rank / (SELECT max(rank) FROM r10) >= 0.6 THEN 'key' WHEN rank / (SELECT max(rank) FROM r10) >= 0.2 THEN 'standard' ELSE 'supporting' END AS tier FROM r10")
def _(spark, d):
    nodes, edges = place_nodes(spark, d), place_edges(spark, d)
    scores = algorithms.importance(nodes, algorithms.pagerank(nodes, edges, 10), nodes.where("false"))
    return scores.select("id", F.round("importance", 6).alias("importance"), "tier")


@query("ga3_all_components")
def _(spark, d):
    # Links are joined in tasks before anything moves, so repeats cost less than making edges distinct.
    return algorithms.weak_components(star_nodes(spark, d), star_edges(spark, d, repeats=True))


@query("ga2_all_pagerank")
def _(spark, d):
    nodes, edges = star_nodes(spark, d), star_edges(spark, d)
    scores = algorithms.importance(nodes, algorithms.pagerank(nodes, edges), nodes.where(F.col("id") == F.expr(USED)), "region.tbl")
    return scores.select("id", F.round("importance", 6).alias("importance"), "tier")


@query("ga1_dfs_cycles")
def _(spark, d):
    edges = graphs.transitions(spark, d)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    cycles = algorithms.dfs_cycles(edges, algorithms.weak_components(nodes, edges))
    return cycles.select("component", "nth", F.array_join("path", ">").alias("path"))


@query("jn16_cycle_edges")
def _(spark, d):
    edges = graphs.transitions(spark, d)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return algorithms.cycle_edges(algorithms.dfs_cycles(edges, algorithms.weak_components(nodes, edges)), edges)


@query("pr10_edge_notes", "SELECT l_orderkey, l_linenumber, concat_ws(', ', l_returnflag, CASE WHEN l_linenumber <> 10 THEN 'priority ' || l_linenumber END, l_linestatus) AS note FROM lineitem")
def _(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.edge_note(F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_linestatus"), F.lit(None).cast("string")).alias("note"))


@query("pr12_host_path", "SELECT page_id, '/srv/x/' || page_id || '.php:' || (page_id + 1) AS path FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("page_id", text.host_path(F.concat(F.lit("/plugin/"), F.col("page_id").cast("string"), F.lit(".php")), F.col("page_id") + 1, "/srv/x").alias("path"))


@query("sk1_export")
def _(spark, d):
    from graphloom.operators.export import node_documents

    return node_documents(star_nodes(spark, d))


@query("sk1_document", f"""WITH {NODES}, {EDGES}, n AS (SELECT id, label, type, file, is_library, row_number() OVER (ORDER BY id) - 1 AS n FROM nodes), e AS (SELECT source || '>' || type || '>' || target AS id, source, target, type, row_number() OVER (ORDER BY source, type, target) - 1 AS n FROM edges)
    SELECT 0 AS section, 0 AS n, '{{"plugin":{{"name":"star"}},"nodes":[' AS text UNION ALL SELECT 2, 0, '],"edges":[' UNION ALL SELECT 4, 0, '],"cycles":[' UNION ALL SELECT 6, 0, ']}}'
    UNION ALL SELECT 1, n, CASE WHEN n > 0 THEN ',' ELSE '' END || to_json(struct_pack(data := struct_pack(id := id, label := label, type := type, file := file, is_library := is_library)))::VARCHAR FROM n
    UNION ALL SELECT 3, n, CASE WHEN n > 0 THEN ',' ELSE '' END || to_json(struct_pack(data := struct_pack(id := id, source := source, target := target, type := type)))::VARCHAR FROM e""")
def _(spark, d):
    from graphloom.operators.export import document_lines

    nodes = star_nodes(spark, d)
    plugin = read(spark, d, "region").agg(F.lit("star").alias("name"))
    cycles = nodes.where("false").select(F.col("id").alias("component"), F.lit(0).alias("nth"), F.array("id").alias("path"))
    return document_lines(plugin, nodes, star_edges(spark, d), cycles, (["id"], ["source", "type", "target"]), F.concat_ws(">", "source", "type", "target"))


assert set(catalog.STRUCTURAL_EDGES) <= {t for t, _, _ in catalog.EDGE_TYPES}
