"""Graph operators on small graphs, and every registered graph query against its SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import plans
from graphloom.functions import text
from graphloom.operators import algorithms, build, describe, export, lineage, views, xref
from graphloom.sources import blocks, tree

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels".split()


def rows(df):
    return sorted((tuple(None if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df), key=str)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, DATA)
    want = duck.sql(plans.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert rows(got.select(order).collect()) == rows(want.select(*[f'"{c}"' for c in order]).fetchall())


def graph(spark, links):
    return spark.createDataFrame([(a, b, "calls", i) for i, (a, b) in enumerate(links)], "source string, target string, type string, seq long")


@pytest.mark.parametrize(
    ("links", "lengths"),
    [([("A", "B"), ("B", "C")], []), ([("A", "B"), ("B", "A")], [3]), ([("A", "B"), ("B", "C"), ("C", "A")], [4]), ([("A", "B"), ("B", "A"), ("C", "D"), ("D", "C")], [3, 3]), ([("A", "A")], [2])],
)
def test_cycles(spark, links, lengths):
    edges = graph(spark, links)
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    cycles = algorithms.dfs_cycles(edges, algorithms.weak_components(nodes, edges)).collect()
    assert sorted(len(c.path) for c in cycles) == lengths
    assert all(c.path[0] == c.path[-1] for c in cycles)
    assert {r.id for r in algorithms.cycle_nodes(edges).collect()} == {x for c in cycles for x in c.path}


def test_cycle_labels_and_edges(spark):
    edges = graph(spark, [("func_a", "func_b"), ("func_b", "func_a")])
    cycles = spark.createDataFrame([("func_a", 0, ["func_a", "func_b", "func_a"])], "component string, nth int, path array<string>")
    nodes = spark.createDataFrame([("func_a", "A")], "id string, label string")
    assert algorithms.cycle_labels(cycles, nodes).first().text == "A → b → A"
    assert algorithms.cycle_edges(cycles, edges).count() == 2


@pytest.mark.parametrize(
    ("call", "route", "found"),
    [("/Shop/v2/Carts/", "shop/v2/carts", True), ("shop/v2/carts/7/lines?x=1", r"shop/v2/carts/(?P<cart>[a-z0-9]+)", True), ("https://h.test/wp-json/shop/v2/carts#top", "/shop/v2/carts", True), ("/shop/v2/cartsale", "shop/v2/carts", False), ("/shop/v2", "shop/v2/carts", False), (None, "shop/v2/carts", False)],
)
def test_endpoints(spark, call, route, found):
    calls = spark.createDataFrame([("c", call)], "id string, route string")
    ends = spark.createDataFrame([("e", route, 0)], "id string, route string, seq long")
    assert xref.match_endpoints(calls, ends).count() == found


def test_actions(spark):
    calls = spark.createDataFrame([("a", "/site/admin-ajax.php?x=2&action=mine"), ("b", "https://h.test/a/admin-ajax.php?action=submit"), ("c", "https://h.test/?action=mine"), ("d", "/admin-ajax.php")], "id string, route string")
    handlers = spark.createDataFrame([("h1", "wp_ajax_mine", 0), ("h2", "wp_ajax_nopriv_submit", 1), ("h3", "wp_ajax_nopriv_mine", 2)], "id string, hook_name string, seq long")
    assert {(r.id, r.handler) for r in xref.match_actions(calls, handlers).collect()} == {("a", "h1"), ("b", "h2")}


LIBRARY = [
    ("class", "Ledger", "/plugin/inc/Ledger.php", False), ("class", "Box", "/plugin/inc/vendor/box.css", True), ("class", "Box", "/plugin/inc/External/box.css", True), ("class", "Box", "/plugin/inc/externally/box.css", False), ("class", "Box", "/plugin/vendor", False),
    ("function", "go", "/plugin/web/chart-4.4.js", True), ("function", "go", "/plugin/web/chart.js", True), ("function", "go", "/plugin/web/charting.js", False), ("function", "go", "/plugin/web/Swiper.min.js", True), ("function", "go", "/plugin/web/chart.php", False),
    ("function", "go", "/plugin/vite.config.js", True), ("function", "go", "/plugin/vite.config.php", False), ("function", "go", "/plugin/inc/Mustache.php", True), ("function", "go", "/plugin/inc/mustache-view.php", False),
    ("js_function", "ab", "/plugin/a.js", True), ("js_function", "abc", "/plugin/a.js", False), ("js_class", "é", "/plugin/a.js", True), ("function", "ab", "/plugin/a.php", False), ("js_function", "abc", "/plugin/web/grid-3.0/core/a.js", True), ("js_function", "abc", "/plugin/web/grid-3/a.js", False),
]


def test_library_tags(spark):
    nodes = spark.createDataFrame(LIBRARY, "type string, label string, file string, want boolean")
    assert [r for r in build.tagged_nodes(nodes).where("is_library != want").collect()] == []


def test_first_and_last_write(spark):
    nodes = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "b")], "id string, seq long, label string").withColumns({"type": F.lit("class"), "file": F.lit("x.php")})
    edges = spark.createDataFrame([("a", "b", "calls", 1, "first"), ("a", "b", "calls", 5, "last"), ("a", "gone", "calls", 2, "x")], "source string, target string, type string, seq long, label string")
    kept, links = build.build_graph(nodes, edges)
    assert {(r.id, r.label) for r in kept.collect()} == {("a", "early"), ("b", "b")}
    assert [(r.id, r.seq, r.label) for r in links.collect()] == [("e_0", 1, "last")]


def test_source_scan(spark):
    src = spark.createDataFrame([("if (current_user_can('edit_posts')) { wp_verify_nonce($n); esc_html($a); absint($b); esc_html($c); }",), ("user_can($u, 'manage_x')",), ("nothing",)], "s string")
    got = src.select(text.capability(F.col("s")), text.verifies_nonce(F.col("s")), text.count_calls(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("edit_posts", True, 3), ("manage_x", False, 0), (None, False, 0)]


def test_doc_summary(spark):
    docs = spark.createDataFrame([("/**\n * Does it.\n * And more.\n *\n * Not this.\n * @param x\n */",), ("/** @return int */",), ("Plain line\nnext",), ("/** One line. */",)], "s string")
    assert [r[0] for r in docs.select(text.doc_summary(F.col("s"))).collect()] == ["Does it. And more.", None, "Plain line", "One line."]


def test_sanitize_id_sees_bytes(spark):
    assert spark.createDataFrame([("É a/b",)], "s string").select(text.sanitize_id(F.col("s"))).first()[0] == "___a_b"


def test_scan(spark, tmp_path):
    for name, body in {"demo.php": "<?php\n/* Plugin Name: Demo\nVersion: 1.2 */", "a/log.js": "let a = 1;\n", "catalog.js": "let c;\n", "x.min.js": "x", "vendor/v.php": "<?php", "gen.js": "// Code generated, do not edit\n", "block.json": '{"name": "demo/hero", "title": "Hero", "script": "file:./a.js"}', "b.txt": "no", "long.js": "x" * 5000}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(body)
    kept = tree.analysed(tree.read_tree(spark, str(tmp_path)), ["log.js", "# no"], strict=True)
    assert {r.path for r in kept.collect()} == {"demo.php", "catalog.js", "block.json"}
    assert tuple(tree.main_file(kept, "demo").select("path", "name", "version").first()) == ("demo.php", "Demo", "1.2 */")
    block = blocks.entities(kept.where("kind = 'block'").select("path", "content"))[0].where("type = 'gutenberg_block'").first()
    assert (block.id, block.label, block.metadata.js_assets) == ("block_demo_hero", "Hero", {"script": "file:./a.js"})
    assert {r.path for r in tree.analysed(tree.read_tree(spark, str(tmp_path)), ["log.js", "# no"]).collect()} == {"demo.php", "block.json"}


def test_imports(spark):
    imports = spark.createDataFrame([("src/a.js", "./b"), ("src/a.js", "../lib"), ("src/a.js", "react"), ("src/a.js", "./gone")], "path string, name string")
    files = spark.createDataFrame([("src/b.ts",), ("src/b.js",), ("lib/index.js",)], "path string")
    assert {(r.name, r.target) for r in tree.resolve_imports(imports, files).collect()} == {("./b", "src/b.js"), ("../lib", "lib/index.js")}


def test_replies(spark):
    def client(payload):
        if "bad" in payload:
            raise RuntimeError
        return 'Sure: ```json\n{"a": "A text"}\n```'

    told = describe.ask(spark.createDataFrame([(0, "ok"), (1, "bad")], "batch long, payload string"), client)
    nodes = spark.createDataFrame([("a", None), ("b", "old")], "id string, description string")
    assert {tuple(r) for r in describe.with_replies(nodes, told).select("id", "description").collect()} == {("a", "A text"), ("b", "old")}


def test_export(spark):
    nodes = spark.createDataFrame([("a", None, None), ("b", "B", "ns_x")], "id string, label string, parent string")
    assert {r.document for r in export.node_documents(nodes).collect()} == {'{"data":{"id":"a","label":null}}', '{"data":{"id":"b","label":"B","parent":"ns_x"}}'}


def test_no_cartesian_product_in_route_match(spark):
    calls = spark.createDataFrame([("c", "/a/b")], "id string, route string")
    ends = spark.createDataFrame([("e", "a", 0)], "id string, route string, seq long")
    plan = xref.match_endpoints(calls, ends)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_unlinked_and_connections(spark):
    nodes = spark.createDataFrame([("a", "A", "class"), ("b", "B", "class"), ("c", "C", "class"), ("n", "N", "namespace")], "id string, label string, type string")
    edges = graph(spark, [("a", "b"), ("b", "gone")])
    assert [r.id for r in views.unlinked(nodes, edges).collect()] == ["c"]
    assert {(r.direction, r.label) for r in views.connections(nodes, edges, "b").collect()} == {("in", "A"), ("out", "gone")}


def test_whole_graph_queries_against_brute_force(spark, tmp_path):
    tables = {
        "region": ([(i, f"R{i}") for i in range(5)], "r_regionkey long, r_name string"),
        "nation": ([(i, f"N{i}", i % 5) for i in range(7)], "n_nationkey long, n_name string, n_regionkey long"),
        "supplier": ([(i, f"S{i}", i % 7) for i in range(9)], "s_suppkey long, s_name string, s_nationkey long"),
        "customer": ([(i, f"C{i}", i % 4) for i in range(6)], "c_custkey long, c_name string, c_nationkey long"),
        "part": ([(i, f"P{i}", i) for i in range(12)], "p_partkey long, p_name string, p_size int"),
        "orders": ([(i, "O", i % 6) for i in range(8)], "o_orderkey long, o_orderstatus string, o_custkey long"),
        "lineitem": ([(i, i, i % 9) for i in range(8)], "l_orderkey long, l_partkey long, l_suppkey long"),
    }
    for name, (data, kind) in tables.items():
        spark.createDataFrame(data, kind).write.parquet(f"{tmp_path}/{name}.parquet")
    t = {name: data for name, (data, _) in tables.items()}
    places = [f"{k}_{r[0]}" for k in ("region", "nation", "supplier", "customer", "part") for r in t[k]] + [f"order_{r[0]}" for r in t["orders"]]
    links = [(f"nation_{a}", f"region_{c}") for a, _, c in t["nation"]] + [(f"{k}_{a}", f"nation_{c}") for k in ("supplier", "customer") for a, _, c in t[k]]
    links += [(f"order_{a}", f"customer_{c}") for a, _, c in t["orders"]] + [x for o, p, s in t["lineitem"] for x in ((f"order_{o}", f"part_{p}"), (f"part_{p}", f"supplier_{s}"))]

    label = {i: i for i in places}
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = plans.QUERIES["ga3_all_components"](spark, str(tmp_path)).collect()
    assert {(r.id, r.component) for r in got} == set(label.items())

    n, rank, out = len(places), dict.fromkeys(places, 1 / len(places)), dict.fromkeys(places, 0)
    for a, _ in links:
        out[a] += 1
    for _ in range(50):
        lost = sum(v for i, v in rank.items() if not out[i])
        new = dict.fromkeys(places, 0.15 / n + 0.85 * lost / n)
        for a, b in links:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    score = {i: v + 0.15 * (i == "nation_3") + 0.25 * i.startswith("region_") for i, v in rank.items()}
    got = {r.id: r.importance for r in plans.QUERIES["ga2_all_pagerank"](spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(v / max(score.values()), abs=2e-6) for i, v in score.items()}
    assert plans.QUERIES["sk1_export"](spark, str(tmp_path)).count() == n


def test_replies_badges_and_summary(spark):
    from graphloom.operators import describe

    replies = spark.createDataFrame([(0, 'so {"a": "x", "b": "y"} end'), (1, '{"entity_ids": ["a", "b", "c"], "descriptions": ["x", null]}'), (2, "none"), (3, None)], "i int, reply string")
    assert {r.i: r.m for r in replies.select("i", describe.parse_reply(F.col("reply")).alias("m")).collect()} == {0: {"a": "x", "b": "y"}, 1: {"a": "x"}, 2: None, 3: None}
    meta = "id string, seq long, label string, type string, description string, metadata struct<capability:string,nonce_verified:boolean,sanitization_count:int>"
    rows = [("a", 0, "A", "rest_endpoint", "first", ("__return_true", None, 2)), ("b", 1, "B", "method", "", ("edit", True, 0)), ("c", 2, "C", "class", "third", ("edit", True, 1)), ("d", 3, "D", "function", None, (None, None, None)), ("e", 4, "E", "ajax_handler", "fifth", (None, None, 1))]
    nodes = spark.createDataFrame(rows, meta)
    assert {r.id: r.b for r in nodes.select("id", describe.badges().alias("b")).collect()} == {"a": ["public", "no nonce", "sanitize 2"], "b": ["capability edit", "nonce"], "c": [], "d": [], "e": ["no nonce", "sanitize 1"]}
    asked, plugin = [], spark.createDataFrame([("Kit", "1")], "name string, version string")
    assert describe.summary(plugin, nodes, nodes.select("id"), lambda x: asked.append(x) or "é" * 26 + " ") == "é" * 26
    assert '"[class] C: third", "[rest_endpoint] A: first", "[ajax_handler] E: fifth"' in asked[0] and '"Kit"' in asked[0]
    assert describe.summary(plugin.where("false"), nodes, nodes, lambda x: "short") is None and describe.summary(plugin, nodes, nodes, lambda x: 1 / 0) is None


def test_nodes_on_cycles_by_brute_force(spark):
    import random

    rng = random.Random(8)
    for n, m in ((6, 8), (12, 14), (12, 20), (30, 34)):
        links = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}
        reach = {a: {b for x, b in links if x == a} for a, _ in links}
        for _ in range(n):
            reach = {a: bs | {c for b in bs for c in reach.get(b, ())} for a, bs in reach.items()}
        got = {r.id for r in algorithms.cycle_nodes(spark.createDataFrame(sorted(links), "source string, target string")).collect()}
        assert got == {a for a, bs in reach.items() if a in bs}


def test_cycles_of_trimmed_graphs_are_those_of_whole_ones(spark):
    import random

    rng = random.Random(3)
    for n, m in ((5, 9), (9, 12), (14, 30)):
        links = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
        edges = spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(links)], "source string, target string, seq long")
        whole = spark.createDataFrame([(f"n{i}", "all") for i in range(n)], "id string, component string")
        got = [r.path for r in algorithms.dfs_cycles(edges, whole).orderBy("nth").collect()]
        assert got == algorithms.search_cycles(links)


def random_graphs(rng, count, most):
    links = []
    for g in range(count):
        n = rng.randrange(2, most)
        links += [(f"g{g}n{rng.randrange(n)}", f"g{g}n{rng.randrange(n)}") for _ in range(rng.randrange(1, 2 * n))]
    return links


def test_nodes_on_cycles_of_3000_random_graphs(spark):
    import random

    links, after = random_graphs(random.Random(8), 3000, 12), {}
    for a, b in links:
        after.setdefault(a, set()).add(b)
    want = set()
    for start in after:
        seen, todo = set(), list(after[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        want |= {start} & seen
    assert {r.id for r in algorithms.cycle_nodes(spark.createDataFrame(links, "source string, target string")).collect()} == want


@pytest.mark.parametrize(("target", "found"), [("(id + 1) % 100000", 100_000), ("id + 1", 0)])
def test_long_rings_and_chains_take_few_rounds(spark, monkeypatch, target, found):
    rounds = []
    monkeypatch.setattr(algorithms, "cut", lambda df, *gone: rounds.append(df) or lineage.cut(df, *gone))
    edges = spark.range(100_000).selectExpr("concat('n', id) AS source", f"concat('n', {target}) AS target")
    assert algorithms.cycle_nodes(edges).count() == found and len(rounds) < 40


def test_pagerank_of_1000_random_graphs(spark):
    import random

    import numpy as np

    links = sorted(set(random_graphs(random.Random(2), 1000, 9)))
    names = sorted({x for e in links for x in e} | {"alone"})
    at = {x: i for i, x in enumerate(names)}
    source, target = (np.array([at[e[k]] for e in links]) for k in (0, 1))
    out, rank = np.bincount(source, minlength=len(names)), np.full(len(names), 1 / len(names))
    for _ in range(12):
        got = np.bincount(target, rank[source] / out[source], len(names))
        rank = 0.15 / len(names) + 0.85 * (got + rank[out == 0].sum() / len(names))
    nodes = spark.createDataFrame([(x,) for x in names], "id string")
    edges = spark.createDataFrame([*links, ("alone", "unknown"), ("unknown", "alone")], "source string, target string")
    found = {r.id: r["rank"] for r in algorithms.pagerank(nodes, edges, 12).collect()}
    assert np.allclose([found[x] for x in names], rank, rtol=1e-9) and abs(sum(found.values()) - 1) < 1e-9
    assert algorithms.pagerank(nodes.where("false"), edges, 2).count() == 0
    only = {r.id: r["rank"] for r in algorithms.pagerank(nodes.limit(2), edges.where("false"), 3).collect()}
    assert np.allclose(list(only.values()), 0.5)


def test_pagerank_ends_with_the_longest_walk(spark, monkeypatch):
    written, cut = [], algorithms.cut
    monkeypatch.setattr(algorithms, "cut", lambda df, *gone: written.append(1) or cut(df, *gone))
    links = [(f"o{i}", f"p{i % 7}") for i in range(40)] + [(f"p{i}", f"s{i % 3}") for i in range(7)] + [("s0", "n"), ("s1", "n"), ("o1", "gone")]
    names = sorted({x for e in links for x in e} - {"gone"})
    rank, known = dict.fromkeys(names, 1 / len(names)), [e for e in links if "gone" not in e]
    for _ in range(50):
        out = {a: sum(x == a for x, _ in known) for a in names}
        lost = sum(v for a, v in rank.items() if not out[a])
        rank = {b: (0.15 + 0.85 * lost) / len(names) + 0.85 * sum(rank[a] / out[a] for a, x in known if x == b) for b in names}
    nodes = spark.createDataFrame([(x,) for x in names], "id string")
    got = {r.id: r["rank"] for r in algorithms.pagerank(nodes, graph(spark, links)).collect()}
    assert got == {k: pytest.approx(v, rel=1e-9) for k, v in rank.items()} and len(written) < 10


def test_whole_graph_steps_are_tables_of_fine_shuffles(spark, monkeypatch):
    from graphloom.operators import build, lineage, views

    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before, seen, drop = spark.conf.get(name, None), [], lineage.drop
    monkeypatch.setattr(lineage, "drop", lambda *gone: seen.append(spark.conf.get(name, None)) or drop(*gone))
    with lineage._held(spark, lineage.FINE, lineage._FINE_USERS):
        assert spark.conf.get(name) == "1024"
    nodes = spark.createDataFrame([("a", "A", "class", "x", False, 1), ("b", "B", "class", "y", False, 2)], "id string, label string, type string, file string, is_library boolean, seq long")
    edges = spark.createDataFrame([("a", "b", "calls", 1), ("a", "gone", "calls", 2)], "source string, target string, type string, seq long")
    for df in (build.first_nodes(nodes), build.merged_edges(edges), build.intact_edges(nodes, edges), views.focus(nodes, edges)[1]):
        assert "/tables/" in df.scratch_path and df.count() in (1, 2)
    assert seen and set(seen) == {before} and spark.conf.get(name, None) == before


def test_document_lines_join_nothing(spark):
    from graphloom.operators.export import document_lines

    nodes = spark.createDataFrame([("a", 0, "x"), ("a", 1, "y")], "id string, seq long, label string")
    edges = spark.createDataFrame([("e", 0, "a", "a"), ("e", 1, "a", "b")], "id string, seq long, source string, target string")
    cycles = nodes.where("false").select(F.col("id").alias("component"), F.lit(0).alias("nth"), F.array("id").alias("path"))
    lines = document_lines(spark.createDataFrame([("p",)], "name string"), nodes, edges, cycles).orderBy("section", "n").collect()
    assert [r.text for r in lines if r.section == 1] == ['{"data":{"id":"a","label":"x"}}', ',{"data":{"id":"a","label":"y"}}']
    assert [r.text for r in lines if r.section == 3] == ['{"data":{"id":"e","source":"a","target":"a"}}', ',{"data":{"id":"e","source":"a","target":"b"}}']


def tables_of(spark, make):
    """What make() returns, and the columns of each table that it wrote."""
    root = lineage.scratch_dir(spark).removeprefix("file:")
    before = set(os.listdir(root))
    out = make()
    return out, sorted(sorted(spark.read.parquet(f"{root}/{x}").columns) for x in set(os.listdir(root)) - before)


def test_documents_are_written_once_and_without_texts(spark):
    nodes = spark.createDataFrame([("a", 0, "x"), ("b", 1, "y")], "id string, seq long, n string")
    edges = spark.createDataFrame([("b", "a", "t"), ("a", "b", "t"), ("a", "b", "s")], "source string, target string, type string")
    cycles = spark.createDataFrame([("a", 0, ["a", "b", "a"])], "component string, nth int, path array<string>")
    plugin = spark.createDataFrame([("p",)], "name string")
    _, columns = tables_of(spark, lambda: export.document_lines(plugin, nodes, edges.selectExpr("*", "source AS id", "struct(source, type, target) AS seq"), cycles))
    assert columns == [["component", "nth", "part__", "path"], ["id", "n", "part__", "seq"], ["id", "part__", "seq", "source", "target", "type"]]
    lines, columns = tables_of(spark, lambda: export.document_lines(plugin, nodes, edges, cycles, (["seq"], ["source", "type", "target"]), F.concat_ws(">", "source", "type", "target")))
    assert columns == [["component", "nth", "part__", "path"], ["id", "n", "part__", "seq"], ["part__", "source", "target", "type"]]
    texts = [(r.section, r.n, r.text) for r in lines.orderBy("section", "n").collect()]
    assert [x for x in texts if x[0] == 1] == [(1, 0, '{"data":{"id":"a","n":"x"}}'), (1, 1, ',{"data":{"id":"b","n":"y"}}')]
    ends = lambda s, t, k: f'{{"data":{{"id":"{s}>{k}>{t}","source":"{s}","target":"{t}","type":"{k}"}}}}'
    assert [x for x in texts if x[0] == 3] == [(3, 0, ends("a", "b", "s")), (3, 1, "," + ends("a", "b", "t")), (3, 2, "," + ends("b", "a", "t"))]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_star_document_writes_no_derived_column(spark):
    _, columns = tables_of(spark, lambda: plans.QUERIES["sk1_document"](spark, DATA))
    assert columns == [["component", "nth", "part__", "path"], ["file", "id", "is_library", "label", "part__", "type"], ["part__", "source", "target", "type"]]


def test_numbers_follow_files_of_any_size(spark):
    """Sessions may ask for small files, and a file may be several splits."""
    small = {"spark.sql.files.maxRecordsPerFile": "7", "spark.sql.files.maxPartitionBytes": "600", "spark.sql.files.openCostInBytes": "1"}
    for few in ({}, small):
        with lineage._held(spark, few, []):
            got = lineage.numbered(spark.range(0, 300, 1, 5).selectExpr("id", "id % 10 AS a"), ["a", F.col("id").desc()], "nth", 3).collect()
        assert sorted((r.nth, r.id, r.a) for r in got) == [(i + 3, k, k % 10) for i, k in enumerate(sorted(range(300), key=lambda k: (k % 10, -k)))]
    assert lineage.numbered(spark.range(0), ["id"], "nth").collect() == []


@pytest.mark.parametrize("size", [1, 400, 1 << 26])
def test_components_are_those_of_a_plain_search(spark, monkeypatch, size):
    """Random graphs, chains in order and a clique, with repeats, loops, nulls and unknown nodes, in batches of any size."""
    import random

    monkeypatch.setattr(algorithms, "LINK_BYTES", size)
    rng = random.Random(size)
    links = random_graphs(rng, 60, 12) + [(f"c{i:03}", f"c{i + 1:03}") for i in range(120)] + [(f"k{i}", f"k{j}") for i in range(12) for j in range(i)]
    links += [("a", "a"), ("b", "gone"), ("gone", "c"), (None, "a"), ("a", None)] + links[::3]
    names = sorted({x for e in links for x in e if x} - {"gone"} | {"alone"})
    root = {x: x for x in names}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in links:
        if a in root and b in root:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    rng.shuffle(links)
    nodes = spark.createDataFrame([(x,) for x in [*names, "alone"]], "id string")
    got = algorithms.weak_components(nodes, graph(spark, links)).collect()
    assert sorted((r.id, r.component) for r in got) == sorted([*((x, find(x)) for x in names), ("alone", "alone")])
    assert algorithms.weak_components(nodes, graph(spark, links[:0])).where("id = component").count() == len(names) + 1


def test_components_join_links_in_tasks_before_they_move(spark):
    """Of links between few nodes a batch moves a row per node, and chains of 20,000 nodes end after few rounds."""
    links = spark.range(100_000).selectExpr("concat('n', id % 50) AS a", "concat('n', id % 49) AS b").coalesce(2)
    assert algorithms.leaders(links, "").count() == 100
    edges = spark.range(20_000).selectExpr("concat('n', id) AS source", "concat('n', id + 1) AS target").repartition(16)
    nodes = spark.range(20_001).selectExpr("concat('n', id) AS id")
    assert algorithms.weak_components(nodes, edges).where("component = 'n0'").count() == 20_001


def test_joins_of_whole_graphs_hash_small_parts(spark):
    from graphloom.operators import lineage

    no_broadcast = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    with lineage._held(spark, no_broadcast, []), lineage._held(spark, lineage.FINE, lineage._FINE_USERS):
        kept = spark.range(20_000).join(spark.range(0, 40_000, 3), "id", "left_semi")
        assert len(kept.collect()) == 6_667
        plan = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
