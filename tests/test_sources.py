"""Entities of PHP, JavaScript and block files, and the graph of a whole tree, on small sources of our own."""

import json

import pytest
from graphloom.plans import analyze
from graphloom.sources import tree

PHP = r"""<p>text before <?php
/**
 * Plugin Name: Shop Kit
 * Version: 2.1
 */
namespace Shop\Core;

interface Sells extends Countable {}
trait Logs { public function log() { get_option('from_trait'); } }

/** Keeps the cart. */
abstract class Cart extends \Base\Thing implements Sells, \Countable {
    use Logs, Other;
    private static function total(?int $n, int|string &$x = 3, ...$rest): ?array {
        // $ignored = get_option('in a comment'); '
        $a = new Order(); $b = new self(); $c = new class { };
        Store::open(); self::total(); helper($n, strlen('x'));
        update_post_meta($id, "size", 1);
        $wpdb->get_results("SELECT a FROM b"); $myPdo->exec($sql); $this->wpdb->query('no');
        return array('get_option(' => 1);
    }
    abstract protected function later(): void;
    public function hooks() {
        add_action('init', [$this, 'later'], 20);
        add_filter("the_body", array('Other', 'shape'));
        add_filter('the_tail', [Cart::class, 'shape'], $n);
        add_action('gone', function () { do_action('inner_hook', 1); });
        add_action('wp_ajax_buy', 'buy_now'); add_action('wp_ajax_buy', 'buy_more');
        remove_all_filters('old_filter'); do_action("dynamic_{$x}"); apply_filters($y, 1);
    }
}

function buy_now($id) {
    if (!current_user_can('edit_shop')) { return; }
    wp_verify_nonce($n); esc_html(absint($id));
    require_once __DIR__ . '/inc/../inc/more.php';
    wp_remote_post('https://pay.example/x', array('body' => 'y'));
    register_rest_route('shop/v1', '/items/(?P<id>\d+)', ['methods' => 'GET, POST', 'permission_callback' => function () { return current_user_can('read_shop'); }]);
}
include PLUGIN_PATH . 'inc/guess.php'; include $dynamic;
add_shortcode('cart', 'cart_short'); add_submenu_page('p', 'Orders', 'm', 'c', 'shop-orders'); wp_schedule_single_event(time(), 'shop_sync');
register_post_type('product'); register_taxonomy('brand', 'product'); wp_enqueue_script('shop-js'); wp_register_style('shop.css');
register_block_type('shop/badge'); register_block_type(__DIR__ . '/blocks'); register_block_type('/path'); set_transient('rate', 1); wp_cache_flush(); get_option($dyn);
$text = <<<EOT
function not_one() { get_option('heredoc'); }
EOT;
function cart_short() { return <<<'X'
 it's
X; }
?> after <?php do_action('late');
"""
JS = r"""import { select, useDispatch as ud, dispatch } from '@wordpress/data';
import thing from './lib/thing'; import './style.css'; import React from "react";
/* addAction('comment') */
wp.hooks.addAction( 'shop.start', 'ns', () => {} ); doAction(`shop.go`); removeFilter('shop.off'); applyFilters(`shop.${x}`);
registerBlockType('shop/badge', { edit: () => <p>Don't</p> });
class Basket extends React.Component { fetch() { return 1; } }
const Price = ({ n }) => <b>{n}</b>;
const Total = (a) => { const [s] = useState(0); return ( <b>{a / 2 / s}</b> ); };
const helper = (x) => x + 1;
function List() { useEffect(() => {}); const c = useContext(Theme.Ctx); useCart(); return cond ? <a/> : null; }
async function load() { const r = /['"]+/g; await apiFetch({ path: '/shop/v1/items/7', method: 'post' }); fetch('/wp-admin/admin-ajax.php?action=buy'); return r; }
axios.put(url); axios({ url: '/a', method: 'delete' }); $.ajax({ url: '/b', type: 'POST', data: { action: 'buy' } }); jQuery.post('/c', { action: 'z' }); new fetch('/no');
select('core/editor'); dispatch(`core/shop`); useDispatch('x'); wp.data.subscribe(() => {});
export default () => <Price/>;
"""
FILES = [
    ("kit.php", PHP), ("src/view.jsx", JS), ("src/lib/thing.ts", "export class Thing { run() {} }\nconst t = 'é';"), ("inc/more.php", "<?php function more() { buy_now(1); }"), ("inc/broken.php", "<?php function ( { ' unclosed"), ("inc/empty.php", ""),
    ("blocks/badge/block.json", json.dumps({"name": "shop/badge", "title": "Badge", "category": "widgets", "attributes": {"n": 1}, "render": "file:./render.php", "editorScript": "file:../../src/view.jsx", "script": "handle"})),
    ("blocks/bad/block.json", "{"), ("vendor/lib.php", "<?php function hidden() {}"), ("dist/app.js", "x"), ("src/out.js", "/* __webpack_require__ */"), ("skip/a1.php", "<?php function skipped() {}"),
]


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    g = analyze.analyze(files, "/plugin", ("skip/a[0-9].php",), "kit", strict=True)
    nodes = {r.id: r for r in g.nodes.collect()}
    edges = {(r.source, r.type, r.target): r for r in g.edges.collect()}
    return g, nodes, edges


def test_declarations(graph):
    _, nodes, edges = graph
    cart = nodes["class_Shop_Core_Cart"]
    assert (cart.type, cart.label, cart.metadata.namespace, cart.metadata.extends, cart.metadata.implements) == ("class", "Cart", "Shop\\Core", "Base\\Thing", ["Sells", "Countable"])
    assert cart.description == "Keeps the cart." and cart.source_preview.startswith("abstract class Cart")
    assert nodes["class_Shop_Core_Sells"].type == "interface" and nodes["class_Shop_Core_Logs"].type == "trait"
    assert ("class_Shop_Core_Cart", "uses_trait", "class_Shop_Core_Logs") in edges
    total = nodes["method_Cart_total"]
    assert total.metadata.visibility == "private" and total.metadata.return_type == "?array"
    assert [(p.name, p.type) for p in total.metadata.params] == [("$n", "?int"), ("$x", "int|string"), ("$rest", None)]
    assert nodes["method_Cart_later"].metadata.visibility == "protected" and nodes["method_Cart_later"].metadata.return_type == "void"
    assert ("class_Shop_Core_Cart", "has_method", "method_Cart_hooks") in edges
    assert {"func_buy_now", "func_cart_short", "func_more"} <= set(nodes) and not {"func_not_one", "func_hidden", "func_skipped", "func_log", "method_Logs_log"} & set(nodes)
    assert nodes["func_buy_now"].description == "Standalone PHP function accepting 1 parameter ($id)."
    assert ("func_more", "calls", "func_buy_now") in edges


def test_hooks(graph):
    _, nodes, edges = graph
    e = edges["method_Cart_later", "registers_hook", "hook_action_init"]
    assert (e.metadata.priority, e.metadata.hook_type) == (20, "action") and nodes["hook_action_init"].metadata.priority == 20
    assert ("func_buy_now", "registers_hook", "hook_action_wp_ajax_buy") in edges
    assert nodes["hook_filter_the_body"].subtype == "filter" and ("method_Other_shape", "registers_hook", "hook_filter_the_body") not in edges
    anonymous = [n for n in nodes if n.startswith("func_anonymous_")]
    assert len(anonymous) == 1 and nodes[anonymous[0]].label == "anonymous@kit.php:27"
    assert ("method_Cart_hooks", "triggers_hook", "hook_action_inner_hook") in edges and ("method_Cart_hooks", "deregisters_hook", "hook_filter_old_filter") in edges
    assert ("file_kit_php", "triggers_hook", "hook_action_late") in edges
    assert ("hook_action_wp_ajax_buy", "triggers_handler", "ajax_buy") in edges and not any("dynamic" in n for n in nodes if n.startswith("hook"))


def test_data_and_interfaces(graph):
    _, nodes, edges = graph
    assert edges["method_Cart_total", "writes_data", "data_write_size"].metadata.api_function == "update_post_meta"
    assert nodes["data_read_SELECT_a_FROM_b"].subtype == "database" and ("method_Cart_total", "writes_data", "data_write_database") in edges
    assert ("file_kit_php", "reads_data", "data_read_from_trait") in edges and nodes["data_write_rate"].subtype == "transient"
    assert not {"data_read_in_a_comment", "data_read_heredoc", "data_read_no"} & set(nodes)
    rest = nodes["rest_post_shop_v1_items___P_id__d__"]
    assert (rest.metadata.http_method, rest.metadata.route, rest.metadata.capability) == ("POST", r"shop/v1/items/(?P<id>\d+)", "read_shop")
    assert ("func_buy_now", "registers_rest", "rest_get_shop_v1_items___P_id__d__") in edges and rest.metadata.nonce_verified and rest.metadata.sanitization_count == 2
    assert nodes["func_buy_now"].metadata.capability == "edit_shop"
    for source, kind, target in (("file_kit_php", "registers_shortcode", "shortcode_cart"), ("file_kit_php", "registers_page", "admin_shop-orders"), ("file_kit_php", "schedules_cron", "cron_shop_sync"), ("file_kit_php", "registers_post_type", "post_type_product"), ("file_kit_php", "registers_taxonomy", "taxonomy_brand"), ("file_kit_php", "enqueues_script", "script_shop_js"), ("file_kit_php", "enqueues_style", "style_shop_css"), ("file_kit_php", "registers", "block_shop_badge"), ("method_Cart_hooks", "registers_ajax", "ajax_buy")):
        target = target.replace("admin_shop-orders", "admin_shop_orders")
        assert (source, kind, target) in edges, (source, kind, target)
    assert nodes["admin_shop_orders"].label == "Orders" and [n.label for n in nodes.values() if n.type == "http_call"] == ["POST https://pay.example/x"]
    assert ("func_buy_now", "includes", "file_inc_more_php") in edges and ("file_kit_php", "includes", "file_inc_guess_php") in edges


def test_scripts(graph):
    _, nodes, edges = graph
    view = "file__plugin_src_view_jsx"
    of = lambda t: sorted(n.label for n in nodes.values() if n.type == t)
    assert of("react_component") == ["(default export)", "List", "Price", "Total"] and of("js_function") == ["load"] and of("js_class") == ["Basket", "Thing"]
    assert [n.metadata.extends for n in nodes.values() if n.label == "Basket"] == ["React.Component"]
    assert of("js_hook") == ["shop.go", "shop.off", "shop.start"] and (view, "triggers_hook", "js_hook_action_shop_go") in edges and (view, "deregisters_hook", "js_hook_filter_shop_off") in edges
    assert of("react_hook") == ["useCart", "useContext(Theme.Ctx)", "useDispatch", "useEffect", "useState"]
    assert of("wp_store") == ["core/editor", "core/shop", "store subscription"] and (view, "writes_store", "wp_store_core_shop") in edges
    assert of("fetch_call") == ["GET /wp-admin/admin-ajax.php?action=buy", "POST /b", "POST /c"] and of("axios_call") == ["DELETE /a", "PUT (dynamic)"]
    assert [n.metadata.extra["wp_action"] for n in nodes.values() if n.label in ("POST /b", "POST /c")] in (["buy", "z"], ["z", "buy"])
    api = nodes["js_api_POST__shop_v1_items_7"]
    assert ((api.id, "calls_endpoint", "rest_get_shop_v1_items___P_id__d__")) in edges
    assert ("fetch_GET__wp-admin_admin-ajax_php_action_buy", "calls_ajax_handler", "ajax_buy") in edges
    assert (view, "imports", "file__plugin_src_lib_thing_ts") in edges and (view, "registers_block", "block_shop_badge") in edges


def test_blocks_groups_and_the_document(graph):
    g, nodes, edges = graph
    block = nodes["block_shop_badge"]
    assert (block.label, block.metadata.block_category, json.loads(block.metadata.block_attributes), block.metadata.namespace) == ("Badge", "widgets", {"n": 1}, "shop")
    assert ("block_shop_badge", "renders_block", "file__plugin_blocks_badge_render_php") in edges and ("block_shop_badge", "enqueues_script", "file__plugin_blocks_badge_src_view_jsx") in edges and ("block_shop_badge", "enqueues_script", "file_handle") in edges
    assert nodes["dir_src"].type == "dir" and nodes["ns_Shop_Core"].type == "namespace" and nodes["class_Shop_Core_Cart"].parent == "ns_Shop_Core"
    assert {(r.path, r.line) for r in g.errors.collect()} == {("inc/broken.php", 1)}
    assert (g.plugin.first().name, g.plugin.first().version, g.plugin.first().main_file) == ("Shop Kit", "2.1", "kit.php")
    from graphloom.operators import export

    whole = json.loads(export.document(g.plugin, g.nodes, g.edges, g.cycles).first().document)
    assert len(whole["nodes"]) == len(nodes) and len(whole["edges"]) == len(edges) and whole["nodes"][0]["data"]["type"] in ("dir", "namespace")
    assert [e["data"]["id"] for e in whole["edges"]] == [f"e_{i}" for i in range(len(edges))]


def test_tree_with_hidden_names_and_ignore_lines(spark, tmp_path):
    for path, text in (("_app.js", "let a = 1"), ("a/b.php", "<?php"), (".hid/c.php", "<?php"), ("a/readme.md", "x"), (".gitignore", "# no\n\n!x\nlogs/\n"), ("style.css", "/*\nTheme Name: Sea\nVersion: 3\n*/")):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert {(r.path, r.content) for r in tree.read_tree(spark, str(tmp_path)).collect()} == {("_app.js", "let a = 1"), ("a/b.php", "<?php"), (".hid/c.php", "<?php")}
    assert tree.ignore_lines(spark, str(tmp_path)) == ["logs/"] and tree.theme_header(spark, str(tmp_path)) == {"name": "Sea", "version": "3"}
    assert tree.read_tree(spark, str(tmp_path / "none")).count() == 0
    empty = analyze.analyze(spark.createDataFrame([], "path string, content string"))
    assert empty.nodes.count() == 0 == empty.edges.count()
