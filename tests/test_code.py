"""Heads of any length, files with syntax errors, forms of scripts, ignore lines, listing, replies, payloads, the document."""

import json
import os
import random
import re

import pytest
from graphloom import plans
from graphloom.operators import algorithms, describe, export
from graphloom.plans import graphs
from graphloom.sources import js, lexers, php, tree
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def class_source(rng, n):
    """A PHP class of random size, and what its head and members say."""
    faces = [f"Face{n}x{i}" for i in range(rng.choice([0, 1, 3, 50]))]
    traits = [f"Trait{n}x{i}" for i in range(rng.choice([0, 1, 30]))]
    parts = [f"Part{i}" for i in range(rng.choice([1, 2, 20]))]
    depth = rng.randrange(5)
    folder = "__FILE__"
    for _ in range(depth):
        folder = f"dirname({folder})"
    gap = lambda: rng.choice([" ", "\n", " /* , { ; */ ", " // extends X\n"])
    code = f"<?php{gap()} abstract class C{n}{gap()}extends{gap()}Base{n}"
    code += gap() + "implements " + f",{gap()}".join(faces) if faces else ""
    code += " {" + (f" use{gap()}" + f",{gap()}".join(traits) + rng.choice([";", " { x as y; }"]) if traits else "")
    code += f" public function m({'|'.join(parts)} $a = [1, ';'], ...$b):{gap()}{'|'.join(parts)} {{ return 1; }} }}\n"
    code += f"include {folder} . '/inc/x.php'; require_once(__DIR__ . '/y{n}.php'); if ((include 'z{n}.php') === false) {{ }}"
    return code, faces, traits, "|".join(parts), depth


def test_heads_of_any_length(spark):
    rng = random.Random(4)
    made = [class_source(rng, n) for n in range(40)]
    files = spark.createDataFrame([(f"d/f{n:02}.php", m[0]) for n, m in enumerate(made)], "path string, content string")
    nodes, edges, errors = php.entities_and_errors(files)
    assert errors.count() == 0
    by_id, links = {r.id: r for r in nodes.collect()}, {}
    for r in edges.orderBy("seq").collect():
        links.setdefault((r.source, r.type), []).append(r.target)
    for n, (_, faces, traits, kind, depth) in enumerate(made):
        own = f"class_C{n}"
        assert by_id[own].metadata.extends == f"Base{n}" and by_id[own].metadata.implements == faces
        assert links.get((own, "implements"), []) == [f"class_{x}" for x in faces] and links[own, "extends"] == [f"class_Base{n}"]
        assert sorted(links.get((own, "uses_trait"), [])) == sorted(f"class_{x}" for x in traits)
        method = by_id[f"method_C{n}_m"]
        assert method.metadata.return_type == kind and [(p.name, p.type) for p in method.metadata.params] == [("$a", kind), ("$b", None)]
        # dirname() once is the folder; deeper ones, and a bare __FILE__, are guessed by the .php behind them.
        assert links[f"file_d_f{n:02}_php", "includes"] == ["file_d_inc_x_php", f"file_d_y{n}_php", f"file_d_z{n}_php"], depth


@pytest.mark.parametrize("code", ["<?php function ( { ' open", "<?php $a = ;;; } ", "<?php class { }", "<?php $x $y;", "<?php f('a' 'b');", "<?php /* open", "<?php function f() { $a = 1 }", "<?php echo 1", "<?php a(1]; ", "<?php trait 5 {}"])
def test_broken_php_is_told(code):
    with pytest.raises(lexers.SourceError):
        toks = lexers.php_tokens(code)
        lexers.check_php(toks, *lexers.brackets(toks))


GOOD = r"""<?php declare(strict_types=1);
namespace A { use B\{C, D as E}; use function F\g; }
namespace { #[Attr(1, 'x')] final class K { const A = 1; public ?int $p = null; public function __get($n) { return $this->{$n}; } use T { T::a insteadof U; a as protected b; }
  public static function make(): static { return new static; } public function list() { return $this->class; } }
enum Suit: string { case A = 'a'; case B = 'b'; public function f(): string { return match($this) { self::A => 'x', self::B => "y$z" }; } }
$f = fn(int $a): int => $a ** 2; $g = function() use (&$f) { yield 1 => 2; }; $o = new class(1) extends K { };
if ($a): foreach ($b as $k => [$x, $y]): endforeach; elseif ($c): else: endif; switch ($z) { case 1: default: break; }
echo <<<"T"
  a {$b['c']} "q" 'z
  T . "tail"; $s = `ls`; $v = ${'x'}; $n = 1_000 + 0x1F + 1.5e3; goto end; end: $a instanceof K and $b or $c; static $q = 1, $r; (int) $n; @$m['a'] ?? null; $x?->y?->z(); K::class; $h = <<<'E'
E;
abstract class Z { abstract protected function q(): void; } interface I extends J, L { function m(); } try { throw new E('x'); } catch (A|B $e) { } finally { } }
?> html ' " { <?= $x ?> more <?php while (1) : endwhile ?>"""


def test_good_php_is_not_told(spark):
    toks = lexers.php_tokens(GOOD)
    lexers.check_php(toks, *lexers.brackets(toks))
    files = spark.createDataFrame([("a.php", GOOD), ("bad.php", "<?php class { function f() {} }"), ("null.php", None), ("text.php", "no code")], "path string, content string")
    nodes, _, errors = php.entities_and_errors(files)
    assert {r.label for r in nodes.where("type IN ('class', 'interface')").collect()} == {"K", "Z", "I"}
    assert [(r.path, r.line, r.error) for r in errors.collect()] == [("bad.php", 1, "a class has no name")]


SCRIPT = r"""
const Card: React.FC<Props<string>> = ({ a, b }: Props): JSX.Element => <div title="it's {not} code">Don't <b>{call1(a, `x${call2(`y${call3()}z`)}`)}</b> {/* don't */}</div>;
const Plain: (n: number) => void = (n) => { run(n); };
export function Generic<T>(x: T): T { return useStuff<T>(x); }
const pick = <T,>(a: T) => a < 3 && a > (2) ? /['"`<]/.test(a) : null;
let typed: Array<{ k: string }> = apiFetch<Item[]>({ path: '/v1/items', method: 'PUT' });
const El = memo(() => { return <><Inner {...props} on={() => fetch('/in/markup')} /> it's</>; });
class Big<T> extends React.Component<P, S> implements Q { render() { return a < b ? <i/> : null; } }
function Late() { const x = 1 / 2 / 3; if (x) { return cond ? <a href='x'>{list.map((i) => <li key={i}>{useItem(i)}</li>)}</a> : null; } return null }
fetch(`/plain`); fetch(`/with/${id}`);
"""


def test_forms_of_scripts(spark):
    files = spark.createDataFrame([("a.tsx", SCRIPT), ("bad.js", "const a = `open ${x"), ("worse.js", "f((1)"), ("empty.js", "")], "path string, content string")
    nodes, _, errors = js.entities_and_errors(files, files.select("path"))
    of = lambda t: sorted(r.label for r in nodes.where(F.col("type") == t).collect())
    assert of("react_component") == ["Card"] and of("js_function") == ["Generic", "Late"] and of("js_class") == ["Big"]
    assert of("react_hook") == ["useItem", "useStuff"] and of("js_api_call") == ["PUT /v1/items"]
    assert of("fetch_call") == ["GET (dynamic)", "GET /in/markup", "GET /plain"]
    assert sorted(r.path for r in errors.collect()) == ["bad.js", "worse.js"] and len(of("file")) == 4
    toks = [t for t, _, _ in lexers.js_tokens(SCRIPT)]
    calls = [t for t, u in zip(toks, toks[1:], strict=False) if u == "(" and re.match(r"\w+$", t)]
    assert {"call1", "call2", "call3", "useStuff", "apiFetch"} <= set(calls)


@pytest.mark.parametrize(
    ("glob", "path", "loose", "strict"),
    [("log", "catalog.php", True, False), ("log", "a/log", True, True), ("/foo", "bar/foo", True, False), ("/foo", "foo", True, True), ("docs/", "docs.php", True, False), ("docs/", "a/docs/b.php", True, True), ("a/b/", "a/b/c.php", False, True), ("*.gen.js", "x/y.gen.js", True, True), ("f?o", "a/fxo", True, True), ("f?o", "a/f/o", False, False), ("a[0-9].php", "a1.php", False, True), ("a.c", "abc", False, False), ("**/deep", "x/y/deep", True, True), ("é*x", "aéyx", True, False)],
)
def test_ignore_lines(spark, glob, path, loose, strict):
    found = spark.createDataFrame([(path,)], "path string").select(tree.ignored(F.col("path"), [glob]), tree.ignored(F.col("path"), [glob], True)).first()
    assert tuple(found) == (loose, strict)


def test_listing_in_tasks(spark, tmp_path):
    base, outside = tmp_path / "base", tmp_path / "outside"
    for name in ("_a.php", "x.txt", ".h/b.js", "d1/d2/d3/c.ts", "d1/e.JSX", "_d/block.json", *[f"many/f{i}.php" for i in range(300)]):
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_text(f"<?php // é {name}")
    outside.mkdir()
    (outside / "o.php").write_text("<?php")
    os.symlink(outside, base / "link")
    os.symlink(base / "d1", base / "d1" / "loop")
    os.symlink(base / "_a.php", base / "same.php")
    got = {r.path: r.content for r in tree.read_tree(spark, str(base)).collect()}
    assert set(got) == {"_a.php", ".h/b.js", "d1/d2/d3/c.ts", "d1/e.JSX", "_d/block.json", "../outside/o.php", *[f"many/f{i}.php" for i in range(300)]}
    assert got["d1/e.JSX"] == "<?php // é d1/e.JSX"
    reader = tree.TreeReader(str(base), 4)
    assert 1 < len(reader.partitions()) <= 4 and tree.TreeReader(str(tmp_path / "none"), 4).partitions()[0].deep == []


def test_document_lines_are_the_document(spark, tmp_path):
    n = 60
    nodes = spark.createDataFrame([(f"n{i}", i if i else -1, f"L\"{i}€", None if i % 2 else "ns") for i in range(n)], "id string, seq long, label string, parent string")
    edges = spark.createDataFrame([(f"e_{i}", i, f"n{i}", f"n{i + 1}") for i in range(n - 1)], "id string, seq long, source string, target string")
    plugin, cycles = spark.createDataFrame([("Kit", None)], "name string, version string"), spark.createDataFrame([("n0", i, ["n0", "n1", "n0"]) for i in range(3)], "component string, nth int, path array<string>")
    for some in (n, 0):
        parts = plugin, nodes.limit(some), edges.limit(some), cycles.limit(some)
        export.write_document(export.document_lines(*parts), f"{tmp_path}/d{some}")
        text = "".join(open(f"{tmp_path}/d{some}/{f}").read() for f in sorted(os.listdir(f"{tmp_path}/d{some}")) if f.startswith("part-"))
        assert json.loads(text) == json.loads(export.document(*parts).first().document)
        assert len(json.loads(text)["nodes"]) == some


def test_forms_of_replies(spark):
    cases = {
        "flat": ('```json\n{"a": "x", "n": 1, "o": {"k": "v"}, "z": null}\n```', {"a": "x"}, {"a": "x"}, {"a": "x"}),
        "lists": ('{"entity_ids": ["a", 5, "c", "d"], "descriptions": ["x", "y", null]}', {"a": "x"}, {"a": "x"}, {}),
        "nested": ('well {"a": {"description": "x"}, "b": {"description": 3}, "c": ["y"]}', {"a": "x"}, {}, {"a": "x"}),
        "wrapped": ('{"n": 1, "descriptions": {"a": "x", "b": 2}}', {"a": "x"}, {}, {"a": "x"}),
        "nothing": ('{"a": 1}', {}, {}, {}),
        "broken": ('{"a": "x"', None, None, None),
        "none": ("no", None, None, None),
    }
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "k string, reply string")
    got = {r.k: (r.every, r.ollama, r.claude) for r in rows.select("k", *[describe.parse_reply(F.col("reply"), p).alias(p or "every") for p in (None, "ollama", "claude")]).collect()}
    assert got == {k: v[1:] for k, v in cases.items()}


def test_payloads(spark):
    fields = "namespace string, extends string, implements array<string>, hook_name string, http_method string, route string, operation string, key string, block_name string"
    nodes = spark.createDataFrame(
        [(1, "a", "class", "A", (None, "P", ["I"], None, "", None, None, "0", None), "\n".join(f"l{i}" for i in range(14)), False), (2, "b", "function", "B", (None, None, [], None, None, None, None, None, None), None, None), (3, "lib", "function", "L", None, None, True)],
        f"seq long, id string, type string, label string, metadata struct<{fields}>, source_preview string, is_library boolean",
    )
    links = spark.createDataFrame([("a", i, f"t{i} (calls)") for i in range(12)], "id string, nth int, text string")
    got = [json.loads(r.payload) for r in describe.payloads(nodes, links, ["seq"], 25).collect()]
    assert got == [[{"id": "a", "type": "class", "label": "A", "extends": "P", "implements": ["I"], "connections": [f"t{i} (calls)" for i in range(10)], "code_snippet": "\n".join(f"l{i}" for i in range(10))}, {"id": "b", "type": "function", "label": "B"}]]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_registered_cycles_are_those_of_a_plain_search(spark):
    edges = graphs.transitions(spark, DATA)
    links = [(r.source, r.target) for r in edges.orderBy("seq").collect()]
    want = [">".join(c) for c in algorithms.search_cycles(links)]
    assert [r.path for r in plans.QUERIES["ga1_dfs_cycles"](spark, DATA).orderBy("nth").collect()] == want and want
    steps = sorted((a, b) for c in want for a, b in zip(c.split(">"), c.split(">")[1:], strict=False))
    assert sorted((r.source, r.target) for r in plans.QUERIES["jn16_cycle_edges"](spark, DATA).collect()) == steps


def test_only_words_that_an_entity_is_read_from_are_rows():
    from graphloom.sources.code import file_rows

    names = ", ".join(f"I{i}" for i in range(40))
    php = {"file_seq": 1, "path": "a.php", "file": "/a.php", "content": f"<?php class C extends B implements {names} {{ use {names}; function m($a): X|Y {{ return g([1], new D); }} }}"}
    rows = [r for r in file_rows(php, "php") if "error" not in r]
    assert [r["tok"] for r in rows if r["tok"] != "["] == ["class", "use", "function", "m", "g", "new"]
    assert len(rows[0]["head"]) == 3 + 1 + 2 * 40 - 1 and len(rows) == 7
    js = php | {"content": "import { a, b } from './x'; const f = (p, q) => p.q + r; s(t);"}
    assert [r["tok"] for r in file_rows(js, "js")] == ["import", "{", "(", "=>", "s", "("]
