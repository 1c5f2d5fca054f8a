"""Entities of JavaScript and TypeScript files as rows, read from the same token rows as PHP ones.

Calls are told by the dotted name in front of their bracket, options by the keys of an object literal, and a
component by a return of markup. Only literal strings, and templates without a placeholder, count as names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import catalog
from graphloom.functions.text import base_name, sanitize_id
from graphloom.operators.lineage import cut, drop, numbered
from graphloom.sources.code import arg, edge_rows, errors, node_rows, packed, plus, tokens

NAME = r"^[A-Za-z_$][\w$]*$"
#: Tokens before `function` or `class` that make it an expression.
VALUES = ("=", "(", ",", ":", "return", "=>", "?", "&&", "||", "!", "[", "new", "typeof", "await", "...")


def text(token: Column) -> Column:
    """Value of a literal string or of a template without a placeholder."""
    template = token.startswith("`") & ~token.contains("${")
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    return F.when(token.rlike("^['\"]"), F.regexp_replace(inner, r"\\(['\"\\/])", "$1")).when(template, inner)


def literal(n: int) -> Column:
    return F.when(F.size(arg(n)) == 1, text(F.get(arg(n), 0)["tok"]))


class JsFiles:
    """JavaScript files (path, content) below `root`, as tokens and calls. Seq numbers follow the files by path."""

    def __init__(self, files: DataFrame, root: str = "/plugin", first: int = 0):
        order = numbered(files.select("path"), ["path"], "file_seq", 1 + first).withColumn("file_seq", F.col("file_seq").cast("int"))
        file = F.concat(F.lit(root.rstrip("/") + "/"), "path")
        self.files = cut(files.select("path", "content").join(order, "path").withColumn("file", file))
        self.names = self.files.select("file_seq", "path", "file", *self.ids())
        self.toks = cut(tokens(self.files, "js"))
        self.errors = cut(errors(self.toks))
        self.args = self.toks.where("tok IN ('(', '[', '{') AND args IS NOT NULL").select("file_seq", F.col("i").alias("opener"), "args")
        self.calls = cut(self._calls())
        self.tables = [self.files, self.toks, self.calls]

    def drop(self) -> None:
        """Delete the tables that entities were read from."""
        drop(*self.tables)

    @staticmethod
    def ids() -> list[Column]:
        return [F.md5("file").alias("hash"), sanitize_id(F.concat(F.lit("file_"), "file")).alias("file_id")]

    def _calls(self) -> DataFrame:
        word = lambda c: F.coalesce(c.rlike(NAME) & ~c.isin("this", "super", "return", "await", "typeof", "new", "yield"), F.lit(False))
        dot, further = F.col("p1") == ".", (F.col("p1") == ".") & word(F.col("p2")) & (F.col("p3") == ".") & word(F.col("p4"))
        name = F.when(further, F.concat_ws(".", "p4", "p2", "tok")).when(dot & word(F.col("p2")), F.concat_ws(".", "p2", "tok")).otherwise(F.col("tok"))
        fresh = (F.col("p1") == "new") | (dot & (F.col("p3") == "new"))
        rows = self.toks.where((F.col("n1") == "(") & F.col("tok").rlike(NAME) & ~F.coalesce(F.col("p1").isin("function", "?.") | fresh, F.lit(False)))
        rows = rows.where("after IS NULL OR after != '{'").select("file_seq", "i", "line", "path", "file", *self.ids(), name.alias("name"), "args")
        return rows

    def options(self, rows: DataFrame, at: Column, name: str) -> DataFrame:
        """`rows` with the map `name` of what stands under each place of the object literal whose token is `at`."""
        found = self.args.select("file_seq", F.col("opener").alias("open__"), F.col("args").alias(name))
        return rows.withColumn("open__", at).join(found, ["file_seq", "open__"], "left").drop("open__")


def under(options: str, key: str) -> Column:
    """The tokens of the value of `key` in an object literal."""
    entries = F.transform(F.map_entries(options), lambda e: e["value"])
    own = lambda x: F.coalesce(text(F.get(x, 0)["tok"]), F.get(x, 0)["tok"])
    hit = F.filter(entries, lambda x: (own(x) == key) & (F.get(x, 1)["tok"] == ":"))
    return F.slice(F.get(hit, 0), 3, 100)


def under_text(options: str, key: str) -> Column:
    return F.when(F.size(under(options, key)) == 1, text(F.get(under(options, key), 0)["tok"]))


def brace(tokens_: Column) -> Column:
    return F.when(F.get(tokens_, 0)["tok"] == "{", F.get(tokens_, 0)["i"])


def called(js: JsFiles) -> DataFrame:
    """type, subtype, name, extra fields of every entity that a call makes: blocks, hooks, requests, stores, React hooks."""
    calls = js.calls
    hooks = calls.sparkSession.createDataFrame([(f"{p}{n}", s) for p in ("", "wp.hooks.") for n, s in catalog.JS_HOOKS], "name string, subtype string")
    imported = imports(js).where("source = '@wordpress/data'").select("file_seq", F.explode("names").alias("name"), F.lit(True).alias("imported"))
    blocks = calls.where("name = 'registerBlockType'").select("*", F.lit("gutenberg_block").alias("type"), F.lit(None).cast("string").alias("subtype"), literal(0).alias("title")).where("title != ''")
    own = [("http_method", "string"), ("route", "string"), ("store", "string"), ("wp_action", "string")]
    void = {c: F.lit(None).cast(t) for c, t in own}
    keep = ["file_seq", "i", "line", "path", "file", "hash", "file_id", "type", "subtype", "title", *void]
    out = blocks.withColumns(void).select(keep)
    found = calls.join(F.broadcast(hooks), "name").withColumns({"type": F.lit("js_hook"), "title": literal(0)} | void).where("title != ''")
    out = out.union(found.select(keep))

    asked = js.options(js.options(calls.where(F.col("name").rlike(catalog.JS_REQUESTS)), brace(arg(0)), "first"), brace(arg(1)), "second")
    asked = js.options(asked, brace(F.when(F.col("name").endswith(".post"), F.lit(None)).otherwise(under("first", "data"))), "data")
    name, first, second = F.col("name"), lambda k: under_text("first", k), lambda k: under_text("second", k)
    verb = F.upper(F.regexp_extract(name, r"(?i)^axios\.(\w+)$", 1))
    api = name.isin("apiFetch", "wp.apiFetch")
    ajax = name.rlike(r"^(\$|jQuery)\.ajax$")
    method = F.upper(F.when(api | (name == "axios"), F.coalesce(first("method"), F.lit("GET"))).when(name == "fetch", F.coalesce(second("method"), F.lit("GET"))).when(verb != "", verb).when(ajax, F.coalesce(first("method"), first("type"), F.lit("GET"))).when(name.endswith(".post"), "POST").otherwise("GET"))
    route = F.when(api, first("path")).when((name == "axios") | ajax, first("url")).otherwise(literal(0))
    action = F.when(ajax, under_text("data", "action")).when(name.rlike(r"^(\$|jQuery)\.post$"), second("action"))
    kind = F.when(api, "js_api_call").when(F.lower(name).rlike(r"^axios(\.|$)"), "axios_call").otherwise("fetch_call")
    subtype = F.when(kind == "axios_call", F.lower(method)).when(name.rlike(r"^(\$|jQuery)\."), "jquery")
    asked = asked.withColumns({"http_method": method, "route": route, "wp_action": action, "type": kind, "subtype": subtype, "store": F.lit(None).cast("string")}).where("type != 'js_api_call' OR route != ''")
    out = out.union(asked.withColumn("title", F.concat_ws(" ", "http_method", F.coalesce("route", F.lit("(dynamic)")))).select(keep))

    bare = F.regexp_replace("name", r"^wp\.data\.", "")
    stores = calls.where(bare.isin("select", "dispatch", "useDispatch", "subscribe")).join(imported, ["file_seq", "name"], "left").where("imported OR startswith(name, 'wp.data.')")
    stores = stores.withColumns(void | {"type": F.lit("wp_store"), "subtype": F.when(bare == "select", "read").when(bare == "subscribe", "subscribe").otherwise("write"), "store": F.when(bare != "subscribe", literal(0)), "title": F.when(bare == "subscribe", "store subscription").otherwise(literal(0))})
    out = out.union(stores.where("title != ''").select(keep))

    context = F.array_join(F.filter(F.transform(arg(0), lambda x: x["tok"]), lambda x: x.rlike(r"^[\w$.]+$")), "")
    named = F.coalesce(literal(0), F.when(F.exists(arg(0), lambda x: x["tok"].rlike(NAME)), context), F.lit("unknown"))
    uses = calls.where(F.col("name").rlike("^use[A-Z]")).join(imported, ["file_seq", "name"], "left").where("NOT (name = 'useDispatch' AND coalesce(imported, false))")
    uses = uses.withColumns(void | {"type": F.lit("react_hook"), "subtype": F.when(F.col("name").isin("useState", "useEffect", "useContext"), F.col("name")).otherwise("custom"), "title": F.when(F.col("name") == "useContext", F.concat(F.lit("useContext("), named, F.lit(")"))).otherwise(F.col("name"))})
    return out.union(uses.select(keep))


def declared(js: JsFiles) -> DataFrame:
    """type, title, base, place of functions, classes and components: a component returns markup, at once or by a
    return statement of its own block, which may be conditional."""
    t = js.toks
    p1 = F.coalesce(F.col("p1"), F.lit(""))
    # What ends a returned value first: a condition, or the statement.
    then = F.get(F.filter("head", lambda x: x["own"] & x["tok"].isin("?", "return")), 0)["tok"]
    markup = (F.col("n1") == "<") | ((F.col("n1") == "(") & (F.col("n2") == "<")) | (then == "?")
    shown = t.where((F.col("tok") == "return") & markup).select("file_seq", F.col("opener").alias("body"), F.lit(True).alias("shown")).distinct()
    functions = t.where((F.col("tok") == "function") & (F.col("n1").rlike(NAME) | ((F.col("n1") == "*") & F.col("n2").rlike(NAME))) & ~p1.isin(*VALUES) & ~((p1 == "async") & F.coalesce(F.col("p2"), F.lit("")).isin(*VALUES)))
    functions = functions.select("file_seq", "i", "line", F.when(F.col("n1") == "*", F.col("n2")).otherwise(F.col("n1")).alias("title"), F.col("stop.i").alias("body"))
    functions = functions.join(shown, ["file_seq", "body"], "left").select("file_seq", "i", "line", F.when(F.col("shown"), "react_component").otherwise("js_function").alias("type"), "title", F.lit(None).cast("string").alias("base"))
    parent = F.filter(F.slice(F.transform("head", lambda x: x["tok"]), 3, F.greatest(F.size("head"), F.lit(1))), lambda x: x.rlike(r"^[\w$.]+$"))
    told = F.array_position(F.transform(parent, lambda x: x.isin("implements")), True)
    chain = F.array_join(F.when(told > 0, F.slice(parent, 1, told.cast("int") - 1)).otherwise(parent), "")
    classes = t.where((F.col("tok") == "class") & F.col("n1").rlike(NAME) & ~p1.isin(*VALUES, ".")).select("file_seq", "i", "line", F.lit("js_class").alias("type"), F.col("n1").alias("title"), F.when(F.col("n2") == "extends", chain).alias("base"))

    at_once = (F.col("n1") == "<") | ((F.col("n1") == "(") & (F.col("n2") == "<"))
    arrows = t.where("tok = '=>'").select("file_seq", F.col("i").alias("arrow"), at_once.alias("at_once"), F.when(F.col("n1") == "{", F.col("at1")).alias("body"))
    heads = t.where("tok = '('").select("file_seq", "p1", "p2", "p3", "p4", "line", "i", F.when(F.col("after") == "=>", F.col("close") + 1).alias("arrow"), F.when(F.col("after") == "{", F.col("close") + 1).alias("block"))
    skip = F.col("p1") == "async"
    eq, name, kind = (F.when(skip, F.col(a)).otherwise(F.col(b)) for a, b in (("p2", "p1"), ("p3", "p2"), ("p4", "p3")))
    listed = heads.where("arrow IS NOT NULL").join(arrows, ["file_seq", "arrow"]).select("file_seq", "i", "line", eq.alias("eq"), name.alias("title"), kind.alias("kind"), "at_once", "body")
    one = t.where("n1 = '=>' AND tok != ')'").select("file_seq", "i", "line", eq.alias("eq"), name.alias("title"), kind.alias("kind"), F.col("at1").alias("arrow")).join(arrows, ["file_seq", "arrow"]).drop("arrow").select("file_seq", "i", "line", "eq", "title", "kind", "at_once", "body")
    plain = heads.where("block IS NOT NULL AND p1 = 'function' AND p2 = '='").select("file_seq", "i", "line", F.col("p2").alias("eq"), F.col("p3").alias("title"), F.col("p4").alias("kind"), F.lit(False).alias("at_once"), F.col("block").alias("body"))
    values = listed.union(one).union(plain).join(shown, ["file_seq", "body"], "left").where("at_once OR shown")
    const = values.where((F.col("eq") == "=") & F.col("kind").isin("const", "let", "var") & F.col("title").rlike(NAME))
    default = values.where((F.col("eq") == "default") & (F.col("title") == "export")).withColumn("title", F.lit("(default export)"))
    components = const.union(default).select("file_seq", "i", "line", F.lit("react_component").alias("type"), "title", F.lit(None).cast("string").alias("base"))
    return functions.union(classes).union(components).join(js.names, "file_seq")


def imports(js: JsFiles) -> DataFrame:
    """file_seq, i, path, source, names (bound by braces) of every import statement."""
    literals = F.filter("head", lambda x: x["tok"].rlike("^['\"]"))
    rows = js.toks.withColumn("from_", text(F.get(literals, 0)["tok"]))
    rows = rows.where((F.col("tok") == "import") & ~F.col("n1").isin("(", ".") & ~F.coalesce(F.col("p1"), F.lit("")).isin(".", "?.")).where("from_ != ''")
    # A name is bound where a comma or the closing brace is behind it.
    words = F.transform("head", lambda x: x["tok"])
    bound = F.filter(F.transform(F.filter("head", lambda x: ~x["own"]), lambda x: F.struct(x["tok"].alias("tok"), F.get(words, x["i"] - F.get("head", 0)["i"] + 1).alias("next"))), lambda x: x["next"].isin(",", "}") & x["tok"].rlike(NAME))
    names = F.transform(bound, lambda x: x["tok"])
    return rows.select("file_seq", "i", "line", "path", "file", js.ids()[1], F.col("from_").alias("source"), names.alias("names"))


def entities(files: DataFrame, every: DataFrame, root: str = "/plugin", first: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, with seq, of JavaScript files (path, content) mounted at `root`. `every`: the paths that relative
    imports may name. Imports of packages, and of styles and pictures, make no edge."""
    return entities_and_errors(files, every, root, first)[:2]


def entities_and_errors(files: DataFrame, every: DataFrame, root: str = "/plugin", first: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities(), and path, line, error of the files that can't be read, of which there is only the node of the file."""
    from graphloom.sources.tree import resolve_imports

    js = JsFiles(files, root, first)
    start = js.names.withColumns({"i": F.lit(0), "line": F.lit(0)})
    nodes = node_rows(start, 0, id=F.concat(F.lit("file_"), "file"), label=base_name(F.col("path")), type=F.lit("file"), line=F.lit(0))
    made = cut(declared(js))
    prefix = F.when(F.col("type") == "react_component", "react_comp_").when(F.col("type") == "js_class", "js_class_").otherwise("js_func_")
    own = F.concat(prefix, "hash", F.lit("_"), "title")
    nodes = plus(nodes, node_rows(made, 1, id=own, label=F.col("title"), type=F.col("type"), extends=F.col("base")))
    part = F.when(F.col("type") == "react_component", "defines_component").otherwise("defines")
    edges = edge_rows(made, 1, F.col("file_id"), own, part, "defines")

    calls = cut(called(js))
    kind = F.col("type")
    title, method = F.col("title"), F.col("http_method")
    hook_kind = F.when(F.col("subtype").contains("action"), "action").otherwise("filter")
    way = F.when(F.col("subtype").endswith("_trigger"), "trigger").when(F.col("subtype").endswith("_remove"), "remove").otherwise("register")
    place = F.coalesce(F.nullif(F.col("route"), F.lit("")), F.md5(F.concat("file", F.col("line").cast("string"))))
    own = (
        F.when(kind == "gutenberg_block", F.concat(F.lit("block_"), title)).when(kind == "js_hook", F.concat(F.lit("js_hook_"), hook_kind, F.lit("_"), title)).when(kind == "wp_store", F.concat(F.lit("wp_store_"), F.coalesce("store", title)))
        .when(kind == "js_api_call", F.concat(F.lit("js_api_"), method, F.lit("_"), "route")).when(kind == "react_hook", F.concat_ws("_", F.lit("react_hook"), "subtype", title, "hash")).otherwise(F.concat_ws("_", F.regexp_replace(kind, "_call", ""), method, place))
    )
    edge = F.when(kind == "gutenberg_block", "registers_block").when(kind == "js_hook", F.when(way == "trigger", "triggers_hook").when(way == "remove", "deregisters_hook").otherwise("js_registers_hook"))
    edge = edge.when(kind == "wp_store", F.when(F.col("subtype") == "write", "writes_store").otherwise("reads_store")).when(kind == "js_api_call", "js_api_call").when(kind == "react_hook", "uses_hook").otherwise("http_call")
    label = F.when(kind == "gutenberg_block", "registers").when(kind == "js_hook", way).when(kind == "wp_store", F.col("subtype")).when(kind == "react_hook", "uses").otherwise("calls")
    told = F.map_filter(F.create_map(F.lit("hook_kind"), F.when(kind == "react_hook", F.col("subtype")), F.lit("store"), F.col("store"), F.lit("wp_action"), F.col("wp_action")), lambda _, v: v.isNotNull())
    shown = F.when(kind == "js_hook", hook_kind).when(kind == "wp_store", F.col("subtype"))
    nodes = plus(nodes, node_rows(calls, 1, 8, id=own, label=title, type=kind, subtype=shown, http_method=method, route=F.col("route"), hook_name=F.when(kind == "js_hook", title), block_name=F.when(kind == "gutenberg_block", title), extra=F.when(F.size(told) > 0, told)))
    edges = edges.union(edge_rows(calls, 1, F.col("file_id"), own, edge, label, 9))

    named = cut(imports(js).where(F.col("source").startswith(".") & ~F.col("source").rlike(r"\.(css|scss|less|sass|svg|png|jpg|gif|woff|woff2|ttf|eot|ico|mp4|webm)$")))
    found = resolve_imports(named.select("path", F.col("source").alias("name")).distinct(), every)
    hit = named.join(found.select(F.col("source").alias("path"), F.col("name").alias("source"), F.col("target").alias("to_path")), ["path", "source"])
    edges = edges.union(edge_rows(hit, 1, F.col("file_id"), F.concat(F.lit("file_" + root.rstrip("/") + "/"), "to_path"), "imports", "imports", 9))
    out = cut(packed(nodes)), cut(edges), js.errors
    js.drop()
    drop(made, calls, named)
    return out
