"""Entities of PHP files as rows: tokens, brackets, contexts and calls, all by expressions, windows and joins.

Declarations open and close contexts; calls with their arguments are rows like any others, and each kind of entity
is a filter on them or a join with the API catalogue. Only literal strings count as names. A file with a syntax error
gives no entity and a row of `errors`, and fails nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import catalog
from graphloom.functions.text import base_name, byte_view, sanitize_id
from graphloom.operators.lineage import cut, drop, numbered
from graphloom.sources.code import arg, bound, edge_rows, errors, lexical, literal, node_rows, packed, plus, safe, seq, tokens, unquoted

NAME = r"^\\?[A-Za-z_\x80-\uffff][\w\\\x80-\uffff]*$"
MODIFIERS = ("public", "private", "protected", "static", "abstract", "final", "readonly", "var")
#: Words that may stand before a bracket without being called.
NO_CALLS = "if elseif while for foreach switch match catch function fn array list isset empty unset echo print return exit die and or xor not use declare static self parent include include_once require require_once new clone yield throw case do else as instanceof insteadof class namespace const global".split()
INTRA = ("self", "static", "parent")


class PhpFiles:
    """PHP files (path, content) below `root`, as tokens, declarations and calls; what the entities are read from.

    Seq numbers follow the files by path, the place in a file, and the kinds of entities at one place."""

    def __init__(self, files: DataFrame, root: str = "/plugin", first: int = 0):
        order = numbered(files.select("path"), ["path"], "file_seq", 1 + first).withColumn("file_seq", F.col("file_seq").cast("int"))
        files = files.select("path", "content").join(order, "path").withColumn("file", F.concat(F.lit(root.rstrip("/") + "/"), "path"))
        every = cut(tokens(files, "php"))
        self.errors = cut(errors(every))
        self.args = every.where("tok IN ('(', '[') AND args IS NOT NULL").select("file_seq", F.col("i").alias("opener"), "args")
        self.toks = every.where(F.col("tok").rlike(NAME)).withColumn("file_id", sanitize_id(F.concat(F.lit("file_"), "path")))
        word, left = F.lower("tok"), F.coalesce(F.col("p1"), F.lit(""))
        called = self.toks.where((F.col("n1") == "(") & ~word.isin(*NO_CALLS) & ~left.isin("function", "fn") & ~((left == "&") & (F.col("p2") == "function")))
        kinds = F.when(left == "::", "static").when(left.isin("->", "?->"), "method").when(left == "new", "new").otherwise("function")
        own = ["file_seq", "i", "line", kinds.alias("kind"), F.regexp_replace("tok", r"^\\", "").alias("name"), "p2", "p3", "class_name", "func_name", "is_member", "args", "path", "file", "file_id"]
        self.calls = called.select(*own, self.caller().alias("caller"))
        self.tables = [every]

    def drop(self) -> None:
        """Delete the table that entities were read from."""
        drop(*self.tables)

    @staticmethod
    def caller() -> Column:
        """The method or function around, else the file."""
        method = F.concat(F.lit("method_"), "class_name", F.lit("_"), "func_name")
        return F.when(F.col("func_name") == "", F.col("file_id")).when(F.col("class_name") != "", method).otherwise(F.concat(F.lit("func_"), "func_name"))

    def functions(self, *names: str) -> DataFrame:
        return self.calls.where((F.col("kind") == "function") & F.col("name").isin(*names))


def file_nodes(df: DataFrame, visitor: int) -> DataFrame:
    """The file around each row, for edges that may start from it."""
    return node_rows(df, visitor, 2, id=F.col("file_id"), label=base_name(F.col("path")), type=F.lit("file"), line=F.lit(0))


def class_id(name: Column) -> Column:
    return F.concat(F.lit("class_"), F.when(F.col("ns") != "", F.concat("ns", F.lit("_"))).otherwise(""), name)


def declared(php: PhpFiles) -> tuple[DataFrame, DataFrame]:
    """Classes, interfaces, traits, functions and methods, with inheritance, traits used and membership."""
    decls = php.toks.where("kind IS NOT NULL").withColumn("doc_", doc_of())
    is_class = F.col("kind").isin("class", "interface", "trait")
    own = decls.where(is_class)
    ns = F.nullif(F.col("ns"), F.lit(""))
    extends, implements = names_after("extends"), names_after("implements")
    classes = node_rows(own, 0, id=class_id(F.col("name")), label=F.col("name"), type=F.col("kind"), namespace=ns, extends=F.when(F.col("kind") == "class", F.regexp_replace(F.get(extends, 0), r"^\\", "")), implements=F.when(F.col("kind") == "class", F.transform(implements, lambda x: F.regexp_replace(x, r"^\\", ""))), docblock=F.col("doc_"), source_preview=F.col("preview"))
    last = lambda c: F.substring_index(c, "\\", -1)
    own_id = class_id(F.col("name"))
    parents = own.where("kind != 'trait'").withColumns({"own_id": own_id}).select("*", F.posexplode(extends).alias("nth", "parent"))
    parent_id = F.when(F.col("kind") == "class", class_id(last(F.col("parent")))).otherwise(F.concat(F.lit("class_"), F.regexp_replace("parent", r"^\\", "")))
    edges = edge_rows(parents, 0, F.col("own_id"), parent_id, "extends", "extends", 1 + F.least("nth", F.lit(9)))
    faces = own.where("kind = 'class'").withColumn("own_id", own_id).select("*", F.posexplode(implements).alias("nth", "face"))
    edges = edges.union(edge_rows(faces, 0, F.col("own_id"), F.concat(F.lit("class_"), F.regexp_replace("face", r"^\\", "")), "implements", "implements", 10 + F.least("nth", F.lit(39))))
    uses = php.toks.where("lower(tok) = 'use'").drop("name").join(own.where("kind = 'class'").select("file_seq", F.col("stop.i").alias("opener"), F.col("i").alias("class_i"), F.col("name")), ["file_seq", "opener"])
    used = uses.select("file_seq", F.col("class_i").alias("i"), "ns", "name", F.explode(own_words()).alias("t")).where(F.col("t").rlike(NAME))
    edges = edges.union(edge_rows(used, 0, class_id(F.col("name")), class_id(last(F.col("t"))), "uses_trait", "uses trait", 50))

    functions = decls.where("kind = 'function'").withColumn("of_class", F.col("class_name"))
    given = dict(label=F.col("name"), params=parameters(), return_type=return_type(), docblock=F.col("doc_"), source_preview=F.col("preview"))
    plain = node_rows(functions.where("NOT member"), 1, id=F.concat(F.lit("func_"), "name"), type=F.lit("function"), **given)
    members = functions.where("member AND of_class != ''")
    method_id = F.concat(F.lit("method_"), "of_class", F.lit("_"), "name")
    methods = node_rows(members, 1, id=method_id, type=F.lit("method"), visibility=visibility(), **given)
    edges = edges.union(edge_rows(members, 1, class_id(F.col("of_class")), method_id, "has_method", "has"))
    return plus(classes, plain, methods), edges


def doc_of() -> Column:
    """The doc comment of a declaration, in front of its modifiers."""
    near, held = F.col("doc"), F.lit(True)
    for k in (1, 2, 3):
        held = held & F.col(f"p{k}").isin(*MODIFIERS)
        near = F.coalesce(near, F.when(held, F.col(f"doc{k}")))
    return near


def own_words() -> Column:
    """The tokens of a head or statement, without those in brackets."""
    return F.transform(F.filter("head", lambda x: x["own"]), lambda x: x["tok"])


def names_after(word: str) -> Column:
    """Names behind `word` in a class's head, up to the next word or the body."""
    head = F.slice(own_words(), 2, F.greatest(F.size("head"), F.lit(1)))
    behind = lambda h, at: F.when(at > 0, F.slice(h, at.cast("int") + 1, F.greatest(F.size(h), F.lit(1)))).otherwise(F.array().cast("array<string>"))
    rest = bound(head, lambda h: bound(F.array_position(F.transform(h, lambda x: F.lower(x)), word), lambda at: behind(h, at)))
    before = lambda r, end: F.when(end > 0, F.slice(r, 1, end.cast("int") - 1)).otherwise(r)
    listed = bound(rest, lambda r: bound(F.array_position(F.transform(r, lambda x: F.lower(x).isin("extends", "implements")), True), lambda end: before(r, end)))
    return F.filter(listed, lambda x: x.rlike(NAME))


def visibility() -> Column:
    near = F.array("p1", "p2", "p3")
    held = lambda w: (F.col("p1") == w) | (F.col("p1").isin(*MODIFIERS) & (F.col("p2") == w)) | (F.col("p1").isin(*MODIFIERS) & F.col("p2").isin(*MODIFIERS) & (F.col("p3") == w))
    return F.when(F.size(near) > 0, F.when(F.coalesce(held("private"), F.lit(False)), "private").when(F.coalesce(held("protected"), F.lit(False)), "protected").otherwise("public"))


def parameters() -> Column:
    """name and type of every parameter, in order."""
    listed = F.transform(F.array_sort(F.map_entries("args")), lambda e: e["value"])

    def one(items: Column) -> Column:
        words = F.transform(items, lambda x: x["tok"])
        at = F.array_position(F.transform(words, lambda x: x.startswith("$")), True)
        kind = F.array_join(F.filter(F.slice(words, 1, F.greatest(at.cast("int") - 1, F.lit(0))), lambda x: ~x.isin(*MODIFIERS, "&", ".")), "")
        return F.struct(F.get(words, at.cast("int") - 1).alias("name"), F.nullif(F.regexp_replace(kind, r"^(\??)\\", "$1"), F.lit("")).alias("type"))

    return F.filter(F.transform(F.coalesce(listed, F.array()), one), lambda p: p["name"].isNotNull())


def return_type() -> Column:
    """The type between a function's parameters and its body, of any length."""
    shut = F.get(F.filter("head", lambda x: x["own"] & (x["tok"] == ")")), 0)["i"]
    behind = bound(shut, lambda at: F.transform(F.filter("head", lambda x: x["i"] > at), lambda x: x["tok"]))
    words = lambda b: F.slice(b, 2, F.greatest(F.size(b) - 1, F.lit(0)))
    return bound(behind, lambda b: F.when(F.get(b, 0) == ":", F.nullif(F.regexp_replace(F.array_join(words(b), ""), r"^(\??)\\", "$1"), F.lit(""))))


def called(php: PhpFiles) -> tuple[DataFrame, DataFrame]:
    """calls edges of static and plain calls, and instantiates edges; with the files around."""
    statics = php.calls.where((F.col("kind") == "static") & F.col("p2").rlike(NAME) & ~F.lower("p2").isin(*INTRA)).withColumn("to", F.regexp_replace("p2", r"^\\", ""))
    plain = php.calls.where((F.col("kind") == "function") & ~F.col("name").isin(*catalog.COMMON_CALLS))
    name = F.regexp_replace("n1", r"^\\", "")
    fresh = php.toks.where((F.lower("tok") == "new") & F.col("n1").rlike(NAME) & ~F.lower("n1").isin(*INTRA, "class")).withColumns({"to": name, "caller": php.caller()})
    edges = edge_rows(statics, 1, F.col("caller"), F.concat(F.lit("class_"), "to"), "calls", "calls").union(edge_rows(plain, 1, F.col("caller"), F.concat(F.lit("func_"), "name"), "calls", "calls"))
    edges = edges.union(edge_rows(fresh, 1, F.col("caller"), F.concat(F.lit("class_"), "to"), "instantiates", "new"))
    keep = ["file_seq", "i", "line", "path", "file", "file_id"]
    return file_nodes(statics.select(keep).union(plain.select(keep)).union(fresh.select(keep)), 1), edges


def hooked(php: PhpFiles) -> tuple[DataFrame, DataFrame]:
    """Hooks that are registered, triggered and removed, by callback or caller; anonymous callbacks are functions."""
    calls = php.functions(*catalog.HOOK_REGISTER, *catalog.HOOK_TRIGGER, *catalog.HOOK_REMOVE).withColumn("hook", literal(0)).where("hook IS NOT NULL AND NOT startswith(hook, 'dynamic_')")
    subtype = F.when(F.col("name").contains("filter"), "filter").otherwise("action")
    way = F.when(F.col("name").isin(*catalog.HOOK_REGISTER), "register").when(F.col("name").isin(*catalog.HOOK_TRIGGER), "trigger").otherwise("remove")
    number = F.when(F.size(arg(2)) == 1, F.when(F.get(arg(2), 0)["tok"].rlike(r"^\d+$"), F.get(arg(2), 0)["tok"].cast("int")))
    calls = calls.withColumns({"subtype": subtype, "way": way, "priority": F.coalesce(number, F.lit(10))}).withColumn("hook_id", F.concat(F.lit("hook_"), "subtype", F.lit("_"), "hook"))
    nodes = node_rows(calls, 2, id=F.col("hook_id"), label=F.col("hook"), type=F.lit("hook"), subtype=F.col("subtype"), hook_name=F.col("hook"), priority=F.when(F.col("way") != "remove", F.col("priority")))

    callback = arg(1)
    first = F.get(callback, 0)
    listed = F.when(F.col("way") == "register", F.when((first["tok"] == "[") & (F.size(callback) == 2), first["i"]).when((F.lower(first["tok"]) == "array") & (F.get(callback, 1)["tok"] == "(") & (F.size(callback) == 3), F.get(callback, 1)["i"]))
    pairs = php.args.select("file_seq", F.col("opener").alias("listed"), F.col("args").alias("pair"))
    calls = calls.withColumn("listed", listed).join(pairs, ["file_seq", "listed"], "left")
    part = lambda n: F.when(F.size("pair") == 2, F.try_element_at("pair", F.lit(n)))
    owner, tail = F.get(part(0), 0)["tok"], F.concat_ws("", F.get(part(0), 1)["tok"], F.lower(F.get(part(0), 2)["tok"]))
    inner = F.nullif(F.col("class_name"), F.lit(""))
    whose = F.when((F.size(part(0)) == 1) & owner.isin("$this", "__CLASS__"), inner).when(F.size(part(0)) == 1, unquoted(owner)).when(tail == "::class", F.when(F.lower(owner).isin("self", "static"), inner).otherwise(F.regexp_replace(owner, r"^\\", "")))
    method = F.when(F.size(part(1)) == 1, unquoted(F.get(part(1), 0)["tok"]))
    closure = F.lower(first["tok"]).isin("function", "fn") | ((F.lower(first["tok"]) == "static") & F.lower(F.get(callback, 1)["tok"]).isin("function", "fn"))
    anonymous = F.concat(F.lit("func_anonymous_"), F.md5("file"), F.lit("_"), first["line"].cast("string"))
    to = F.coalesce(F.concat(F.lit("func_"), literal(1)), F.concat(F.lit("method_"), whose, F.lit("_"), method), F.when(closure, anonymous))
    calls = calls.withColumns({"callback": to, "anonymous": F.coalesce(closure, F.lit(False)), "first_line": first["line"], "called_back": F.col("args")[1].isNotNull()})
    calls = cut(calls.drop("args", "pair", "listed", "p2", "p3"))
    php.tables.append(calls)
    register, trigger, remove = (calls.where(F.col("way") == x) for x in ("register", "trigger", "remove"))
    register = register.where("called_back")
    functions = register.where("anonymous")
    nodes = plus(nodes, node_rows(functions, 2, 3, id=F.col("callback"), label=F.concat(F.lit("anonymous@"), base_name(F.col("file")), F.lit(":"), F.col("first_line").cast("string")), type=F.lit("function"), line=F.col("first_line")))
    nodes = plus(nodes, file_nodes(register.where("callback IS NULL").union(trigger).union(remove), 2))
    edges = edge_rows(register, 2, F.coalesce("callback", "caller"), F.col("hook_id"), "registers_hook", "registers", priority=F.col("priority"), hook_type=F.col("subtype"))
    edges = edges.union(edge_rows(trigger, 2, F.col("caller"), F.col("hook_id"), "triggers_hook", "triggers")).union(edge_rows(remove, 2, F.col("caller"), F.col("hook_id"), "deregisters_hook", "removes"))
    # A hook triggers its handler only where the handler was registered before.
    ajax = register.where("startswith(hook, 'wp_ajax_')").withColumn("handler", F.concat(F.lit("ajax_"), safe(F.regexp_replace("hook", "^wp_ajax_(nopriv_)?", "")))).withColumn("seq_", seq(2))
    earlier = ajax.groupBy("handler").agg(F.min(seq(4)).alias("known"))
    known = ajax.join(earlier, "handler").where("known < seq_")
    return nodes, edges.union(edge_rows(known, 2, F.col("hook_id"), F.col("handler"), "triggers_handler", "triggers", 4))


def stored(php: PhpFiles) -> tuple[DataFrame, DataFrame]:
    """Data sources that calls read or write: keyed functions by the catalogue, and database objects by name."""
    api = F.broadcast(php.calls.sparkSession.createDataFrame(list(catalog.DATA_CALLS), "name string, operation string, subtype string, position int"))
    keyed = php.calls.where("kind = 'function'").join(api, "name").withColumn("key", literal(F.col("position"))).where("key IS NOT NULL").withColumn("api", F.col("name"))
    var = F.lower(F.col("p2"))
    simple = php.calls.where((F.col("kind") == "method") & F.col("p2").startswith("$") & ~F.coalesce(F.col("p3"), F.lit("")).isin("->", "?->", "::"))
    methods = F.broadcast(php.calls.sparkSession.createDataFrame(list(catalog.DATABASE_CALLS), "of string, name string, operation string"))
    of = F.array_compact(F.array(F.when(F.col("p2") == "$wpdb", "wpdb"), F.when(var.contains("pdo"), "pdo"), F.when(var.contains("mysqli"), "mysqli")))
    sql = F.decode(F.encode(F.decode(F.substring(byte_view(literal(0)), 1, 80).cast("binary"), "UTF-8"), "ISO-8859-1"), "UTF-8")
    base = simple.withColumn("of", F.explode(of)).join(methods, ["of", "name"]).withColumns({"subtype": F.lit("database"), "key": F.coalesce(F.when(F.col("of") == "wpdb", sql), F.lit("database")), "api": F.concat(F.lit("$"), "of", F.lit("->"), "name")})
    keep = ["file_seq", "i", "line", "path", "file", "file_id", "func_name", "class_name", "is_member", "operation", "subtype", "key", "api"]
    rows = keyed.select(keep).union(base.select(keep))
    data_id = F.concat(F.lit("data_"), "operation", F.lit("_"), safe(F.col("key")))
    nodes = node_rows(rows, 3, id=data_id, label=F.col("key"), type=F.lit("data_source"), subtype=F.col("subtype"), operation=F.col("operation"), key=F.col("key"))
    own = F.when((F.col("func_name") == "") | (F.col("is_member") & (F.col("class_name") == "")), F.col("file_id")).otherwise(PhpFiles.caller())
    kind = F.when(F.col("operation") == "read", "reads_data").otherwise("writes_data")
    edges = edge_rows(rows, 3, own, data_id, kind, F.regexp_replace(kind, "_data", ""), api_function=F.col("api"))
    return plus(nodes, file_nodes(rows.where(own == F.col("file_id")), 3)), edges


def registered(php: PhpFiles) -> tuple[DataFrame, DataFrame]:
    """What a call registers or asks for under a literal name, by the catalogue: pages, jobs, types, blocks, assets,
    HTTP requests, AJAX handlers; and REST endpoints by their options."""
    api = F.broadcast(php.calls.sparkSession.createDataFrame(list(catalog.REGISTERING_CALLS), "name string, type string, prefix string, position int, title int, edge string, text string"))
    found = php.calls.where("kind = 'function'").join(api, "name").withColumn("slug", literal(F.col("position")))
    line = F.col("line").cast("string")
    hook = F.regexp_replace("slug", "^wp_ajax_(nopriv_)?", "")
    found = found.where((F.col("slug").isNotNull() | (F.col("type") == "http_call")) & ((F.col("type") != "ajax_handler") | F.col("slug").startswith("wp_ajax_")) & ((F.col("type") != "gutenberg_block") | ~F.col("slug").rlike(r"^[/.]")))
    verb = F.upper(F.regexp_extract("name", "_(post|get|head|delete|patch|put)", 1))
    method = F.when(verb == "", "REQUEST").otherwise(verb)
    where = F.coalesce("slug", F.lit("dynamic"))
    plain = F.col("type").isin("shortcode", "post_type", "taxonomy")
    own = F.concat("prefix", F.when(F.col("type") == "http_call", safe(F.concat(where, F.lit("_"), line))).when(F.col("type") == "ajax_handler", safe(hook)).when(plain, F.col("slug")).otherwise(safe(F.col("slug"))))
    label = F.when(F.col("type") == "http_call", F.concat(method, F.lit(" "), where)).when(F.col("type") == "ajax_handler", hook).when(F.col("type") == "shortcode", F.concat(F.lit("["), "slug", F.lit("]"))).when(F.col("type") == "admin_page", F.coalesce(literal(F.col("title")), F.col("slug"))).otherwise(F.col("slug"))
    http = lambda c: F.when(F.col("type") == "http_call", c)
    nodes = node_rows(found, 4, id=own, label=label, type=F.col("type"), http_method=http(method), route=http(F.col("slug")), hook_name=F.when(F.col("type") == "ajax_handler", F.col("slug")), block_name=F.when(F.col("type") == "gutenberg_block", F.col("slug")))
    edges = edge_rows(found, 4, F.col("caller"), own, F.col("edge"), F.col("text"))

    routes = php.functions("register_rest_route").withColumns({"space": literal(0), "tail": literal(1)}).where("space IS NOT NULL AND tail IS NOT NULL")
    options = php.args.select("file_seq", F.col("opener").alias("options_at"), F.col("args").alias("options"))
    routes = routes.withColumn("options_at", F.when(F.get(arg(2), 0)["tok"] == "[", F.get(arg(2), 0)["i"]).when(F.get(arg(2), 1)["tok"] == "(", F.get(arg(2), 1)["i"])).join(options, ["file_seq", "options_at"], "left")
    entry = lambda key: F.get(F.filter(F.transform(F.array_sort(F.map_entries("options")), lambda e: e["value"]), lambda x: (unquoted(F.get(x, 0)["tok"]) == key) & (F.get(x, 1)["tok"] == "=>")), 0)
    methods, allowed = entry("methods"), entry("permission_callback")
    verbs = F.when(F.size(methods) == 3, F.transform(F.split(F.lower(unquoted(F.get(methods, 2)["tok"])), ","), lambda x: F.trim(x)))
    body = F.get(F.filter(allowed, lambda x: x["tok"] == "{"), 0)
    is_closure = F.lower(F.get(allowed, 2)["tok"]).isin("function", "static")
    routes = routes.withColumns({"verbs": F.coalesce(verbs, F.array(F.lit("get"))), "given": F.when(F.size(allowed) == 3, unquoted(F.get(allowed, 2)["tok"])), "from": F.when(is_closure, body["i"]), "upto": F.when(is_closure, body["close"])})
    asked = php.functions("current_user_can").withColumn("cap", literal(0)).where("cap IS NOT NULL").select("file_seq", F.col("i").alias("asked_at"), "cap")
    inside = routes.where("`from` IS NOT NULL").select("file_seq", "i", "from", "upto").join(asked, "file_seq").where("asked_at > `from` AND asked_at < upto").groupBy("file_seq", "i").agg(F.min_by("cap", "asked_at").alias("cap"))
    routes = routes.join(inside, ["file_seq", "i"], "left").drop("args", "options").select("*", F.posexplode("verbs").alias("nth", "verb"))
    routes = cut(routes)
    php.tables.append(routes)
    whole = F.concat("space", "tail")
    rest_id = F.concat(F.lit("rest_"), "verb", F.lit("_"), safe(whole))
    step = F.least(F.col("nth"), F.lit(15)) * 3
    nodes = plus(nodes, node_rows(routes, 4, 10 + step, id=rest_id, label=F.concat(F.upper("verb"), F.lit(" "), whole), type=F.lit("rest_endpoint"), http_method=F.upper("verb"), route=whole, capability=F.coalesce("given", "cap")))
    edges = edges.union(edge_rows(routes, 4, F.col("caller"), rest_id, "registers_rest", "registers", 11 + step))
    keep = ["file_seq", "i", "line", "path", "file", "file_id"]
    return plus(nodes, file_nodes(found.select(keep).union(routes.select(keep)), 4)), edges


def included(php: PhpFiles) -> tuple[DataFrame, DataFrame]:
    """includes edges: a literal path, one behind the file's directory, or the .php end of another expression."""
    ends_at = F.get(F.filter("head", lambda x: x["own"] & F.lower(x["tok"]).isin(",", "and", "or", "xor")), 0)["i"]
    whole = F.col("whole")
    found = php.toks.where(F.lower("tok").isin("include", "include_once", "require", "require_once") & ~F.coalesce(F.col("p1"), F.lit("")).isin("->", "?->", "::", "function")).withColumn("caller", php.caller())
    # Brackets around the whole expression: nothing but them is at its level.
    wrapped = (F.get(whole, 0)["tok"] == "(") & (F.size(F.filter(whole, lambda x: x["own"])) == 2) & (F.element_at(whole, -1)["tok"] == ")")
    said = F.transform(whole, lambda x: x["tok"])
    said = F.when(wrapped, F.slice(said, 2, F.greatest(F.size(said) - 2, F.lit(0)))).otherwise(said)
    # Written as it is, since what is asked of it below would be worked out from the head each time.
    cropped = bound(ends_at, lambda at: F.filter("head", lambda x: at.isNull() | (x["i"] < at)))
    found = cut(found.select("file_seq", "i", "line", "path", "file", "file_id", "caller", cropped.alias("whole")).withColumn("said", said).drop("whole"))
    php.tables.append(found)
    found = found.where(F.size("said") > 0)
    text, folder = unquoted(F.element_at("said", -1)), F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    left = F.array_join(F.slice("said", 1, F.greatest(F.size("said") - 1, F.lit(0))), "")
    known = left.isin("", "__DIR__.", "dirname(__FILE__).", "plugin_dir_path(__FILE__).")
    ends = F.get("said", F.size("said") - 2) == "."
    guess = F.concat(folder, F.lit("/"), F.regexp_replace(text, "^/+", ""))
    target = F.when(left.isin("__DIR__.", "dirname(__FILE__)."), F.concat(folder, text)).when(known, F.concat(folder, F.lit("/"), text)).when(ends & text.endswith(".php"), guess)
    found = found.withColumn("to_path", lexical(target))
    hit = found.where("to_path IS NOT NULL")
    to_id = F.concat(F.lit("file_"), "to_path")
    root = F.substring("file", F.lit(1), F.length("file") - F.length("path"))
    nodes = node_rows(found, 5, 0, id=F.col("file_id"), label=base_name(F.col("path")), type=F.lit("file"), line=F.lit(0))
    nodes = plus(nodes, node_rows(hit, 5, 1, id=to_id, label=base_name(F.col("to_path")), type=F.lit("file"), file=F.concat(root, "to_path")))
    return nodes, edge_rows(hit, 5, F.col("caller"), to_id, "includes", "includes", 2)


def entities(files: DataFrame, root: str = "/plugin", first: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges, with seq, of PHP files (path, content) mounted at `root`; to be made a graph by build_graph()."""
    return entities_and_errors(files, root, first)[:2]


def entities_and_errors(files: DataFrame, root: str = "/plugin", first: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entities(), and path, line, error of the files that have a syntax error and so no entities."""
    php = PhpFiles(files, root, first)
    nodes = edges = None
    for read in (declared, called, hooked, stored, registered, included):
        some_nodes, some_edges = read(php)
        nodes = some_nodes if nodes is None else plus(nodes, some_nodes)
        edges = some_edges if edges is None else edges.union(some_edges)
    out = cut(packed(nodes)), cut(edges), php.errors
    php.drop()
    return out
