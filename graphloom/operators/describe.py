"""Texts about nodes: descriptions by type, payloads for a language model, and what comes back from one."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import is_js_file, ucfirst

#: Words of a data source's text by operation and by subtype.
VERBS = {"write": "Writes to", "delete": "Deletes"}
STORES = {
    "option": "WordPress option", "site_option": "WordPress site option", "post_meta": "post meta", "user_meta": "user meta", "term_meta": "term meta",
    "comment_meta": "comment meta", "transient": "WordPress transient", "cache": "WordPress object cache", "database": "database",
}
#: Types whose text holds the label only.
PLAIN = {
    "shortcode": "WordPress shortcode [%s].", "admin_page": "WordPress admin page '%s'.", "cron_job": "Scheduled cron event '%s'.", "post_type": "Custom post type '%s'.", "taxonomy": "Custom taxonomy '%s'.",
    "react_component": "React component '%s'.", "react_hook": "React hook '%s'.", "js_function": "JavaScript function.", "js_class": "JavaScript class.", "js_hook": "WordPress JS hook '%s'.",
    "wp_store": "WordPress data store '%s'.",
}
#: Order in which types are shown to a model.
FIRST_TYPES = ("class", "interface", "function", "rest_endpoint", "ajax_handler", "hook", "data_source")


def _given(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _mapped(c: Column, values: dict[str, str], rest: str) -> Column:
    out = F.lit(rest)
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def params_text(params: Column) -> Column:
    """Parameters (name, type) as a list in words."""
    return F.array_join(F.transform(params, lambda p: F.concat_ws(" ", F.nullif(p["type"], F.lit("")), F.concat(F.lit("$"), F.regexp_replace(p["name"], r"^\$", "")))), ", ")


def safety(m: Callable[[str], Column]) -> list[Column]:
    nonce = F.when(F.coalesce(m("nonce_verified"), F.lit(False)), "Nonce-verified")
    return [nonce, F.when(m("sanitization_count") > 0, _plural(m("sanitization_count"), "sanitization call"))]


def description(index: Callable[[str], Column] | None = None) -> Column:
    """Text of a node row (id, label, type, subtype, metadata) by its type; null for unknown types.

    index: edge type to the number of such edges at the node; without it no count is told."""
    m = lambda name: F.col(f"metadata.{name}")
    n = index or (lambda _: F.lit(None).cast("bigint"))
    place = F.when(_given(m("namespace")), F.concat(F.lit("in namespace "), m("namespace")))
    detail = F.concat_ws(", ", F.when(_given(m("extends")), F.concat(F.lit("extends "), m("extends"))), F.when(F.size(m("implements")) > 0, F.concat(F.lit("implements "), F.array_join(m("implements"), ", "))))
    cls = F.concat(F.concat_ws(" ", F.lit("PHP class"), place), F.when(detail != "", F.concat(F.lit(". "), ucfirst(detail))).otherwise(""), F.lit("."))
    interface = F.concat(F.concat_ws(" ", F.lit("PHP interface"), place, F.when(n("has_method") > 0, F.concat(F.lit("with "), _plural(n("has_method"), "method")))), F.lit("."))
    trait = F.concat(F.concat_ws(" ", F.lit("PHP trait"), place), F.lit("."))
    accepts, returns = F.when(F.size(m("params")) > 0, F.concat(_plural(F.size(m("params")), "parameter"), F.lit(" ("), params_text(m("params")), F.lit(")"))), F.when(_given(m("return_type")), F.concat(F.lit("returns "), m("return_type")))
    head = F.concat_ws(" ", F.when(_given(m("visibility")), ucfirst(m("visibility"))), F.lit("standalone PHP function"), F.concat(F.lit("accepting "), accepts))
    function = F.concat(F.concat_ws(", ", head, returns), F.lit("."))
    owner = F.regexp_extract("id", "^method_(.+)_[^_]+$", 1)
    what = F.concat_ws(", ", F.concat(F.lit("Accepts "), accepts), returns)
    method = F.concat(F.concat_ws(" ", F.when(_given(m("visibility")), F.concat(ucfirst(m("visibility")), F.lit(" method"))).otherwise("Method"), F.when(owner != "", F.concat(F.lit("of "), owner))), F.when(what != "", F.concat(F.lit(". "), what)).otherwise(""), F.lit("."))
    hook = F.concat(
        F.concat_ws(
            " ",
            F.concat(F.lit("WordPress "), F.coalesce("subtype", F.lit("action")), F.lit(" hook")),
            F.when((m("hook_name") != "dynamic") & (m("hook_name") != F.col("label")), F.concat(F.lit("'"), m("hook_name"), F.lit("'"))),
            F.when(m("priority") != 10, F.concat(F.lit("registered with priority "), m("priority").cast("string"))),
            F.when(n("registers_hook") > 1, F.concat(F.lit("("), n("registers_hook").cast("string"), F.lit(" callbacks)"))),
        ),
        F.lit("."),
    )
    allowed = F.when(m("capability") == "__return_true", "Public (no auth required)").when(m("capability").isNotNull(), F.concat(F.lit("Requires '"), m("capability"), F.lit("' capability")))
    rest = F.concat(F.concat_ws(". ", F.concat(F.lit("REST API endpoint: "), F.coalesce(m("http_method"), F.lit("GET")), F.lit(" "), F.coalesce(m("route"), F.col("label"))), allowed, *safety(m)), F.lit("."))
    open_ = F.when(m("hook_name").startswith("wp_ajax_nopriv_"), "Accessible to unauthenticated users (nopriv)").otherwise("Authenticated users only (wp_ajax_*)")
    ajax = F.concat(F.concat_ws(". ", F.concat(F.lit("AJAX handler for action '"), F.col("label"), F.lit("'")), open_, *safety(m)), F.lit("."))
    quoted = lambda c: F.when(c.isNotNull(), F.concat(F.lit(" '"), c, F.lit("'"))).otherwise("")
    data = F.concat(_mapped(m("operation"), VERBS, "Reads"), F.lit(" "), _mapped(F.col("subtype"), STORES, "data store"), quoted(m("key")), F.lit("."))
    http = F.concat(F.lit("Outbound HTTP "), F.coalesce(m("http_method"), F.lit("GET")), F.lit(" request"), F.when(m("route").isNotNull(), F.concat(F.lit(" to "), m("route"))).otherwise(""), F.lit("."))
    block = F.concat(F.concat_ws(". ", F.concat(F.lit("Gutenberg block '"), F.coalesce(m("block_name"), F.col("label")), F.lit("'")), F.concat(F.lit("Category: "), m("block_category"))), F.lit("."))
    api = F.concat(F.lit("JavaScript API call"), F.when(m("route").isNotNull(), F.concat(F.lit(" to "), m("route"))).otherwise(""), F.lit("."))
    request = F.concat(F.concat_ws(" ", F.when(F.col("type") == "axios_call", "Axios").otherwise("Fetch"), m("http_method"), F.lit("request"), F.concat(F.lit("to "), m("route"))), F.lit("."))
    includes = F.coalesce(n("includes"), F.lit(0))
    file = F.concat(F.when(is_js_file(F.coalesce("file", "label")), "JavaScript").otherwise("PHP"), F.lit(" file."), F.when(includes > 0, F.concat(F.lit(" Includes "), _plural(includes, "other file"), F.lit("."))).otherwise(""))
    by_type = {"fetch_call": request, "axios_call": request, "file": file, "class": cls, "interface": interface, "trait": trait, "function": function, "method": method, "hook": hook, "rest_endpoint": rest, "ajax_handler": ajax, "data_source": data, "http_call": http, "gutenberg_block": block, "js_api_call": api}
    by_type |= {t: F.format_string(x, F.coalesce("label", F.lit(""))) if "%s" in x else F.lit(x) for t, x in PLAIN.items()}
    out = F.lit(None).cast("string")
    for t, c in by_type.items():
        out = F.when(F.col("type") == t, c).otherwise(out)
    return ucfirst(out)


def batches(nodes: DataFrame, order: list[str], size: int = 25) -> DataFrame:
    """Nodes with batch: `size` successive nodes each."""
    from graphloom.operators.lineage import numbered

    return numbered(nodes, order, "nth__").withColumn("batch", F.floor(F.col("nth__") / size).cast("bigint")).drop("nth__")


def samples(nodes: DataFrame, most: int = 20) -> DataFrame:
    """The first described nodes of FIRST_TYPES, by the priority of their type and then seq."""
    rank = F.array_position(F.array(*[F.lit(t) for t in FIRST_TYPES]), F.col("type"))
    return nodes.where((F.col("description") != "") & F.col("type").isin(*FIRST_TYPES)).withColumn("rank__", rank).orderBy("rank__", "seq").limit(most).drop("rank__")


def parse_reply(reply: Column, provider: str | None = None) -> Column:
    """Map of id to text in a model's reply: the outermost braces, fenced or not, as a map of which only strings count.

    Without one, the forms that providers fall back to, the first that gives something: `ollama` two lists `entity_ids`
    and `descriptions`; `claude` {id: {"description": text}}, then the strings of the first object within; `api` none;
    no provider all of them. Null if there is no JSON object, an empty map if it holds nothing of this."""
    plain = F.regexp_replace(F.regexp_replace(reply, r"(?m)^```(?:json)?\s*", ""), r"(?m)\s*```$", "")
    inner = F.nullif(F.regexp_extract(plain, r"(?s)\{.*\}", 0), F.lit(""))
    whole = F.from_json(F.when(F.try_parse_json(inner).isNotNull(), inner), "map<string,variant>")
    kind = lambda v: F.schema_of_variant(v)
    string = lambda v: F.try_variant_get(v, "$", "string")
    strings = lambda m: F.transform_values(F.map_filter(m, lambda _, v: kind(v) == "STRING"), lambda _, v: string(v))
    nothing = F.create_map().cast("map<string,string>")
    texts = lambda key: F.try_variant_get(F.try_element_at(whole, F.lit(key)), "$", "array<variant>")
    pairs = F.arrays_zip(texts("entity_ids").alias("id"), texts("descriptions").alias("text"))
    lists = F.map_from_entries(F.filter(F.transform(F.filter(pairs, lambda x: (kind(x["id"]) == "STRING") & (kind(x["text"]) == "STRING")), lambda x: F.struct(string(x["id"]).alias("key"), string(x["text"]).alias("value"))), lambda x: x["key"].isNotNull()))
    told = lambda v: F.try_variant_get(v, "$.description", "variant")
    nested = F.transform_values(F.map_filter(whole, lambda _, v: kind(v).startswith("OBJECT") & (kind(told(v)) == "STRING")), lambda _, v: string(told(v)))
    within = F.filter(F.transform(F.map_values(whole), lambda v: strings(F.try_variant_get(v, "$", "map<string,variant>"))), lambda m: F.size(m) > 0)
    forms = {"ollama": [lists], "claude": [nested, F.get(within, 0)], "api": [], None: [lists, nested, F.get(within, 0)]}[provider]
    some = [F.when(F.size(m) > 0, m) for m in (strings(whole), *forms)]
    return F.when(whole.isNotNull(), F.coalesce(*some, nothing))


def badges() -> Column:
    """What is known of a node's safety, as short words: its capability or that it is public, a nonce or the lack of one
    at an endpoint, sanitising calls. Empty for other types, and where nothing is known."""
    m = lambda name: F.col(f"metadata.{name}")
    nonce, n = F.coalesce(m("nonce_verified"), F.lit(False)), F.coalesce(m("sanitization_count"), F.lit(0))
    told = F.array(
        F.when(m("capability") == "__return_true", "public").otherwise(F.concat(F.lit("capability "), m("capability"))),
        F.when(nonce, "nonce").when(F.col("type").isin("rest_endpoint", "ajax_handler"), "no nonce"),
        F.when(n > 0, F.concat(F.lit("sanitize "), n.cast("string"))),
    )
    known = F.col("type").isin("rest_endpoint", "ajax_handler", "function", "method") & (m("capability").isNotNull() | nonce | (n > 0))
    return F.when(known, F.array_compact(told)).otherwise(F.array().cast("array<string>"))


def summary(plugin: DataFrame, nodes: DataFrame, edges: DataFrame, client: Callable[[str], str]) -> str | None:
    """A model's overview of a graph, from counts by type and the first described nodes; null if it raises or says no
    more than 50 bytes. What is asked is bounded: a count per type, and 20 samples."""
    counts = {r.type: r.n for r in nodes.groupBy("type").agg(F.count("*").alias("n"), F.min("seq").alias("first")).orderBy(F.desc("n"), "first").collect()}
    shown = [f"[{r.type}] {r.label}: {r.description}" for r in samples(nodes).select("type", "label", "description").collect()]
    told = {**(plugin.select("name", "version").first() or plugin.sparkSession.createDataFrame([(None, None)], "name string, version string").first()).asDict(), "types": counts, "nodes": sum(counts.values()), "edges": edges.count(), "samples": shown}
    asked = "Tell an experienced developer in a few paragraphs of plain prose what this code base is for, what it consists of and how it is connected to its host system.\n\n" + json.dumps(told, ensure_ascii=False)
    try:
        text = client(asked)
    except Exception:  # noqa: BLE001  whatever the client raises
        return None
    return text.strip() if text is not None and len(text.encode()) > 50 else None


def ask(payloads: DataFrame, client: Callable[[str], str]) -> DataFrame:
    """batch, reply of every row (batch, payload); a call that raises is tried once more and then has no reply."""

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            replies = []
            for payload in frame["payload"]:
                reply = None
                for _ in range(2):
                    try:
                        reply = client(payload)
                        break
                    except Exception:  # noqa: BLE001  whatever the client raises
                        continue
                replies.append(reply)
            yield pd.DataFrame({"batch": frame["batch"], "reply": replies})

    return payloads.select("batch", "payload").mapInPandas(call, "batch long, reply string")


def with_replies(nodes: DataFrame, replies: DataFrame) -> DataFrame:
    """Nodes whose description is the model's, where it gave one."""
    told = replies.select(F.explode(parse_reply(F.col("reply"))).alias("id", "told")).groupBy("id").agg(F.max("told").alias("told"))
    return nodes.join(told, "id", "left").withColumn("description", F.coalesce("told", "description")).drop("told")


#: Fields of a node's metadata that a model is told, if they say something.
TOLD = ("namespace", "extends", "implements", "hook_name", "http_method", "route", "operation", "key", "block_name")


def entity_payload(connections: Column, most: int = 10, lines: int = 10) -> Column:
    """JSON of what a model is told of a node: id, type, label, fields of its metadata that aren't empty, its first
    `most` connections, the first `lines` lines of its source. What there isn't has no key."""

    def said(name: str) -> Column:
        value = F.col(f"metadata.{name}")
        return F.when(F.size(value) > 0, value) if name == "implements" else F.when(~value.isin("", "0"), value)

    source = F.substring_index("source_preview", "\n", lines)
    return F.to_json(F.struct("id", "type", "label", *[said(n).alias(n) for n in TOLD], F.when(F.size(connections) > 0, F.slice(connections, 1, most)).alias("connections"), source.alias("code_snippet")))


def payloads(nodes: DataFrame, links: DataFrame, order: list[str], size: int = 25) -> DataFrame:
    """batch, payload: a JSON list of the entity_payload() of `size` successive nodes, with the connections that `links`
    (id, nth, text) tells. Library nodes are not asked for."""
    listed = links.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]).alias("connections"))
    asked = nodes.where("NOT coalesce(is_library, false)") if "is_library" in nodes.columns else nodes
    rows = batches(asked, order, size).join(listed, "id", "left").withColumn("payload__", entity_payload(F.col("connections")))
    return rows.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, "payload__"))), lambda x: x["payload__"]).alias("list")).select("batch", F.concat(F.lit("["), F.array_join("list", ","), F.lit("]")).alias("payload"))
