"""Column functions over ids, paths, routes and source text. Patterns see bytes where the byte view is taken."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions import catalog


def byte_view(c: Column) -> Column:
    """The UTF-8 bytes of a string, each as one character."""
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def sanitize_id(c: Column) -> Column:
    """Every byte outside [a-zA-Z0-9_-] becomes an underscore."""
    return F.regexp_replace(byte_view(c), "[^a-zA-Z0-9_-]", "_")


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def directories(path: Column) -> Column:
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def extension(path: Column) -> Column:
    name = base_name(path)
    return F.when(name.contains("."), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def stem(path: Column) -> Column:
    """The lower-cased file name up to its last dot."""
    return F.regexp_replace(F.lower(base_name(path)), r"\.[^.]*$", "")


def in_library_directory(path: Column) -> Column:
    versioned = r"(?i)^[a-z][a-z0-9_-]+-\d+\.\d+"
    return F.exists(directories(path), lambda d: F.lower(d).isin(*catalog.LIBRARY_SEGMENTS) | d.rlike(versioned))


def is_library(path: Column, node_type: Column | None = None, label: Column | None = None) -> Column:
    """Whether a node comes from a bundled library: by directory, stem, or a minified name of a JS node."""
    prefixes = "^(" + "|".join(re.escape(x) for x in catalog.LIBRARY_PREFIXES) + ")($|[-.])"
    js = F.lower(base_name(path)).endswith(".js") & (stem(path).rlike(prefixes) | stem(path).isin(*catalog.SCAFFOLD_STEMS))
    php = F.lower(base_name(path)).endswith(".php") & stem(path).isin(*catalog.LIBRARY_PHP_STEMS)
    tagged = F.coalesce(in_library_directory(path) | js | php, F.lit(False))
    if node_type is None or label is None:
        return tagged
    return tagged | (node_type.isin("js_function", "js_class") & (F.octet_length(label) <= 2))


def is_js_file(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*catalog.JS_EXTENSIONS), F.lit(False))


def route_key(route: Column) -> Column:
    """A route without host, API root, query and outer slashes, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(route, r"^https?://[^/]+", ""), r"^/?wp-json/", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"(?<!\()[?#].*$", ""), r"^/+|/+$", ""))


def static_route(key: Column) -> Column:
    """What stands before the first dynamic segment of a route key."""
    return F.regexp_replace(key, r"(?i)/?\(\?P?[<'][^)]+\).*$", "")


def query_param(url: Column, name: str) -> Column:
    """Value of a query parameter, null without one."""
    return F.nullif(F.regexp_extract(url, rf"[?&]{re.escape(name)}=([^&\s'\"]+)", 1), F.lit(""))


def bare_action(hook: Column) -> Column:
    return F.regexp_replace(hook, "^wp_ajax_(nopriv_)?", "")


def capability(source: Column) -> Column:
    """The capability that source text checks, null without one."""
    own = F.regexp_extract(source, r"current_user_can\s*\(\s*['\"]([a-z_]+)['\"]\s*\)", 1)
    other = F.regexp_extract(source, r"user_can\s*\([^,]+,\s*['\"]([a-z_]+)['\"]\s*\)", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(other, F.lit("")))


def contains_any(source: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | source.contains(w)
    return found


def verifies_nonce(source: Column) -> Column:
    return contains_any(source, catalog.NONCE_CALLS)


def count_calls(source: Column, names: Sequence[str] = tuple(catalog.SANITIZERS)) -> Column:
    """Sum over `names` of how often `name(` occurs."""
    total = F.lit(0)
    for n in names:
        total = total + F.regexp_count(source, F.lit(re.escape(n) + r"\("))
    return total


def doc_summary(block: Column, most: int = 300) -> Column:
    """First paragraph of a doc comment before any tag, or the first line of plain text; null if empty."""
    line = lambda x: F.rtrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"^\s*/\*+\s?", ""), r"\s*\*/\s*$", ""), r"^\s*\*\s?", ""))
    lines = F.filter(F.transform(F.split(block, "\n"), line), lambda x: x != "/")
    start = F.struct(F.lit(False).alias("over"), F.lit("").alias("text"))

    def step(state: Column, x: Column) -> Column:
        ends = x.startswith("@") | ((x == "") & (state["text"] != ""))
        more = F.when(x == "", state["text"]).otherwise(F.concat(state["text"], F.lit(" "), x))
        return F.when(state["over"], state).otherwise(F.struct(ends.alias("over"), F.when(ends, state["text"]).otherwise(more).alias("text")))

    commented = F.trim(F.regexp_replace(F.aggregate(lines, start, step, lambda s: s["text"]), r"\s+", " "))
    plain = F.trim(F.split(F.trim(block), "\n")[0])
    return F.nullif(F.left(F.when(F.ltrim(block).startswith("/*"), commented).otherwise(plain), F.lit(most)), F.lit(""))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def edge_note(api_function: Column, priority: Column, hook_type: Column, http_method: Column) -> Column:
    """What an edge's metadata says beside its type."""
    return F.concat_ws(", ", api_function, F.when(priority != 10, F.concat(F.lit("priority "), priority.cast("string"))), hook_type, http_method)


def host_path(path: Column, line: Column, host: str, root: str = "/plugin") -> Column:
    """A path under the scan root as the host knows it, with its line."""
    moved = F.regexp_replace(path, f"^{re.escape(root)}", host)
    return F.when(line > 0, F.concat(moved, F.lit(":"), line.cast("string"))).otherwise(moved)


def ucfirst(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 2**31 - 1))
