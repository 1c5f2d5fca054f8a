"""Source code as rows: tokens with their brackets, arguments of calls, and the rows of nodes and edges read from them.

A file's text becomes an array of tokens in a task, and rows for its words and brackets only; a head of any length, or
what stands between the commas of a bracket, is a slice of that array. Everything else is joins and windows over rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from graphloom.functions.text import byte_view, sanitize_id
from graphloom.sources.lexers import WORD, SourceError, Token, brackets, check_php, import_end, js_tokens, php_contexts, php_tokens, stop_of

#: Keywords whose head or statement is wanted whole, and those of declarations.
PHP_HEADS = frozenset("class interface trait enum function use namespace include include_once require require_once".split())
JS_HEADS = frozenset("function class import return".split())
DECLARING = frozenset("class interface trait enum function".split())
META = (
    "struct<namespace:string,extends:string,implements:array<string>,visibility:string,params:array<struct<name:string,type:string>>,return_type:string,priority:int,hook_name:string,http_method:string,route:string,operation:string,key:string,"
    "block_name:string,block_category:string,block_attributes:string,render_template:string,js_assets:map<string,string>,capability:string,nonce_verified:boolean,sanitization_count:int,extra:map<string,string>>"
)
FIELDS = "namespace extends implements visibility params return_type priority hook_name http_method route operation key block_name block_category block_attributes render_template js_assets capability nonce_verified sanitization_count extra".split()
EDGE_META = "struct<priority:int,hook_type:string,api_function:string>"


def _over(*by: str) -> Window:
    return Window.partitionBy("file_seq", *by).orderBy("i")


def unquoted(token: Column) -> Column:
    """Value of a literal string token; null for other tokens and strings with variables in them."""
    inner = F.substring(token, F.lit(2), F.length(token) - 2)
    single = F.regexp_replace(inner, r"\\([\\'])", "$1")
    double = F.replace(F.replace(F.regexp_replace(inner, r'\\(["\\$])', "$1"), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))
    return F.when(token.startswith("'"), single).when(token.startswith('"') & ~inner.rlike(r"(?<!\\)(\$[A-Za-z_{]|\{\$)"), double)


#: What a token row holds: its place, text and line, tokens and doc comments near it, the token behind the bracket that
#: follows it, the bracket around it, where a bracket closes, what stands between the commas of a bracket, a call's or a
#: function's, the head that a keyword opens up to its stop, a declaration's kind, name and first lines, and whether it is
#: in a class-like body; and, of PHP, the namespace, class and function that are open.
ITEM = "struct<i:int,tok:string,close:int,line:int>"
PART = "struct<i:int,tok:string,own:boolean>"
ROW = (
    "file_seq int, path string, file string, i int, tok string, line int, p1 string, p2 string, p3 string, p4 string, n1 string, n2 string, n3 string, at1 int, after string, preview string, doc string, doc1 string, doc2 string, doc3 string, "
    f"opener int, close int, stop struct<i:int,tok:string,close:int,close_line:int>, head array<{PART}>, args map<int,array<{ITEM}>>, kind string, name string, member boolean, ns string, class_name string, func_name string, is_member boolean, error string"
)
#: Of files with more tokens the order numbers of seq() would run into each other.
MOST_TOKENS = 1 << 23
ROWS_IN_BATCH, BYTES_IN_TASK = 5_000, 32 << 20


def tokens(files: DataFrame, language: str) -> DataFrame:
    """Rows of ROW for the calls, keywords and brackets of `files` (file_seq, path, file, content) that an entity may be
    read from: one ordered pass over the token array of a file gives each its surroundings, and each head, of any
    length, as a slice of that array.

    A file that can't be read gives one row, with `error` and the line, and nothing else."""

    schema = to_arrow_schema(DataType.fromDDL(ROW))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for b in batches:
            for one in b.to_pylist():
                rows += file_rows(one, language)
                for at in range(0, len(rows) - ROWS_IN_BATCH + 1, ROWS_IN_BATCH):
                    yield pa.RecordBatch.from_pylist(rows[at : at + ROWS_IN_BATCH], schema)
                rows = rows[len(rows) // ROWS_IN_BATCH * ROWS_IN_BATCH :]
        yield pa.RecordBatch.from_pylist(rows, schema)

    size = files.agg(F.sum(F.length("content"))).first()[0] or 0
    parts = max(files.sparkSession.sparkContext.defaultParallelism, size // BYTES_IN_TASK + 1)
    return files.select("file_seq", "path", "file", "content").repartition(parts, "file_seq").mapInArrow(read, ROW)


def file_rows(file: dict, language: str) -> list[dict]:
    """The rows of one file (file_seq, path, file, content)."""
    content, own = file["content"] or "", {k: file[k] for k in ("file_seq", "path", "file")}
    try:
        toks = php_tokens(content) if language == "php" else js_tokens(content)
        around, close = brackets(toks)
        if language == "php":
            check_php(toks, around, close)
        if len(toks) >= MOST_TOKENS:
            raise SourceError(1, f"more than {MOST_TOKENS} tokens")
    except SourceError as e:
        return [own | {"line": e.line, "error": e.message}]
    heads = PHP_HEADS if language == "php" else JS_HEADS
    texts, lines, n, rows = [t for t, _, _ in toks], content.split("\n"), len(toks), []
    near = lambda j: texts[j] if 0 <= j < n else None
    note = lambda j: toks[j][2] if j >= 0 else None
    around_each = php_contexts(toks, around, close) if language == "php" else None
    for i, (tok, line, doc) in enumerate(toks):
        opens, low, behind = close[i] >= 0, tok.lower(), near(i + 1)
        between = None
        if opens:
            # What stands in a call's bracket is told at the name in front.
            between = None if tok == "(" and i and WORD.match(texts[i - 1]) and texts[i - 1].lower() != "array" else _between(toks, close, i)
            if between is None and not (language == "js" and tok == "("):
                continue
            if language == "php" and tok == "{":
                continue
        elif language == "php":
            if not (WORD.match(tok) and tok[0] != "$" and (behind == "(" or low in heads or low == "new" or "kind" in around_each[i])):
                continue
        elif not (tok == "=>" or WORD.match(tok) and (behind in ("(", "=>") or tok in heads)):
            continue
        row = own | {"i": i, "tok": tok, "line": line, "doc": doc, "doc1": note(i - 1), "doc2": note(i - 2), "doc3": note(i - 3), "at1": i + 1 if i + 1 < n else None}
        row |= {"p1": near(i - 1), "p2": near(i - 2), "p3": near(i - 3), "p4": near(i - 4), "n1": behind, "n2": near(i + 2), "n3": near(i + 3)}
        row |= {"opener": around[i] if around[i] >= 0 else None, "close": close[i] if opens else None}
        if opens:
            row["after"] = near(close[i] + 1)
            row["args"] = between
        elif behind == "(":
            row["args"], row["after"] = _between(toks, close, i + 1), near(close[i + 1] + 1)
        if low in heads:
            end = import_end(toks, i) if language == "js" and low == "import" else stop_of(toks, close, i, low != "return")
            if end < n:
                shut = close[end] if close[end] >= 0 else None
                row["stop"] = {"i": end, "tok": texts[end], "close": shut, "close_line": None if shut is None else toks[shut][1]}
                if low in DECLARING:
                    row["preview"] = "\n".join(lines[line - 1 : min(line + 29, line if shut is None else toks[shut][1])])
            row["head"] = [{"i": j, "tok": texts[j], "own": around[j] == around[i]} for j in range(i + 1, end)]
            if low == "function":
                opened = next((j for j in range(i + 1, end) if texts[j] == "("), None)
                row["args"] = None if opened is None else _between(toks, close, opened)
        if around_each:
            row |= around_each[i]
        rows.append(row)
    return rows


def _between(toks: list[Token], close: list[int], i: int) -> list[tuple[int, list[dict]]] | None:
    """What stands between the commas of the bracket that opens at `i`, by position; brackets within stand for themselves."""
    parts: dict[int, list[dict]] = {}
    nth, j = 0, i + 1
    while j < close[i]:
        if toks[j][0] == ",":
            nth += 1
        else:
            shut = close[j] if close[j] >= 0 else None
            parts.setdefault(nth, []).append({"i": j, "tok": toks[j][0], "close": shut, "line": toks[j][1]})
            if shut is not None:
                parts[nth].append({"i": shut, "tok": toks[shut][0], "close": None, "line": toks[shut][1]})
                j = shut
        j += 1
    return list(parts.items()) or None


def errors(toks: DataFrame) -> DataFrame:
    """path, line, error of every file that gave no entities."""
    return toks.where("error IS NOT NULL").select("path", "line", "error")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of `value`, which is computed once however often `f` names it, also for each item of an array."""
    return F.get(F.transform(F.array(value), f), 0)


def arg(n: int | Column) -> Column:
    return F.try_element_at("args", F.lit(n) if isinstance(n, int) else n)


def literal(n: int | Column) -> Column:
    """The value of argument `n` if it is one literal string."""
    return F.when(F.size(arg(n)) == 1, unquoted(F.get(arg(n), 0)["tok"]))


def seq(visitor: int, step: int | Column = 0) -> Column:
    """Place of an entity: file, token, kind of entity, and step among those of one kind."""
    return F.shiftleft(F.col("file_seq").cast("bigint"), 32) + F.col("i").cast("bigint") * 512 + visitor * 64 + step


#: Columns of node rows before their metadata is one struct.
FLAT = dict(x.split(":", 1) for x in re.split(r",(?![^<]*>)", re.sub(r"^struct<|>$", "", META)))


def node_rows(df: DataFrame, visitor: int, step: int | Column = 0, **columns: Column) -> DataFrame:
    """Node rows from `df` (file_seq, i, file, line); `columns` are named as the row's own and as FIELDS of its metadata.
    What isn't given is no column; plus() and packed() fill it with null."""
    given = {"file": F.col("file"), "line": F.col("line")} | columns | {"id": sanitize_id(columns["id"]), "seq": seq(visitor, step)}
    return df.select(*[c.cast(FLAT.get(n, OWN.get(n, "string"))).alias(n) for n, c in given.items()])


#: Types of a node row's own columns that are no strings.
OWN = {"seq": "bigint", "line": "int"}


def plus(*rows: DataFrame) -> DataFrame:
    """All rows of node_rows(), by the names of their columns."""
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def packed(nodes: DataFrame) -> DataFrame:
    """Rows of node_rows() with all columns, and metadata as one struct."""
    told = lambda n, t: F.col(n) if n in nodes.columns else F.expr(f"CAST(NULL AS {t}) AS {n}")
    own = [told(n, OWN.get(n, "string")) for n in ("id", "seq", "label", "type", "subtype", "file", "line")]
    return nodes.select(*own, F.struct(*[told(f, FLAT[f]) for f in FIELDS]).alias("metadata"), told("docblock", "string"), told("source_preview", "string"))


def edge_rows(df: DataFrame, visitor: int, source: Column, target: Column, kind: str | Column, label: str | Column, step: int | Column = 1, **metadata: Column) -> DataFrame:
    as_column = lambda c: F.lit(c) if isinstance(c, str) else c
    fields = F.struct(*[metadata.get(f, F.lit(None)).alias(f) for f in ("priority", "hook_type", "api_function")]).cast(EDGE_META)
    return df.select(sanitize_id(source).alias("source"), sanitize_id(target).alias("target"), as_column(kind).alias("type"), as_column(label).alias("label"), seq(visitor, step).alias("seq"), fields.alias("metadata"))


def safe(c: Column) -> Column:
    """Every byte outside [a-zA-Z0-9_] becomes an underscore."""
    return F.regexp_replace(byte_view(c), "[^a-zA-Z0-9_]", "_")


def lexical(path: Column) -> Column:
    """`path` without empty parts, `.` and `..`."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    return F.aggregate(parts, F.array().cast("array<string>"), lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x))), lambda s: F.array_join(s, "/"))
