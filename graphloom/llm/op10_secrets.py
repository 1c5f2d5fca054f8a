"""Secret scans over an incremental blob ledger, in DataFrame expressions only.

Every version of a text is a blob, addressed by its SHA-256. The ledger holds what each pair of blob and rule
version gave; a scan reads only pairs that the ledger lacks, once per blob however many paths hold it, and
findings are joined back to all paths by address. A rule version is told by kind, version and a hash of what
it does, so that an edited pattern counts as a new one. Spans carry their kind, so a ledger outlives any
change of the rules' order.

Positions come from one split per rule: between n matches lie n + 1 pieces, and the running lengths of
pieces and matches are the spans, in code points.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, fresh_name, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost non-overlapping matches of `pattern`; those whose `group` is shorter than
    `least` are dropped. `hint` is a cheap pattern that every matching text contains."""

    kind: str
    pattern: str
    group: int
    least: int
    hint: str
    version: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        what = "\0".join((self.pattern, str(self.group), str(self.least), self.hint))
        return f"{self.kind}@{self.version}#{hashlib.sha256(what.encode()).hexdigest()[:12]}"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _any_case("api") + "_?" + _any_case("key")
#: Base rules first, in the order in which their kinds are listed.
RULES = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, f"({_NAMES})", base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, "AKIA[A-Z0-9]{16}", base=True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, "[0-9a-f]{24}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN "),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, "eyJ"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "gh[pousr]_"),
)

BLOCK = 128
SPAN = "array<struct<start:int,kind:string,end:int>>"
FOUND = "array<struct<start:int,rank:int,end:int>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, kind, end) of a rule's matches that pass, in text order."""
    pieces = F.transform(F.split(text, rule.pattern, -1), F.length)
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    lengths = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("gap"), F.transform(matches, F.length).alias("size"), F.transform(tested, F.length).alias("tested"))

    def add(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["size"]
        span = F.struct(begin.alias("start"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["tested"] >= rule.least, F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    def add_block(state: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(state["at"].alias("at"), F.array().cast(SPAN).alias("found")), add)
        return F.struct(inner["at"].alias("at"), F.concat(state["found"], F.array(inner["found"])).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))
    found = F.aggregate(blocks(lengths), start, add_block, lambda s: F.flatten(s["found"]))
    return F.when(text.rlike(rule.hint), found).otherwise(F.array().cast(SPAN))


def blocks(items: Column) -> Column:
    """An array's items in arrays of BLOCK: a fold that appends does it within a block and then block by block, so that a
    text with many matches costs a small multiple of their number."""
    return F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))).otherwise(F.array(items))


def may_hold(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a text holds the hint of any rule; without one it has no secret."""
    hit = F.lit(False)
    for r in rules:
        hit = hit | text.rlike(r.hint)
    return hit


def address(text: Column) -> Column:
    return F.sha2(text, 256)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """Ledger rows (blob, rule, spans) of every pair of blob and rule version that `ledger` lacks.

    `blobs`: blob, text with one row per blob. A blob is scanned only for the rule versions it has not seen; one
    that has seen all is not read further. Pairs without a finding are recorded too."""
    if ledger is None:
        todo = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
        todo = todo.where(F.size(F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.col("seen"))) > 0)
    tests = [F.when(~F.array_contains("seen", r.key), F.struct(F.lit(r.key).alias("rule"), spans_of(F.col("text"), r).alias("spans"))) for r in rules]
    return todo.select("blob", F.explode(F.array_compact(F.array(*tests))).alias("t")).select("blob", "t.*")


def blobs_of(versions: DataFrame) -> DataFrame:
    """One row (blob, text) per distinct text; copies meet before the shuffle as well as after it."""
    text = text_or_empty()
    return versions.select(address(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))


def extend_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The Parquet ledger in the shared folder `path`, after the pairs that it lacked for `versions` (any columns,
    with text) have been scanned and appended. A folder that isn't there is an empty ledger.

    A run that is lost before its commit appends nothing; what two runs append at once is the same rows twice,
    which readers take as one. Rows of removed and old rule versions stay, and are not read by present rules."""
    spark = versions.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    ledger = spark.read.parquet(path) if there else None
    scan_blobs(blobs_of(versions), rules, ledger).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def found_blobs(versions: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """blob, found (start, rank among `rules`, end; by start and rank) of every blob that has a finding.

    Known pairs come from the ledger, unseen ones from a scan. Texts without a hint of any rule have no finding and
    don't move. The table is written, so that a blob of a third of all paths is a skewed key that AQE splits."""
    fresh = scan_blobs(blobs_of(versions.where(may_hold(text_or_empty(), rules))), rules, ledger)
    if ledger is not None:
        known = ledger.where(F.col("rule").isin([r.key for r in rules])).select("blob", "rule", "spans").dropDuplicates(["blob", "rule"])
        fresh = fresh.unionByName(known)
    ranks = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    ranked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.try_element_at(ranks, s["kind"]).alias("rank"), s["end"].alias("end")))
    found = fresh.where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_list(ranked)).alias("found"))
    return cut(found.select("blob", F.array_sort("found").cast(FOUND).alias("found")))


def findings(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """path, blob, found for every row of `versions` (path, text): all spans by start and then the kind's rank.

    Null texts are empty; repeated rows each have their findings; no rows give an empty result. Of `ledger`, what
    blobs of other texts, removed rules and old versions gave isn't taken."""
    paths = versions.select(F.col(path), address(text_or_empty()).alias("blob"))
    return paths.join(found_blobs(versions, rules, ledger), "blob", "left").select(path, "blob", F.coalesce("found", F.array().cast(FOUND)).alias("found"))


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of `docs`.

    A null or empty text has no spans. Repeated rows get equal results. An empty table gives an empty
    result. Texts are scanned whole. Other columns are ignored."""
    base = [i for i, r in enumerate(rules) if r.base]
    count = lambda kind: F.size(F.filter("found", lambda s: s["rank"] == [r.kind for r in rules].index(kind))).cast("bigint")
    own = F.filter("found", lambda s: s["rank"].isin(base))
    return findings(docs, "doc_id", rules, ledger).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed(own, rules), 256).alias("base_sha256"),
        _listed(F.col("found"), rules).alias("spans"),
    )


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """`docs` with every span in `text` replaced by [kind]; rows and other columns stay as they are.

    Overlapping spans are replaced as one, under the kind that starts first, or ranks first. A null text stays
    null, an empty one empty; repeated rows stay repeated; an empty table stays empty. Columns of `docs` may have
    any names."""
    blob, spans = fresh_name(docs, "blob"), fresh_name(docs, "found")
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    held = F.coalesce(may_hold(F.col("text"), rules), F.lit(False))
    found = found_blobs(docs, rules, ledger).toDF(blob, spans)
    joined = docs.where(held).withColumn(blob, address(text_or_empty())).join(found, blob, "left")
    whole = F.col("text")

    def cut_out(s: Column, x: Column) -> Column:
        label = F.concat(F.lit("["), F.get(kinds, x["rank"]), F.lit("]"))
        fresh = F.array(F.substring(s["part"], s["at"] - s["base"] + 1, x["start"] - s["at"]), label)
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["out"], fresh)).otherwise(s["out"]).alias("out"), s["base"].alias("base"), s["part"].alias("part"))

    def cut_block(s: Column, block: Column) -> Column:
        upto = F.greatest(s["at"], F.coalesce(F.array_max(F.transform(block, lambda x: x["end"])), s["at"]))
        begin = F.struct(s["at"].alias("at"), F.array().cast("array<string>").alias("out"), s["at"].alias("base"), F.substring(whole, s["at"] + 1, upto - s["at"]).alias("part"))
        inner = F.aggregate(block, begin, cut_out)
        return F.struct(inner["at"].alias("at"), F.concat(s["out"], F.array(inner["out"])).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<string>>").alias("out"))
    cleaned = F.aggregate(blocks(F.col(spans)), start, cut_block, lambda s: F.array_join(F.concat(F.flatten(s["out"]), F.array(F.substring(whole, s["at"] + 1, F.length(whole)))), ""))
    text = F.when(F.col(spans).isNull(), whole).otherwise(cleaned)
    redacted = joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    return docs.where(~held).unionByName(redacted)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(table(spark, sf_dir, "documents"))


def _sql_spans(rule: Rule, rank: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s, length(m[i]) AS n, length(g[i]) AS tested
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, string_split_regex(body, '{p}') AS p, regexp_extract_all(body, '{p}', 0) AS m, regexp_extract_all(body, '{p}', {rule.group}) AS g FROM docs))
    WHERE length(g[i]) >= {rule.least}"""


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
found AS ({' UNION ALL '.join(_sql_spans(r, i) for i, r in enumerate(RULES))}
), told AS (
    SELECT doc_id, count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS k, count(*) FILTER (rank = 2) AS h,
        string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) FILTER (rank < 3) AS base, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, rank) AS spans
    FROM found GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN told USING (doc_id)
"""
