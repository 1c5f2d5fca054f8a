"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

The roles that count are an optional system turn, then user and assistant in turn, ending with the assistant; an empty
conversation counts too. What has been written so far is one of four states: nothing, a system turn, a user turn (an
answer is due), an assistant turn. A Spark SQL fold, aggregate() over the sorted structs of turns, carries one
(cost, audit) struct for each state, and native least() keeps the cheapest, of equals the one whose audit is least.

A conversation may be long, so its turns are folded by chunks of CHUNK turns, once from each state; a second fold
combines the chunks. Of equal cost and equal turns no audit is the beginning of another, as one more insertion costs
more, so the least of the whole is made of the least of the chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import table

CHUNK, NEVER = 512, 1 << 40
STATES = ("start", "system", "user", "assistant")
WORDLESS = r"^[\x20\x09-\x0D]*$"
UNENDED = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*$"
COST = "struct<cost:bigint,audit:string>"


def conversation_key(conv_id: Column) -> Column:
    """A key that is never null: null ids make one conversation."""
    return F.coalesce(F.concat(F.lit("k"), conv_id.cast("string")), F.lit("null"))


def damaged(rows: DataFrame) -> DataFrame:
    """key, turn, role, text, copy: by crc32(`conv_id:turn`) % 20, 0 drops a row, 1 empties its text, 2 takes `.!?` out of
    it, 3 repeats it, 4 makes its role user. A null is one space, in the hash, in role and in text; a null turn stays."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    base = rows.select(conversation_key(F.col("conv_id")).alias("key"), F.col("turn"), told("role").alias("role"), told("text").alias("text"), h.alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return base.where("h != 0").select("key", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def placed(rows: DataFrame) -> DataFrame:
    """`rows` (key, turn, role, text, copy) with pos from 1 in their conversation: by turn, nulls first, then role and text."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "copy")).cast("bigint"))


def flagged(rows: DataFrame) -> DataFrame:
    """key, pos, turn, initial, fault, illegal, fresh (a turn number not seen before) of every row of placed(): the first
    of blank, duplicate and truncated, and whether its role may not follow the one before."""
    order = Window.partitionBy("key").orderBy("pos")
    again = F.row_number().over(Window.partitionBy("key", "role", "text").orderBy("pos")) > 1
    fault = F.when(F.col("text").rlike(WORDLESS), "blank").when(F.col("again"), "duplicate").when(F.col("text").rlike(UNENDED), "truncated")
    narrow = rows.withColumn("again", again).select("key", "pos", "turn", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    before, last = F.lag("initial").over(order), F.lag("turn").over(order)
    illegal = before.isNotNull() & ~F.concat(before, F.col("initial")).isin("su", "ua", "au")
    fresh = F.col("turn").isNotNull() & (last.isNull() | (last != F.col("turn")))
    return narrow.withColumns({"illegal": illegal, "fresh": fresh})


def _with(state: Column, cost: int | Column, edit: str) -> Column:
    """A (cost, audit) after one more edit."""
    return F.struct((state["cost"] + (F.lit(cost) if isinstance(cost, int) else cost)).cast("bigint").alias("cost"), F.concat(state["audit"], F.lit(edit)).alias("audit"))


def _inserted(s: dict[str, Column]) -> Column:
    """The four states after empty turns that may be inserted here."""
    user = F.least(s["user"], *[_with(s[x], 5, "I") for x in ("start", "system", "assistant")])
    answer = F.least(s["assistant"], _with(s["user"], 5, "I"), *[_with(s[x], 10, "II") for x in ("start", "system")])
    return F.struct(s["start"].alias("start"), s["system"].alias("system"), user.alias("user"), answer.alias("assistant"))


def _turned(s: Column, t: Column) -> Column:
    """The four states after one turn: deleted, kept or given the role that is due, and insertions behind it."""
    never = lambda ok, x: F.when(ok, x).otherwise(F.struct(F.lit(NEVER).cast("bigint").alias("cost"), F.lit("").alias("audit")))
    stays, ended = ~t["must"], F.when(t["cut"], 5).otherwise(0)
    keep = lambda role, x: never(stays & (t["initial"] == role), _with(s[x], ended, "K"))
    rerole = lambda x: never(stays, _with(s[x], ended + 1, "R"))
    gone = {x: _with(s[x], 2, "D") for x in STATES}
    due = ("start", "system", "assistant")
    return _inserted({
        "start": gone["start"],
        "system": F.least(gone["system"], keep("s", "start")),
        "user": F.least(gone["user"], *[keep("u", x) for x in due], *[rerole(x) for x in due]),
        "assistant": F.least(gone["assistant"], keep("a", "user"), rerole("user")),
    })


def _only(state: str) -> Column:
    """The fold's start in one state."""
    return F.struct(*[F.struct(F.lit(0 if x == state else NEVER).cast("bigint").alias("cost"), F.lit("").alias("audit")).alias(x) for x in STATES])


def audits(flags: DataFrame) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of flagged()."""
    counted = [F.count_if(F.col("fault") == x).alias(x) for x in ("blank", "duplicate", "truncated")]
    turn = F.struct("pos", "initial", F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("cut"))
    chunks = flags.withColumn("chunk", F.floor((F.col("pos") - 1) / CHUNK)).groupBy("key", "chunk").agg(*counted, F.count_if("illegal").alias("illegal"), F.count_if("fresh").alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.sort_array(F.collect_list(turn)).alias("list"))
    folded = F.transform(F.array(*[_only(x) for x in STATES]), lambda first: F.aggregate(F.col("list"), _inserted({x: first[x] for x in STATES}), _turned))
    chunks = chunks.withColumn("ways", folded)
    added = [F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "turns")]
    whole = chunks.groupBy("key").agg(*added, F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list(F.struct("chunk", "ways"))).alias("chunks"))

    def through(s: Column, c: Column) -> Column:
        joined = lambda x, y, i: F.struct((s[x]["cost"] + c["ways"][i][y]["cost"]).alias("cost"), F.concat(s[x]["audit"], c["ways"][i][y]["audit"]).alias("audit"))
        return F.struct(*[F.least(*[joined(x, y, i) for i, x in enumerate(STATES)]).alias(y) for y in STATES])

    total = F.aggregate("chunks", _only("start"), through, lambda s: F.least(s["start"], s["assistant"]))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint")
    return whole.withColumn("best", total).select("key", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """key, pos, lines: what becomes of every row of placed() by the audits of `found`, inserted turns before it included;
    those behind the last row have a pos of their own. Deleted rows have no lines."""
    edits = F.concat(F.regexp_extract_all("audit", F.lit("I*[DKR]"), F.lit(0)), F.array(F.regexp_extract("audit", "I*$", 0)))
    steps = found.select("key", F.posexplode(edits).alias("at", "edit")).select("key", (F.col("at") + 1).cast("bigint").alias("pos"), "edit")
    written = F.length("edit") - F.when(F.col("edit").endswith("D"), 1).otherwise(0)
    # The last turn written is the assistant's, so a turn's role is told by how many follow.
    behind = F.coalesce(F.sum(written).over(Window.partitionBy("key").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    steps = steps.withColumns({"behind": behind, "own": written})
    role = lambda after: F.when(after % 2 == 0, "assistant").otherwise("user")
    inserts = F.length(F.regexp_extract("edit", "^I*", 0))
    new = F.when(inserts > 0, F.transform(F.sequence(F.lit(1), inserts), lambda i: F.concat(role(F.col("behind") + F.col("own") - i), F.lit(":"))))
    kept = F.when(F.col("edit").endswith("K"), F.concat("role", F.lit(":"), "text")).when(F.col("edit").endswith("R"), F.concat(role(F.col("behind")), F.lit(":"), "text"))
    joined = steps.join(rows.select("key", "pos", "role", "text"), ["key", "pos"], "left")
    return joined.select("key", "pos", F.array_compact(F.concat(F.coalesce(new, F.array().cast("array<string>")), F.array(kept))).alias("lines"))


def hashed(lines: DataFrame) -> DataFrame:
    """key, repaired_sha256: of the lines of a conversation by pos, joined by newlines. They stream through the hash in
    order, so a conversation of any length takes the memory of one batch."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, first = None, None, True
        for b in batches:
            keys, values = [], []
            for k, some in zip(b.column("key").to_pylist(), b.column("lines").to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        values.append(state.hexdigest())
                    key, state, first = k, sha256(), True
                for line in some:
                    state.update(line.encode() if first else b"\n" + line.encode())
                    first = False
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], ["key", "repaired_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([state.hexdigest()], pa.string())], ["key", "repaired_sha256"])

    return lines.repartition("key").sortWithinPartitions("key", "pos").select("key", "lines").mapInArrow(digest, "key string, repaired_sha256 string")


def repair_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id of `rows` (conv_id,
    turn, role, text), after the damage of damaged().

    Null ids are one conversation; null turns come first; rows of equal turn are ordered by role and text, so fully
    equal ones are neighbours and all but the first are duplicates. An empty table gives an empty result; other
    columns of `rows` are ignored. No row left after damage: zeros, an empty audit, the hash of nothing."""
    turns = placed(damaged(rows))
    found = audits(flagged(turns))
    ids = rows.select(conversation_key(F.col("conv_id")).alias("key"), "conv_id").distinct()
    out = ids.join(found, "key", "left").join(hashed(repaired(turns, found)), "key", "left")
    zero = [F.coalesce(x, F.lit(0)).cast("bigint").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def _sql_step() -> str:
    """One turn's step over the columns c0..c3, a0..a3 of the four states, written as a list of (cost, audit) to take the least of."""
    pair = lambda i, cost, edit: f"struct_pack(c := c{i} + {cost}, a := a{i} || '{edit}')"
    ways = {0: [pair(0, 2, "D")], 1: [pair(1, 2, "D"), f"CASE WHEN ok AND initial = 's' THEN {pair(0, 'more', 'K')} END"], 2: [pair(2, 2, "D")], 3: [pair(3, 2, "D")]}
    for to, role, sources in ((2, "u", (0, 1, 3)), (3, "a", (2,))):
        for i in sources:
            ways[to] += [f"CASE WHEN ok AND initial = '{role}' THEN {pair(i, 'more', 'K')} END", f"CASE WHEN ok THEN {pair(i, 'more + 1', 'R')} END"]
    return ", ".join(f"list_min(list_filter([{', '.join(w)}], lambda x: x IS NOT NULL)) AS s{i}" for i, w in ways.items())


_AFTER = """list_min([s2, struct_pack(c := s0.c + 5, a := s0.a || 'I'), struct_pack(c := s1.c + 5, a := s1.a || 'I'), struct_pack(c := s3.c + 5, a := s3.a || 'I')]) AS t2,
    list_min([s3, struct_pack(c := s2.c + 5, a := s2.a || 'I'), struct_pack(c := s0.c + 10, a := s0.a || 'II'), struct_pack(c := s1.c + 10, a := s1.a || 'II')]) AS t3"""

ORACLE = f"""
WITH RECURSIVE poly AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) AS s(i))
), hashed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 AS h
    FROM (SELECT *, hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x FROM conversations), poly
), damaged AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
    FROM hashed WHERE h != 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos FROM damaged
), seen AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, substr(role, 1, 1) AS initial,
        lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed
), flagged AS (
    SELECT *, CASE WHEN regexp_matches(text, '{WORDLESS}') THEN 'blank' WHEN again THEN 'duplicate' WHEN regexp_matches(text, '{UNENDED}') THEN 'truncated' ELSE '' END AS fault FROM seen
), turns AS (
    SELECT conv_id, pos, initial, fault NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more, role, text FROM flagged
), folds(conv_id, pos, c0, a0, c1, a1, c2, a2, c3, a3) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, '', {NEVER}::BIGINT, '', 5::BIGINT, 'I', 10::BIGINT, 'II' FROM turns
    UNION ALL
    SELECT conv_id, pos, s0.c, s0.a, s1.c, s1.a, t2.c, t2.a, t3.c, t3.a FROM (
        SELECT *, {_AFTER} FROM (
            SELECT f.conv_id, t.pos, {_sql_step()} FROM folds f JOIN turns t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.pos = f.pos + 1))
), best AS (
    SELECT conv_id, b.c AS cost, b.a AS audit FROM (
        SELECT conv_id, pos, list_min([struct_pack(c := c0, a := a0), struct_pack(c := c3, a := a3)]) AS b, max(pos) OVER (PARTITION BY conv_id) AS top FROM folds) WHERE pos = top
), edits AS (
    SELECT conv_id, unnest(list_append(regexp_extract_all(audit, 'I*[DKR]'), regexp_extract(audit, 'I*$'))) AS edit, generate_subscripts(list_append(regexp_extract_all(audit, 'I*[DKR]'), ''), 1) AS pos FROM best
), behind AS (
    SELECT *, length(edit) - edit.ends_with('D')::INT AS own, coalesce(sum(length(edit) - edit.ends_with('D')::INT) OVER (PARTITION BY conv_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS after FROM edits
), lines AS (
    SELECT b.conv_id, b.pos, list_filter(list_append(list_transform(range(length(regexp_extract(edit, '^I*'))), lambda i: CASE WHEN (after + own - i - 1) % 2 = 0 THEN 'assistant:' ELSE 'user:' END),
        CASE WHEN edit.ends_with('K') THEN role || ':' || text WHEN edit.ends_with('R') THEN CASE WHEN after % 2 = 0 THEN 'assistant:' ELSE 'user:' END || text END), lambda x: x IS NOT NULL) AS parts
    FROM behind b LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.pos = b.pos
), texts AS (
    SELECT conv_id, sha256(coalesce(string_agg(array_to_string(parts, chr(10)), chr(10) ORDER BY pos) FILTER (WHERE len(parts) > 0), '')) AS repaired_sha256 FROM lines GROUP BY conv_id
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
        count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM flagged GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM i.conv_id
"""
