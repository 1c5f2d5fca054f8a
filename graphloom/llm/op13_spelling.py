"""Spelling variants: words at edit distance one, by a self-join of a vocabulary trie with active-node sets.

The trie is split by what two near words share. Of a pair whose shorter word has n code points, let e be the place
of the first difference. It lies in one window [a, z) of places, and then both words share the first a code points
and the last n - z. So a word goes, for every window of its length, into the subtrie under that head and tail, and
a pair meets in exactly one subtrie. Where a subtrie holds more than `most` words, its window is halved, until it is
one place wide and holds no more words than the alphabet allows. A task walks a subtrie from the root and carries
the set of nodes at distance 0 or 1 from the node it is at; terminal pairs at distance one come out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower, cut, table, text_or_empty

LETTERS, LEAST, DAMAGE = "[A-Za-zÀ-ÿ]+", 7, 31
PLACE = ["n_short", "a", "z", "head", "tail"]


def vocabulary(docs: DataFrame, least: int = LEAST, twice: int = 2, damage: int = DAMAGE) -> DataFrame:
    """word, n: words of at least `least` code points and `twice` occurrences in all texts.

    A word is a maximal run of letters, A-Z lower-cased; where `damage` divides the CRC of `<doc_id>:<run>`, the code
    point at CRC mod length is missing. Null texts have no words; a null doc_id counts as the empty string."""
    runs = F.filter(F.regexp_extract_all(text_or_empty(), F.lit(LETTERS), F.lit(0)), lambda w: F.length(w) >= least)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id__"), F.explode(runs).alias("run__")).select("id__", ascii_lower(F.col("run__")).alias("run__"))
    h = F.crc32(F.concat("id__", F.lit(":"), "run__").cast("binary"))
    at = (F.col("h__") % F.length("run__")).cast("int")
    cut_out = F.concat(F.substring("run__", F.lit(1), at), F.substring("run__", at + 2, F.length("run__")))
    words = rows.withColumn("h__", h).select(F.when(F.col("h__") % damage == 0, cut_out).otherwise(F.col("run__")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= twice)


def _placed(rows: DataFrame, windows: Column) -> DataFrame:
    """`rows` (word, n, n_short) once for every window (a, z), with the head and the tail that the words of its subtrie share."""
    at = rows.select("word", "n", "n_short", F.explode(windows).alias("w")).select("word", "n", "n_short", "w.a", "w.z")
    size = F.greatest(F.col("n_short") - F.col("z"), F.lit(0))
    return at.withColumns({"head": F.substring("word", F.lit(1), F.col("a")), "tail": F.substring("word", F.length("word") - size + 1, size)})


def _window(a: Column, z: Column) -> Column:
    return F.struct(a.cast("int").alias("a"), z.cast("int").alias("z"))


def subtries(words: DataFrame, least: int = LEAST, most: int = 4096) -> DataFrame:
    """n_short, a, z, head, tail, words (word, n): every subtrie that holds two words or more."""
    half = F.floor(F.col("n_short") / 2)
    lengths = F.array(F.length("word"), F.length("word") - 1)
    rows = words.select("word", "n", F.explode(F.filter(lengths, lambda x: x >= least)).alias("n_short"))
    placed, done = _placed(rows, F.array(_window(F.lit(0), half), _window(half, F.col("n_short") + 1))), None
    held: list[DataFrame] = []
    while True:
        large = placed.groupBy(*PLACE).count().where((F.col("count") > most) & (F.col("z") - F.col("a") > 1)).drop("count")
        large = cut(large)
        held.append(large)
        if large.isEmpty():
            break
        rest = placed.join(large, PLACE, "left_anti")
        done = rest if done is None else done.unionByName(rest)
        middle = F.floor((F.col("a") + F.col("z")) / 2)
        deeper = placed.join(large, PLACE, "left_semi").withColumn("windows", F.array(_window(F.col("a"), middle), _window(middle, F.col("z"))))
        placed = cut(_placed(deeper.select("word", "n", "n_short", "windows"), F.col("windows")))
        held.append(placed)
    every = placed if done is None else done.unionByName(placed)
    out = every.groupBy(*PLACE).agg(F.collect_list(F.struct("word", "n")).alias("words")).where(F.size("words") > 1)
    out.scratch = held
    return out


def near_in_subtrie(middles: list[str], short: int, open_end: bool) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) of places in `middles`, distinct words of `short` code points or one more, where j is i with one code
    point replaced (i < j) or inserted; not behind i's end unless `open_end`, since that place is in the next window."""
    children: list[dict[str, int]] = [{}]
    ends: list[int] = [-1]
    for i, word in enumerate(middles):
        node = 0
        for c in word:
            after = children[node].get(c)
            if after is None:
                after = children[node][c] = len(children)
                children.append({})
                ends.append(-1)
            node = after
        ends[node] = i
    # Of a node's active set: the node itself is at distance 0; `replaced` and `inserted` are at distance 1.
    stack: list[tuple[int, int, list[int], list[int]]] = [(0, 0, [], list(children[0].values()) if short or open_end else [])]
    while stack:
        node, depth, replaced, inserted = stack.pop()
        if depth == short:
            i = ends[node]
            if i >= 0:
                for v in replaced:
                    if ends[v] > i:
                        yield i, ends[v]
                for v in inserted:
                    if ends[v] >= 0:
                        yield i, ends[v]
            continue
        own = children[node]
        for c, after in own.items():
            swapped = [w for v in replaced if (w := children[v].get(c)) is not None]
            swapped += [v for x, v in own.items() if x != c]
            # An insertion in front of an equal code point is the same word as one behind it.
            added = {w for v in inserted if (w := children[v].get(c)) is not None}
            if depth + 1 < short or open_end:
                added.update(children[after].values())
            elif added:
                added.difference_update(children[after].values())
            stack.append((after, depth + 1, swapped, list(added)))


def near_words(groups: DataFrame) -> DataFrame:
    """word, n_near, best (minus n, word): what each subtrie adds to a word, from the rows of subtries()."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            held = b.column("words")
            flat, bounds = held.flatten(), held.offsets.to_pylist()
            words, ns = flat.field("word").to_pylist(), flat.field("n").to_pylist()
            place = zip(b.column("n_short").to_pylist(), b.column("a").to_pylist(), b.column("z").to_pylist(), strict=True)
            for g, (n, a, z) in enumerate(place):
                start, end = bounds[g] - bounds[0], bounds[g + 1] - bounds[0]
                tail = max(n - z, 0)
                some = [w[a : len(w) - tail] for w in words[start:end]]
                found: dict[int, list] = {}
                for i, j in near_in_subtrie(some, min(z, n) - a, z > n):
                    for x, y in ((start + i, start + j), (start + j, start + i)):
                        best = (-ns[y], words[y])
                        had = found.get(x)
                        if had is None:
                            found[x] = [1, best]
                        else:
                            had[0] += 1
                            had[1] = min(had[1], best)
                for x, (count, best) in found.items():
                    for column, value in zip(out, (words[x], count, *best), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.string())], ["word", "n_near", "best_n", "best"])

    found = groups.select("n_short", "a", "z", "words").mapInArrow(walk, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("best_n", "best")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, root: where `links` (word, form) end. Every round doubles the steps, and a form has at least ten times its
    word's n, so there are few."""
    hops = cut(links.select("word", F.col("form").alias("root")))
    while True:
        further = hops.join(hops.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        moved = cut(further.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), hops)
        hops = moved
        if moved.where("moved").isEmpty():
            return hops
        hops = moved.select("word", "root")
        hops.scratch_path = moved.scratch_path


def spelling_variants(docs: DataFrame, least: int = LEAST, times: int = 10, most: int = 4096) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of vocabulary().

    A word's form is its near word of largest n, the least in code-point order of equals, if that has `times` its n;
    root follows forms to their end and is the word itself without one. Empty tables, null and letterless texts have
    no words; repeated rows count as often as they stand; columns beside doc_id and text are ignored. `most` only
    bounds the work of a task, never the result."""
    words = cut(vocabulary(docs, least))
    groups = subtries(words, least, most)
    near = near_words(groups)
    right = F.when(-F.col("best.best_n") >= times * F.col("n"), F.col("best.best"))
    formed = words.join(near, "word", "left").select("word", right.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(right.isNotNull(), -F.col("best.best_n")).alias("form_n"))
    formed = cut(formed, words, *groups.scratch)
    ends = roots(formed.where("form IS NOT NULL"))
    return formed.join(ends.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


#: Near pairs meet by the word without one code point, or with one masked; each pair is then counted once.
ORACLE = f"""
WITH poly AS (
    SELECT list(c ORDER BY i) AS t FROM (
        SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) AS s(i))
), runs AS (
    SELECT id, run, count(*) AS k FROM (
        SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '{LETTERS}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
    WHERE length(run) >= {LEAST} GROUP BY ALL
), hashed AS (
    SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
    FROM (SELECT *, hex(encode(id || ':' || run)) AS x FROM runs), poly
), words AS (
    SELECT word, sum(k)::BIGINT AS n FROM (
        SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM hashed)
    WHERE length(word) >= {LEAST} GROUP BY word HAVING sum(k) >= 2
), keys AS (
    SELECT DISTINCT word, n, kind, key FROM (
        SELECT word, n, 'whole' AS kind, word AS key FROM words
        UNION ALL SELECT word, n, 'less', substr(word, 1, i::INT) || substr(word, i::INT + 2) FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
        UNION ALL SELECT word, n, 'mask', substr(word, 1, i::INT) || '_' || substr(word, i::INT + 2) FROM (SELECT *, unnest(range(length(word))) AS i FROM words))
), near AS (
    SELECT DISTINCT a.word, b.word AS other, b.n FROM keys a JOIN keys b USING (key)
    WHERE a.word != b.word AND ((a.kind = 'mask' AND b.kind = 'mask') OR (a.kind = 'whole' AND b.kind = 'less') OR (a.kind = 'less' AND b.kind = 'whole'))
), best AS (
    SELECT word, count(*) AS n_near, arg_min(other, struct_pack(k := -n, o := other)) AS form, max(n) AS form_n FROM near GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)
), steps AS (
    WITH RECURSIVE s(word, place, k) AS (
        SELECT word, word, 0 FROM formed UNION ALL SELECT s.word, f.form, k + 1 FROM s JOIN formed f ON f.word = s.place WHERE f.form IS NOT NULL)
    SELECT word, arg_max(place, k) AS root FROM s GROUP BY word
)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM formed JOIN steps USING (word)
"""


def brute_force(texts: list[tuple[int | None, str | None]], least: int = LEAST, times: int = 10, damage: int = DAMAGE) -> dict[str, tuple]:
    """What spelling_variants() returns, by comparing every word with every other; word -> (form, root, n, n_near, form_n)."""
    import re
    import zlib

    n: dict[str, int] = {}
    for doc_id, text in texts:
        for run in re.findall(LETTERS, text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % damage == 0:
                at = h % len(low)
                low = low[:at] + low[at + 1 :]
            n[low] = n.get(low, 0) + 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= 2}

    def near(s: str, t: str) -> bool:
        if len(s) == len(t):
            return sum(x != y for x, y in zip(s, t, strict=True)) == 1
        s, t = sorted((s, t), key=len)
        return len(t) == len(s) + 1 and any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    out, form = {}, {}
    for w in n:
        around = [v for v in n if v != w and near(w, v)]
        best = min(around, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= times * n[w] else None
        out[w] = len(around)
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], out[w], n[form[w]] if form[w] is not None else None)
    return out
