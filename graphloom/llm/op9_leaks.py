"""Benchmark decontamination over item-sized windows, with SimHash distances, in DataFrame expressions only.

Words are runs of letters and digits, lower-cased. A window has as many words as an item. A window reaches the
threshold only if it shares so many shingles with the item, so every start whose window holds that many
places of the item's shingles is tried, and no other one can be a leak. Each such pair of window and item is
verified by the exact similarity of their shingle multisets; a 64-bit SimHash of both tells how near their
fingerprints are, but decides nothing, so that no leak is lost to a radius.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, fresh_name, table, text_or_empty

SHINGLE, THRESHOLD = 5, 0.8
#: Shingles of a benchmark that a task looks up in a set; beyond it they are joined by shuffle.
MOST_IN_SET = 50_000
#: Rows of the benchmark's shingles that may be broadcast.
MOST_BROADCAST = 1_000_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")


def shingle_hashes(words: str, k: int) -> Column:
    """Hash of every `k` successive words of the array column `words`, in order; empty with fewer words."""
    hashes = f"transform({words}, w -> xxhash64(w))"
    parts = ", ".join(f"h[i + {j}]" if j else "h[i]" for j in range(k))
    return F.expr(f"flatten(transform(array({hashes}), h -> if(size(h) >= {k}, transform(sequence(0, greatest(size(h) - {k}, 0)), i -> xxhash64({parts})), cast(array() as array<bigint>))))")


def simhash(hashes: str) -> Column:
    """64 bits, each the majority of that bit over the array column `hashes`, repeats included."""
    votes = f"aggregate({hashes}, 0, (s, x) -> s + if((shiftright(x, b) & 1L) = 1L, 1, -1))"
    return F.expr(f"aggregate(sequence(0, 63), 0L, (a, b) -> a | if({votes} > 0, shiftleft(1L, b), 0L))")


def similarity(a: str, b: str) -> Column:
    """Jaccard of two multisets (array columns): shared repeats over all repeats."""
    plain = f"size(array_distinct({a})) = size({a}) AND size(array_distinct({b})) = size({b})"
    repeats = f"aggregate(array_distinct({a}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    shared = f"if({plain}, size(array_intersect({a}, {b})), {repeats})"
    return F.expr(f"(1D * {shared}) / (size({a}) + size({b}) - {shared})")


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (a number), item_id, n (words), k (words of a shingle: SHINGLE, or all of a shorter item), hashes, print;
    items without words go."""
    worded = benchmark.select("item_id", words_of(text_or_empty()).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    hashes = F.when(F.col("n") >= SHINGLE, shingle_hashes("words", SHINGLE))
    for k in range(1, SHINGLE):
        hashes = hashes.when(F.col("n") == k, shingle_hashes("words", k))
    hashed = worded.select("item_id", "n", F.least("n", F.lit(SHINGLE)).alias("k"), hashes.alias("hashes"))
    return hashed.withColumns({"print": simhash("hashes"), "item": F.monotonically_increasing_id()})


def anchored(docs: DataFrame, shingles: DataFrame) -> DataFrame:
    """doc_id, text, anchors of the rows with a shingle of the benchmark; anchors: array of (k, pos, shingle).

    A benchmark of bounded size is a literal set, so whole texts are read once and not shuffled."""
    known = [(r.k, r.shingle) for r in shingles.limit(MOST_IN_SET + 1).collect()]
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    if not known:
        return rows.where("false").withColumn("anchors", F.expr("cast(array() as array<struct<k:int,pos:int,shingle:bigint>>)"))
    sizes = sorted({k for k, _ in known})
    numbered = rows.withColumn("words", words_of(F.col("text")))
    lists = [F.transform(shingle_hashes("words", k), _numbered(k)) for k in sizes]
    if len(known) <= MOST_IN_SET:
        within = [F.filter(a, _in_set([s for size, s in known if size == k])) for a, k in zip(lists, sizes, strict=True)]
        return numbered.select("doc_id", "text", F.concat(*within).alias("anchors")).where(F.size("anchors") > 0)
    keyed = numbered.withColumn("text_key", F.md5("text"))
    all_anchors = keyed.select("text_key", F.explode(F.concat(*lists)).alias("a")).select("text_key", "a.*")
    hit = all_anchors.join(shingles, ["k", "shingle"], "left_semi").distinct()
    per_text = hit.groupBy("text_key").agg(F.collect_list(F.struct("k", "pos", "shingle")).alias("anchors"))
    return keyed.join(per_text, "text_key").select("doc_id", "text", "anchors")


def _numbered(k: int):
    return lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("pos"), h.alias("shingle"))


def _in_set(values: list[int]):
    return lambda a: a["shingle"].isin(*values) if len(values) > 1 else a["shingle"] == values[0]


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, start (word of the best window), similarity, hamming for every leak: a row of `docs`
    with a window whose shingles are similar to an item's by `threshold`.

    A null or empty text, and an item without words, leak nothing. A text shorter than an item is one window.
    Repeated rows each have their leaks; equal items each match. Of equally similar windows the first counts.
    Empty tables give an empty result; other columns are ignored. Copies of a text are judged once."""
    return leaks_and_tables(docs, benchmark, threshold)[0]


def leaks_and_tables(docs: DataFrame, benchmark: DataFrame, threshold: float) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """find_leaks(), and the tables that are to be dropped when its result has been read."""
    items = cut(items_of(benchmark))
    places = items.select("item", "n", "k", F.explode("hashes").alias("shingle")).distinct()
    found = cut(anchored(docs, places.select("k", "shingle").distinct()).withColumn("text_key", F.md5("text")))
    small = places.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    held = F.broadcast if small else lambda df: df

    texts = found.select("text_key", "text").dropDuplicates(["text_key"])
    anchors = found.select("text_key", "anchors").dropDuplicates(["text_key"]).select("text_key", F.explode("anchors").alias("a")).select("text_key", "a.*")
    met = anchors.join(held(places), ["k", "shingle"]).groupBy("text_key", "item", "n", "k").agg(F.sort_array(F.collect_set("pos")).alias("at"))  # bounded by the text's own length
    met = met.where(F.size("at") >= threshold * (F.col("n") - F.col("k") + 1) - 1e-9)
    tried = met.join(texts, "text_key").withColumn("words", words_of(F.col("text"))).withColumn("starts", starts(threshold)).where(F.size("starts") > 0)
    windows = tried.select("text_key", "item", "k", "n", "words", F.explode("starts").alias("start")).withColumn("part", F.expr("slice(words, start + 1, n)"))
    hashes = F.coalesce(*[F.when(F.col("k") == k, shingle_hashes("part", k)) for k in range(1, SHINGLE + 1)])
    pairs = windows.select("text_key", "item", "start", hashes.alias("hashes")).join(held(items.select("item", "item_id", F.col("hashes").alias("item_hashes"), F.col("print").alias("item_print"))), "item")
    similar = pairs.withColumn("similarity", similarity("hashes", "item_hashes")).where(F.col("similarity") >= threshold)
    best = similar.groupBy("text_key", "item_id").agg(F.max_by(F.struct("similarity", "start", "hashes", "item_print"), F.struct("similarity", -F.col("start"))).alias("m")).select("text_key", "item_id", "m.*")
    printed = best.withColumn("hamming", F.bit_count(simhash("hashes").bitwiseXOR(F.col("item_print"))))
    return found.select("doc_id", "text_key").join(printed, "text_key").select("doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"), "hamming"), (items, found)


def starts(threshold: float) -> Column:
    """All starts whose window holds enough places of `at` (sorted) to be similar by `threshold`, of the columns
    n, k, words and at. Of windows with w shingles and items with m, that is threshold * (w + m) / (1 + threshold)."""
    w = "least(n - k + 1, size(words) - k + 1)"
    need = f"greatest(1, CAST(ceil({threshold}D * ({w} + n - k + 1) / (1 + {threshold}D) - 1e-9D) AS INT))"
    first, last = f"greatest(0, at[j + {need} - 1] - ({w} - 1))", "least(at[j], greatest(0, size(words) - n))"
    ranges = f"transform(sequence(0, size(at) - {need}), j -> if({first} <= {last}, sequence({first}, {last}), cast(array() AS array<int>)))"
    return F.expr(f"if(size(at) >= {need}, array_distinct(flatten({ranges})), cast(array() AS array<int>))")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of `docs` whose text holds no item of the benchmark; all columns stay.

    Texts are told by their hash, so that repeated and null ids do no harm. The list of leaking texts is
    distinct; AQE broadcasts it where it is small."""
    key = fresh_name(docs, "leak_key")
    bare = docs.select(F.md5(text_or_empty()).alias("doc_id"), "text")
    leaks, gone = leaks_and_tables(bare, benchmark, threshold)
    leaking = cut(leaks.select(F.col("doc_id").alias(key)).distinct(), *gone)
    return docs.withColumn(key, F.md5(text_or_empty())).join(leaking, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hamming")


ORACLE = rf"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM documents
), iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark
), ds AS (SELECT r, doc_id, i AS pos, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS s, len(w) AS m FROM (SELECT *, unnest(range(greatest(0, len(w) - {SHINGLE - 1}))) AS i FROM dw)
), its AS (SELECT item_id, len(w) AS n, i AS item_pos, array_to_string(w[i + 1 : i + {SHINGLE}], ' ') AS s FROM (SELECT *, unnest(range(greatest(0, len(w) - {SHINGLE - 1}))) AS i FROM iw)
), starts AS (SELECT DISTINCT r, n, unnest(range(greatest(0, least(pos + {SHINGLE} - n, m - n)), greatest(0, least(pos, m - n)) + 1)) AS start FROM ds JOIN (SELECT DISTINCT n, s FROM its) USING (s)
), windows AS (SELECT r, n, start, s, count(*) AS c FROM starts JOIN ds USING (r) WHERE pos >= start AND pos <= start + n - {SHINGLE} GROUP BY ALL
), wsize AS (SELECT r, n, start, sum(c) AS size FROM windows GROUP BY ALL
), ic AS (SELECT item_id, n, s, count(*) AS c FROM its GROUP BY ALL
), shared AS (SELECT r, n, start, item_id, sum(least(windows.c, ic.c)) AS both_ FROM windows JOIN ic USING (n, s) GROUP BY ALL
), scored AS (SELECT r, item_id, start, both_ / (size + n - {SHINGLE - 1} - both_) AS similarity FROM shared JOIN wsize USING (r, n, start))
SELECT doc_id, item_id, arg_max(start, (similarity, -start))::INTEGER AS start, round(max(similarity), 6) AS similarity
FROM scored JOIN dw USING (r) WHERE similarity >= {THRESHOLD} GROUP BY r, doc_id, item_id
"""
