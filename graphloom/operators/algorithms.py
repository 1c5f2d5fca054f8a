"""Loops over a graph's edges: components, nodes on cycles, PageRank; and cycles found depth first."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.catalog import USER_FACING_TYPES
from graphloom.operators.build import intact_edges
from graphloom.operators.lineage import cut, cut_fine, drop


#: Bytes of links that a task looks at together.
LINK_BYTES = 1 << 26


def leaders(links: DataFrame, salt: str) -> DataFrame:
    """id, leader: every end of `links` (a, b) and the node of least rank that a batch's links reach from it.

    A batch is what a task reads next, up to some LINK_BYTES, so nodes come as often as batches have them. A leader
    leads itself. Nodes rank by the crc32 of their id and `salt`."""
    kind, salt = links.schema["a"].dataType.simpleString(), salt.encode()

    def lead(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = pa.chunked_array([b.column(c) for c in ("a", "b") for b in held]).combine_chunks().dictionary_encode()
        at, names = ends.indices.to_numpy(), ends.dictionary
        rank = np.array([zlib.crc32(x + salt) for x in names.cast(pa.string()).cast(pa.binary()).to_pylist()])
        by = np.argsort(rank, kind="stable")
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        x, y, first = place[at[: len(at) // 2]], place[at[len(at) // 2 :]], np.arange(len(by))
        while len(x):
            np.minimum.at(first, np.maximum(x, y), np.minimum(x, y))
            while (first != (further := first[first])).any():
                first = further
            x, y = first[x], first[y]
            apart = x != y
            x, y = x[apart], y[apart]
        of = by[first]
        return pa.RecordBatch.from_arrays([names.take(pa.array(by)), names.take(pa.array(of))], ["id", "leader"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= LINK_BYTES:
                yield lead(held)
                held, size = [], 0
        if held:
            yield lead(held)

    return links.mapInArrow(work, f"id {kind}, leader {kind}")


def merged_labels(edges: DataFrame) -> DataFrame:
    """id, label of every end of an edge between two nodes: nodes have the same label if edges join them.

    Each round merges every node into the least of its leaders, and goes on with the links of what is left: those
    between the nodes that its leaders were merged into. Ranks are dealt anew each round, so that chains too are halved
    on average; and as a task first joins what its own links join, a round moves at most one row per node and batch."""
    links, levels, met = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a != b"), [], []
    while True:
        salt = "." * len(levels)  # each length gives another order
        ranked = F.transform(F.collect_set("leader"), lambda x: F.struct(F.crc32(F.concat(x.cast("string"), F.lit(salt))), x.alias("id")))
        led = leaders(links, salt).repartition("id").groupBy("id").agg(F.array_sort(ranked)["id"].alias("leaders"))
        levels.append(cut(led, *met, fine=True))
        if levels[-1].isEmpty():
            break
        label = F.col("leaders")[0]
        met = [cut(levels[-1].select(label.alias("a"), F.explode("leaders").alias("leader")).distinct(), fine=True)]
        moved = levels[-1].where(F.array_contains("leaders", F.col("id"))).select(F.col("id").alias("leader"), label.alias("b"))
        links = met[0].join(moved, "leader").select("a", "b").where("a != b")
    last = levels.pop()
    labels = cut(last.select("id", F.col("leaders")[0].alias("label")), last)
    for level in reversed(levels):
        further = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        own = level.select("id", F.col("leaders")[0].alias("label"))
        labels = cut(own.join(further, "label", "left").select("id", F.coalesce("further", "label").alias("label")), labels, level, fine=True)
    return labels


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the least id that edges reach in any direction. Edges of unknown nodes don't count; edges may repeat."""
    known = nodes.select("id", F.lit(True).alias("known"))
    labels = merged_labels(edges)
    found = cut(known.join(labels, "id", "full"), labels, fine=True)
    unknown = found.where("known IS NULL").select("id")
    if not unknown.isEmpty():
        # Labels may go through unknown nodes, so they are worked out again without them.
        for end in ("source", "target"):
            edges = edges.join(unknown.withColumnRenamed("id", end), end, "left_anti")
        labels = merged_labels(edges)
        found = cut(known.join(labels, "id", "left"), labels, found, fine=True)
    least = cut(found.where("label IS NOT NULL").groupBy("label").agg(F.min("id").alias("component")), fine=True)
    alone = found.where("label IS NULL").select("id", F.col("id").alias("component"))
    return alone.union(found.join(least, "label").select("id", "component"))


def chain_tops(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, top) of every node with exactly one link in: the first node above it along such links that has none or
    several; and (id) of the nodes on rings of such links, which have no top.

    Pointers double each round, so a chain or ring of n nodes takes about log n rounds."""
    ups = cut(links.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"), F.min("source").alias("top")).where("n = 1").select("id", "top"))
    steps = max(1, ups.count())
    single, span = ups, 1
    while span < steps:
        moved = cut(ups.join(ups.select(F.col("id").alias("top"), F.col("top").alias("further")), "top", "left").select("id", F.coalesce("further", "top").alias("top"), F.col("further").isNotNull().alias("moved")))
        drop(*[ups] if ups is not single else [])
        ups, span = moved, 2 * span
        if moved.where("moved").isEmpty():
            break
    # Where a pointer still ends on a node of a single link, it has gone around a ring, of which it ends on every node.
    ringed = cut(ups.select(F.col("top").alias("id")).join(single.select("id"), "id", "left_semi").distinct())
    tops = cut(ups.select("id", "top").join(single.select(F.col("id").alias("top")), "top", "left_anti").select("id", "top"))
    drop(single, *[ups] if ups is not single else [])
    return tops, ringed


def without_fronts(links: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`links` without those of nodes that no cycle leads to, and `found` (id) with the nodes of plain rings, whose links go.

    Chains below a node without a link in go at once; what they leave may have one link in or none, and goes next."""
    n = links.count()
    while n:
        tops, ringed = chain_tops(links)
        heads = links.select(F.col("source").alias("id")).distinct().join(links.select(F.col("target").alias("id")).distinct(), "id", "left_anti")
        below = tops.join(heads.withColumnRenamed("id", "top"), "top", "left_semi").select("id")
        # Nothing outside leads into a plain ring, so its nodes are on no other cycle.
        gone = cut(heads.union(below).union(ringed))
        found = cut(found.union(ringed), found)
        links = cut(links.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").select("source", "target"), links)
        drop(tops, ringed, gone)
        m = links.count()
        if m == n:
            break
        n = m
    return links, found


def trimmed(links: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`links` (a table) between nodes that cycles lead to and that lead to cycles, and `found` with the nodes of plain
    rings, forwards or backwards."""
    turned = lambda df: df.select(F.col("target").alias("source"), F.col("source").alias("target"))
    rest, found = without_fronts(links, found)
    back, found = without_fronts(cut(turned(rest), rest), found)
    return cut(turned(back), back), found


def spread(labels: DataFrame, links: DataFrame) -> DataFrame:
    """id, label: the largest label that reaches a node along `links`, its own included.

    A node with one link in takes the labels of the whole chain above it by doubling, so that rounds follow the number
    of forks on a way and not its length."""
    single = links.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"), F.min("source").alias("up")).where("n = 1").select("id", "up")
    chains = cut(labels.join(single, "id", "left").select("id", "label", "up"))
    steps, span = max(1, chains.where("up IS NOT NULL").count()), 1
    while span < steps:
        above = chains.select(F.col("id").alias("up"), F.col("label").alias("higher"), F.col("up").alias("further"))
        moved = cut(chains.join(above, "up", "left").select("id", F.greatest("label", "higher").alias("label"), F.col("further").alias("up")), chains)
        chains, span = moved, 2 * span
        if moved.where("up IS NOT NULL").isEmpty():
            break
    labels, span = chains.select("id", "label"), 1
    labels.scratch_path = chains.scratch_path
    while True:
        came = links.join(labels.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.max("label").alias("came"))
        moved = cut(labels.join(came, "id", "left").select("id", F.col("label").alias("old"), F.greatest("label", F.coalesce("came", "label")).alias("label")), labels)
        labels = moved.select("id", "label")
        labels.scratch_path = moved.scratch_path
        if moved.where("old != label").isEmpty():
            return labels


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """id of every node on a directed cycle, a loop included.

    After trimming, every node takes the largest id that reaches it as its colour. Going back from the node that
    a colour is named after, within the colour, gives one strongly connected part of each colour, which goes;
    until no link is left. A round holds links and one label per node, never pairs that paths join."""
    every = cut_fine(edges.select("source", "target").distinct())
    found = cut(every.where("source = target").select(F.col("source").alias("id")))
    rest, found = trimmed(cut(every.where("source != target"), every), found)
    while not rest.isEmpty():
        nodes = rest.select(F.col("source").alias("id")).distinct()
        colours = spread(nodes.select("id", F.col("id").alias("label")), rest)
        inside = rest.join(colours.toDF("source", "colour"), "source").join(colours.toDF("target", "other"), "target").where("colour = other")
        back = cut(inside.select(F.col("target").alias("source"), F.col("source").alias("target")))
        reached = spread(colours.select("id", F.when(F.col("id") == F.col("label"), 1).otherwise(0).alias("label")), back)
        part = cut(reached.where("label = 1").join(back.select(F.col("source").alias("id")).union(back.select("target")).distinct(), "id", "left_semi").select("id"))
        # Of a colour's part, a node is on a cycle if a link of its own part leads on from it.
        on = back.join(part.toDF("source"), "source", "left_semi").join(part.toDF("target"), "target", "left_semi").select(F.col("target").alias("id")).distinct()
        found = cut(found.union(on).distinct(), found)
        gone = cut(reached.where("label = 1").select("id"))
        left = cut(rest.join(gone.toDF("source"), "source", "left_anti").join(gone.toDF("target"), "target", "left_anti"), colours, back, reached, part, gone)
        drop(rest)
        rest, found = trimmed(left, found)
    return found.distinct()


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 50, damping: float = 0.85) -> DataFrame:
    """id, rank: a fixed number of rounds; the mass of nodes without an edge out is spread evenly. Edges of unknown nodes
    don't count.

    In every round each node starts with the same share `rest`, and what it got then goes on along its links. So what a
    node got by a round is a sum over walks: `reach` holds, for each length, what walks of that length bring to a node
    for a `rest` of 1. Shares sum to 1, so each round's `rest` follows from the sums of `reach`. Links of nodes that
    no link leads to only count for walks of one step, and the loop ends early where no walk is longer."""
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    links = intact_edges(nodes, edges.select("source", "target"))
    out = links.groupBy("source").agg(F.count("*").alias("out"))
    links = cut(links.join(out, "source").select("source", "target", "out"))
    reach = [cut(links.groupBy(F.col("target").alias("id")).agg(F.sum(1 / F.col("out")).alias("got")))]
    sums = [reach[0].agg(F.sum("got")).first()[0] or 0.0]
    links = cut(links.join(reach[0].select(F.col("id").alias("source")), "source", "left_semi").select("source", "target", "out"), links)
    while sums[-1] and len(reach) < rounds:
        came = links.join(reach[-1].withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id"))
        reach.append(cut(came.agg((damping * F.sum(F.col("got") / F.col("out"))).alias("got"))))
        sums.append(reach[-1].agg(F.sum("got")).first()[0] or 0.0)
    rest = [1.0 / n]
    for k in range(1, rounds + 1):
        rest.append((1.0 - damping * sum(s * rest[k - j] for j, s in enumerate(sums[:k], 1))) / n)
    parts = [r.select("id", (F.col("got") * rest[rounds - j]).alias("got")) for j, r in enumerate(reach[:rounds], 1)]
    got = reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("got").alias("got")) if parts else reach[0].limit(0)
    return cut(nodes.select("id").join(got, "id", "left").select("id", (rest[-1] + damping * F.coalesce("got", F.lit(0.0))).alias("rank")), links, *reach)


def importance(nodes: DataFrame, ranks: DataFrame, primary: DataFrame, main_file: str | None = None) -> DataFrame:
    """id, importance, tier: rank with additions for seeds, the main file and user-facing types, over its maximum."""
    main = F.col("file").endswith(main_file) if main_file else F.lit(False)
    scored = nodes.join(ranks, "id").join(primary.select("id", F.lit(0.15).alias("seed")), "id", "left")
    scored = scored.withColumn("score", F.col("rank") + F.coalesce("seed", F.lit(0.0)) + F.when(main, 0.25).otherwise(0.0) + F.when(F.col("type").isin(*USER_FACING_TYPES), 0.10).otherwise(0.0))
    most = scored.agg(F.max("score").alias("most"))
    own = F.when(F.col("most") > 0, F.col("score") / F.col("most")).otherwise(0.0)
    tier = F.when(F.col("importance") >= 0.6, "key").when(F.col("importance") >= 0.2, "standard").otherwise("supporting")
    return scored.crossJoin(F.broadcast(most)).select("id", own.alias("importance")).withColumn("tier", tier)


def search_cycles(links: list[tuple[str, str]], longest: int = 1000, roots: list[str] | None = None) -> list[list[str]]:
    """Cycles that a depth-first search closes, in the order of `links`: one per edge back to an open node, each
    set of rotations once, as found and closed. Nodes are tried as roots in the order of `roots`, or of `links`."""
    after: dict[str, list[str]] = {}
    for a, b in links:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    state, found, seen = dict.fromkeys(after, 0), [], set()
    for root in roots or after:
        if state[root]:
            continue
        path, walks, state[root] = [root], [iter(after[root])], 1
        while walks:
            node = next(walks[-1], None)
            if node is None:
                walks.pop()
                state[path.pop()] = 2
            elif state[node] == 0:
                state[node] = 1
                path.append(node)
                walks.append(iter(after[node]))
            elif state[node] == 1:
                cycle = path[path.index(node) :]
                at = cycle.index(min(cycle))
                key = tuple(cycle[at:] + cycle[:at])
                if len(cycle) <= longest and key not in seen:
                    seen.add(key)
                    found.append([*cycle, node])
    return found


def dfs_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """component, nth, path: cycles per weak component, searched in seq order.

    Edges to nodes that lead nowhere close no cycle and go first, round by round; the others keep their order, and
    nodes the place that they had among all edges. As the cycles that are told depend on that order, what is left
    of a component is searched in one task; cycle_nodes() has no such limit."""
    ends = [F.struct(F.col(x).alias("id"), "seq", F.lit(i).alias("end")) for i, x in enumerate(("source", "target"))]
    places = edges.select(F.explode(F.array(*ends)).alias("p")).groupBy(F.col("p.id").alias("source")).agg(F.min(F.struct("p.seq", "p.end")).alias("at")).select("source", F.col("at.seq").alias("at"), F.col("at.end").alias("end"))
    rest = cut(edges.select("source", "target", "seq"))
    n = rest.count()
    while True:
        rest = cut(rest.join(rest.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target", "seq"), rest)
        m = rest.count()
        if m == n:
            break
        n = m

    def find(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("seq")
        roots = list(dict.fromkeys(group.sort_values(["at", "end"])["source"]))
        paths = search_cycles(list(zip(rows["source"], rows["target"], strict=True)), roots=roots)
        found = [(rows["component"].iloc[0], i, p) for i, p in enumerate(paths)]
        return pd.DataFrame(found, columns=["component", "nth", "path"], dtype=object)

    labelled = rest.join(places, "source").join(components.withColumnRenamed("id", "source"), "source")
    return labelled.groupBy("component").applyInPandas(find, "component string, nth int, path array<string>")


def cycle_edges(cycles: DataFrame, edges: DataFrame) -> DataFrame:
    """component, nth, source, target, type: edges between successive nodes of cycles."""
    at = cycles.select("component", "nth", "path", F.explode(F.sequence(F.lit(0), F.size("path") - 2)).alias("i"))
    pairs = at.select("component", "nth", F.get("path", F.col("i")).alias("source"), F.get("path", F.col("i") + 1).alias("target"))
    return pairs.join(edges.select("source", "target", "type"), ["source", "target"]).select("component", "nth", "source", "target", "type")


def cycle_labels(cycles: DataFrame, nodes: DataFrame) -> DataFrame:
    """component, nth, text: labels along a cycle; an unknown id loses its type's prefix."""
    places = cycles.select("component", "nth", F.posexplode("path").alias("i", "id")).join(nodes.select("id", "label"), "id", "left")
    name = F.coalesce("label", F.regexp_replace("id", "^[a-z]+_", ""))
    return places.groupBy("component", "nth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", name.alias("name")))), lambda x: x["name"]), " → ").alias("text"))
