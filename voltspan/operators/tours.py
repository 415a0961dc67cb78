"""Forests by rounds that grow with the logarithm of the network: spanning trees, tours, subtree sums, bridges, chains.

A spanning forest is found by hooking: each component takes the least of its edges under an order that is drawn anew each
round, so components shrink to a third or so a round and hooks are short. A tour that crosses each tree edge twice is a linked
list; its places come from pointer doubling. Nodes are then numbered so that each subtree is a span of numbers: sums over
subtrees are differences of running sums, and the least and greatest number that a subtree's other edges reach are asked from
a tree of blocks (FAN numbers a block, blocks of blocks above), one round a level. A tree edge whose subtree reaches nothing
outside is a bridge.

No group is collected into one task: a node with many edges is a span of a range-sorted table, and what a round aggregates is
partly aggregated first. Joins on a node or label that many rows share rely on Spark's splitting of skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltspan.operators.tables import free, settle

FAN = 256
#: Edges of a chain whose sums are added up one after the other.
RUN = 4096
_LOW = (1 << 33) - 1


def numbered(df: DataFrame, *keys: Column | str) -> DataFrame:
    """df with pos: 0, 1, ... in the order of keys, by a range sort and one count a partition."""
    spark = df.sparkSession
    held = settle(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_seq", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_seq", 33)
    start, rows = 0, []
    for r in held.groupBy(part.alias("part")).count().orderBy("part").collect():
        rows.append((r["part"], start))
        start += r["count"]
    of = F.broadcast(spark.createDataFrame(rows, "_part long, _start long"))
    return held.join(of, part == F.col("_part")).withColumn("pos", F.col("_start") + F.col("_seq").bitwiseAND(F.lit(_LOW))).drop("_seq", "_part", "_start")


def running(df: DataFrame, sums: list[str]) -> DataFrame:
    """pos and the sums of doubles up to each pos, itself included; a partition hands its total to the later ones."""
    spark = df.sparkSession

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = [0.0] * len(sums)
        for b in batches:
            if b.num_rows:
                columns = [np.cumsum(np.concatenate(([c], b.column(s).to_numpy(zero_copy_only=False))))[1:] for c, s in zip(carry, sums, strict=True)]
                carry = [c[-1] for c in columns]
                yield pa.RecordBatch.from_arrays([b.column("pos"), *map(pa.array, columns)], ["pos", *sums])

    rows = df.select("pos", *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in sums]).repartitionByRange("pos").sortWithinPartitions("pos")
    held = settle(rows.mapInArrow(add, ", ".join(["pos long", *(f"{s} double" for s in sums)])).withColumn("part", F.spark_partition_id()), "running")
    total, starts = [0.0] * len(sums), []
    for r in held.groupBy("part").agg(*[F.max_by(s, "pos").alias(s) for s in sums]).orderBy("part").collect():
        starts.append((r.part, *total))
        total = [t + r[s] for t, s in zip(total, sums, strict=True)]
    of = F.broadcast(spark.createDataFrame(starts, ", ".join(["part int", *(f"_{s} double" for s in sums)])))
    return held.join(of, "part").select("pos", *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in sums])


def ranked(links: DataFrame, sums: dict[str, Column] | None = None, trace: list | None = None) -> DataFrame:
    """id, last, n and the sums over each id's list from it to the end; ids on a cycle are left out.

    links (id, nxt, and what sums names); nxt is null at the end, and no two ids share one. Pointer doubling: one round for each
    doubling of the longest list.
    """
    sums = sums or {}
    now = settle(links.select("id", "nxt", F.col("id").alias("last"), F.lit(1).cast("long").alias("n"), *[c.alias(s) for s, c in sums.items()]), "ranked")
    total, reach = now.count(), 1
    while reach <= total and not (alive := now.where("nxt is not null")).isEmpty():
        to = now.select(F.col("id").alias("nxt"), F.col("nxt").alias("_nxt"), F.col("last").alias("_last"), *[F.col(s).alias(f"_{s}") for s in ("n", *sums)])
        moved = alive.join(to, "nxt").select("id", F.col("_nxt").alias("nxt"), F.col("_last").alias("last"), *[(F.col(s) + F.col(f"_{s}")).alias(s) for s in ("n", *sums)])
        then = settle(moved.unionByName(now.where("nxt is null")), "ranked")
        free(now)
        now, reach = then, 2 * reach
        if trace is not None:
            trace.append("rank")
    return now.where("nxt is null").drop("nxt")


def forest(edges: DataFrame, trace: list | None = None) -> tuple[DataFrame, DataFrame]:
    """(tree edges u, v; node, root of each node) of edges (u, v), u < v, none twice. A root is one of its tree's nodes."""
    links = settle(edges.select(F.col("u").alias("x"), F.col("v").alias("y"), "u", "v"), "links")
    trees, maps, r = [], [], 0
    while not links.isEmpty():
        both = links.select(F.col("x").alias("c"), F.col("y").alias("o"), "u", "v").unionByName(links.select(F.col("y").alias("c"), F.col("x").alias("o"), "u", "v"))
        first = both.groupBy("c").agg(F.min(F.struct(F.xxhash64("u", "v", F.lit(r)).alias("h"), "u", "v", "o")).alias("m"))
        hooks = settle(first.select("c", "m.o", "m.u", "m.v"), "hooks")
        trees.append(hooks.select("u", "v").distinct())
        # Two components that took the same edge hook each other; the lesser one is the root.
        back = hooks.select(F.col("c").alias("o"), F.col("o").alias("_back"))
        to = hooks.join(back, "o").select("c", F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("root"))
        while True:
            # Two jumps a table.
            for _ in range(2):
                up = to.select(F.col("c").alias("root"), F.col("root").alias("_up"))
                to = to.join(up, "root").select("c", F.col("_up").alias("root"), (F.col("_up") != F.col("root")).alias("moved"))
            to = settle(to, "roots")
            if to.where("moved").isEmpty():
                break
        maps.append(to)
        end = lambda c: to.select(F.col("c").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023,E731
        left = links.join(end("x"), "x").join(end("y"), "y").where("x_root <> y_root")
        left = left.groupBy(F.least("x_root", "y_root").alias("x"), F.greatest("x_root", "y_root").alias("y")).agg(F.min(F.struct("u", "v")).alias("m"))
        then = settle(left.select("x", "y", "m.u", "m.v"), "links")
        free(links)
        links, r = then, r + 1
        if trace is not None:
            trace.append("hook")
    if not trees:
        return edges.select("u", "v"), edges.select(F.col("u").alias("node"), F.col("u").alias("root"))
    root = maps[-1].select("c", "root")
    for back, m in enumerate(reversed(maps[:-1])):
        later = root.select(F.col("c").alias("root"), F.col("root").alias("_last"))
        root = m.select("c", "root").join(later, "root", "left").select("c", F.coalesce("_last", "root").alias("root"))
        # Later maps are smaller and smaller; a few of them make one plan.
        root = settle(root, "roots") if back % 3 == 2 else root
    tree = trees[0]
    for t in trees[1:]:
        tree = tree.unionByName(t)
    return settle(tree, "tree"), settle(root.select(F.col("c").alias("node"), "root"), "roots")


def tours(edges: DataFrame, trace: list | None = None) -> DataFrame:
    """node, root, parent, pre, size of a spanning forest of edges (u, v): a subtree is the numbers pre ... pre + size - 1."""
    tree, labels = forest(edges, trace)
    with_root = tree.join(labels.select(F.col("node").alias("u"), "root"), "u")
    arc = lambda a, b: with_root.select(F.col(a).alias("tail"), F.col(b).alias("head"), "u", "v", "root")
    arcs = numbered(arc("u", "v").unionByName(arc("v", "u")), "tail", "head")
    # After an arc comes, around its head, the arc behind its twin; behind the last arc of a node comes its first.
    spans = arcs.groupBy("tail").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("root").alias("root"))
    spans = settle(spans, "spans")
    turned = arcs.join(spans.select(F.col("last").alias("pos"), "first"), "pos", "left").select("u", "v", "tail", "pos", F.coalesce("first", F.col("pos") + 1).alias("next"))
    twins = turned.groupBy("u", "v").agg(*[F.max(F.when(F.col("tail") == F.col(e), F.col(c))).alias(f"{c}_{e}") for e in "uv" for c in ("pos", "next")])
    twins = settle(twins, "twins")
    follow = twins.select(F.col("pos_u").alias("id"), F.col("next_v").alias("nxt")).unionByName(twins.select(F.col("pos_v").alias("id"), F.col("next_u").alias("nxt")))
    begins = spans.where("tail = root").select(F.col("first").alias("nxt"), F.lit(True).alias("begin"))
    links = follow.join(begins, "nxt", "left").select("id", F.when(F.col("begin").isNull(), F.col("nxt")).alias("nxt"))
    rest = ranked(links, trace=trace).select("id", "n")
    left = twins.join(rest.select(F.col("id").alias("pos_u"), F.col("n").alias("n_u")), "pos_u").join(rest.select(F.col("id").alias("pos_v"), F.col("n").alias("n_v")), "pos_v")
    down = F.col("n_u") > F.col("n_v")
    child = left.select(F.when(down, F.col("v")).otherwise(F.col("u")).alias("node"), F.when(down, F.col("u")).otherwise(F.col("v")).alias("parent"), F.greatest("n_u", "n_v").alias("left"), ((F.abs(F.col("n_u") - F.col("n_v")) + 1) / 2).cast("long").alias("size"))
    child = settle(child.join(labels, "node"), "children")
    # The root comes first, and its tree has one more node than children.
    roots = child.groupBy("root").agg((F.count("*") + 1).alias("size"))
    roots = roots.select(F.col("root").alias("node"), "root", F.lit(None).cast("long").alias("parent"), F.lit((1 << 62)).cast("long").alias("left"), "size")
    nodes = child.select("node", "root", "parent", "left", "size").unionByName(roots)
    return numbered(nodes, F.col("root"), F.col("left").desc()).select("node", "root", "parent", F.col("pos").alias("pre"), "size")


def extremes(values: DataFrame, spans: DataFrame, trace: list | None = None) -> DataFrame:
    """key, lo, hi: least lo and greatest hi of values (pos, lo, hi; pos is 0, 1, ...) over each of the spans (key, l, r)."""
    answers = []
    values, spans = settle(values, "values"), settle(spans.select("key", "l", "r"), "asked")
    while True:
        blocks = values.groupBy(F.floor(F.col("pos") / FAN).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "lo", "hi"))).alias("x"))
        blocks = settle(blocks.select("block", F.col("x.lo").alias("los"), F.col("x.hi").alias("his")), "blocks")
        bl, br, at, to = F.floor(F.col("l") / FAN), F.floor(F.col("r") / FAN), F.col("l") % FAN, F.col("r") % FAN
        ask = lambda rows, block, start, length: rows.select("key", block.alias("block"), (start + 1).cast("int").alias("start"), length.cast("int").alias("length"))
        one, more = spans.where(bl == br), spans.where(bl < br)
        asked = ask(one, bl, at, to - at + 1).unionByName(ask(more, bl, at, FAN - at)).unionByName(ask(more, br, F.lit(0), to + 1))
        part = lambda c: F.slice(c, F.col("start"), F.col("length"))
        answers.append(settle(asked.join(blocks, "block").select("key", F.array_min(part("los")).alias("lo"), F.array_max(part("his")).alias("hi")), "answers"))
        then = settle(more.select("key", (bl + 1).alias("l"), (br - 1).alias("r")).where("l <= r"), "asked")
        above = settle(blocks.select(F.col("block").alias("pos"), F.array_min("los").alias("lo"), F.array_max("his").alias("hi")), "values")
        free(values, spans, blocks)
        values, spans = above, then
        if trace is not None:
            trace.append("level")
        if spans.isEmpty():
            break
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _collapsed(edges: DataFrame) -> DataFrame:
    """u, v, a, b, k: edges without loops, by their ends; k of them are parallel."""
    long = lambda c: F.col(c).cast("long").alias(c)
    rows = edges.select(long("a"), long("b")).where("a <> b")
    return settle(rows.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("a").alias("a"), F.min("b").alias("b"), F.count("*").alias("k")), "edges")


def _cut(edge: DataFrame, nodes: DataFrame, trace: list | None = None) -> DataFrame:
    """a, b, node, root, pre, size of each bridge; node is the end that is farther from its root."""
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("pre").alias(f"pre_{c}"), F.col("parent").alias(f"parent_{c}"))
    placed = edge.join(end("u"), "u").join(end("v"), "v")
    beside = placed.where("k > 1 or not (coalesce(parent_u = v, false) or coalesce(parent_v = u, false))")
    reach = lambda a, b: beside.select(F.col(a).alias("pos"), F.col(b).alias("to"))
    reached = reach("pre_u", "pre_v").unionByName(reach("pre_v", "pre_u")).unionByName(nodes.select(F.col("pre").alias("pos"), F.col("pre").alias("to")))
    values = reached.groupBy("pos").agg(F.min("to").alias("lo"), F.max("to").alias("hi"))
    below = nodes.where("parent is not null")
    found = extremes(values, below.select(F.col("node").alias("key"), F.col("pre").alias("l"), (F.col("pre") + F.col("size") - 1).alias("r")), trace)
    bare = below.join(found.withColumnRenamed("key", "node"), "node").where("lo >= pre and hi < pre + size")
    ends = bare.select("node", "root", "pre", "size", F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))
    return settle(ends.join(edge.select("u", "v", "a", "b"), ["u", "v"]).drop("u", "v"), "cut")


def _named(nodes: DataFrame) -> DataFrame:
    """root, component (the least node of its tree), total (its nodes)."""
    return nodes.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("total"))


def bridges(edges: DataFrame, trace: list | None = None) -> DataFrame:
    """component, a, b of edges (a, b) whose loss splits their component; parallel edges and loops are none."""
    edge = _collapsed(edges)
    nodes = tours(edge, trace)
    return _cut(edge, nodes, trace).join(_named(nodes), "root").select("component", "a", "b")


def sides(edges: DataFrame, held: DataFrame, sums: list[str], trace: list | None = None) -> DataFrame:
    """component, a, b of each bridge of edges (a, b), and what its loss leaves on a's and on b's side: a_nodes, b_nodes, and for
    each of sums, columns of held (node), a_<sum> and b_<sum>. Nodes may be missing in held; rows of a node add up."""
    edge = _collapsed(edges)
    nodes = tours(edge, trace)
    cut = _cut(edge, nodes, trace)
    per = held.groupBy("node").agg(*[F.sum(s).alias(s) for s in sums])
    placed = settle(nodes.select("node", "root", F.col("pre").alias("pos")).join(per, "node", "left"), "held")
    run = settle(running(placed, sums), "running")
    # A subtree's sum is what has come up to its last number less what had come before its first.
    until = lambda name: run.select(F.col("pos").alias(name), *[F.col(s).alias(f"{name}_{s}") for s in sums])
    got = cut.withColumns({"last": F.col("pre") + F.col("size") - 1, "before": F.col("pre") - 1}).join(until("last"), "last").join(until("before"), "before", "left")
    whole = placed.groupBy("root").agg(F.min("node").alias("component"), F.count("*").alias("total"), *[F.coalesce(F.sum(F.col(s).cast("double")), F.lit(0.0)).alias(f"all_{s}") for s in sums])
    got = got.join(whole, "root")
    far = F.col("node") == F.col("a")
    side = lambda below, every: (F.when(far, below).otherwise(every - below), F.when(far, every - below).otherwise(below))
    columns = {"a_nodes": None, "b_nodes": None}
    columns["a_nodes"], columns["b_nodes"] = side(F.col("size"), F.col("total"))
    for s in sums:
        below = F.col(f"last_{s}") - F.coalesce(f"before_{s}", F.lit(0.0))
        columns[f"a_{s}"], columns[f"b_{s}"] = side(below, F.col(f"all_{s}"))
    return got.select("component", "a", "b", *[c.alias(name) for name, c in columns.items()])


def absorbed(edges: DataFrame, sums: list[str], kept: DataFrame | None = None, trace: list | None = None) -> DataFrame:
    """first, last, a, b, n and the sums of what becomes one edge when nodes between just two edges are absorbed.

    edges (id, a, b and what sums names), ids once each; kept (node): nodes that stay though they lie between two edges. All
    chains shrink at once: an arc that arrives at such a node goes on with the other edge there, and pointer doubling ranks the
    lists. Sums are added from the chain's first edge to its last, as a walk would, RUN edges at a time. A chain runs from the end whose edge has the lesser id (at one edge: from a). One that comes back to its node becomes a
    loop, and edges of a cycle on which every node would go stay as they are.
    """
    rows = numbered(edges.select("id", "a", "b", *sums), "id")
    # Arc 2p leads from a to b, 2p + 1 back; an arc's end code is that of the arc which leaves there.
    arc = lambda side, tail, head: rows.select((F.col("pos") * 2 + side).alias("id"), F.col("id").alias("edge"), F.col(tail).alias("tail"), F.col(head).alias("head"), *sums)
    arcs = arc(0, "a", "b").unionByName(arc(1, "b", "a"))
    inner = arcs.groupBy(F.col("tail").alias("node")).agg(F.count("*").alias("n"), F.min("id").alias("x"), F.max("id").alias("y")).where("n = 2")
    inner = settle(inner if kept is None else inner.join(kept.select("node"), "node", "left_anti"), "inner")
    turn = lambda c, d: inner.select(F.col(c).bitwiseXOR(F.lit(1)).alias("id"), F.col(d).alias("nxt"))
    turns = settle(turn("x", "y").unionByName(turn("y", "x")), "turns")
    done = settle(ranked(arcs.select("id").join(turns, "id", "left"), trace=trace), "lists")
    starts = done.join(turns.select(F.col("nxt").alias("id")), "id", "left_anti").where(F.col("id") < F.col("last").bitwiseXOR(F.lit(1)))
    heads = arcs.select(F.col("id").alias("last"), F.col("edge").alias("last_edge"), "head")
    starts = settle(starts, "starts")
    listed = done.join(starts.select("last"), "last", "left_semi").join(arcs.select("id", *sums), "id")
    zero = {s: F.lit(0).cast(edges.schema[s].dataType) for s in sums}
    add = lambda s: lambda x, y: x + y[s]
    walk = lambda place: [F.aggregate(F.array_sort(F.collect_list(F.struct(place, *sums))), zero[s], add(s)).alias(s) for s in sums]
    runs = listed.groupBy("last", F.floor((F.col("n") - 1) / RUN).alias("run")).agg(*walk((-F.col("n")).alias("place")))
    added = runs.groupBy("last").agg(*walk((-F.col("run")).alias("place")))
    chains = starts.join(arcs.select("id", "edge", "tail"), "id").join(heads, "last").join(added, "last").select(F.col("edge").alias("first"), F.col("last_edge").alias("last"), F.col("tail").alias("a"), F.col("head").alias("b"), "n", *sums)
    cycles = arcs.where("id % 2 = 0").join(done.select("id"), "id", "left_anti")
    return chains.unionByName(cycles.select(F.col("edge").alias("first"), F.col("edge").alias("last"), F.col("tail").alias("a"), F.col("head").alias("b"), F.lit(1).cast("long").alias("n"), *sums))
