"""N-gram Jaccard self-join with set-relation skipping.

A document's set holds its distinct SHINGLE-word shingles. Equal sets are one node. Sets that reach the similarity share
a shingle of their prefixes when all sets are ordered alike, rare shingles first; those prefixes make an inverted index.

Answers are derived before they are computed. In each index list one set is the pivot, and all others are verified
against it. For two more sets of the list, what they share with the pivot bounds what they share with each other from
above and below, so most pairs are refused or accepted without looking at the sets; pairs that links already join are left
out. What remains is matched by blocks of the lists: blocks that lie too far apart in length or behind in position are skipped
whole. A pair is verified in two steps, by how many items fall in each cell of a few and, where that does not refuse it, by
its shingles. No candidate that the bounds leave open is dropped, so every link between components is found.

Null or empty text, or one without words: an empty set, linked with nothing. Rows that repeat a doc_id are documents that
happen to share an id; links of any of them count for it. Rows without a doc_id are documents, and link others; their
component_id is the least id there, null if none has one. An empty table gives an empty result. Further columns are not
looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.llm._blocks import Block, blocks, mix, signed, windows
from voltspan.llm._components import components
from voltspan.llm._io import materialise, partitions, release, tidy, tidy_group
from voltspan.llm._skew import join_hot

SHINGLE, PERCENT = 4, 85
CHUNK = 4 << 20
#: Entries of a list that a block holds on average, at most.
BLOCK_ROWS = 64
#: Pivots that each index list has in turn before the rest is matched.
PIVOTS = 2
#: Values that a part counts on average, at most; sets that are read for verification by a broadcast of their ids, at most.
MOST_VALUES, MOST_BROADCAST = 1_000_000, 500_000


def shingle_sets(block: Block, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a block."""
    block.words()
    words = block.word_hashes(lower=True)
    every = windows(words, k)
    for a, b in zip(block.first.tolist(), block.last.tolist(), strict=True):
        if b - a >= k:
            yield np.unique(every[a : b - k + 1])
        elif b > a:
            yield mix(windows(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.empty(0, dtype=np.uint64)


def keys(found: np.ndarray) -> int:
    """A hash of a whole set."""
    x = mix(found)
    return int(signed(mix(np.array([x.sum(), np.bitwise_xor.reduce(mix(x + np.uint64(1))) if len(x) else 0, len(x)], dtype=np.uint64)))[0] ^ signed(mix(np.array([np.bitwise_xor.reduce(mix(x + np.uint64(2))) if len(x) else 0], dtype=np.uint64) + np.uint64(len(x))))[0])


#: For each chunk of documents: them (part -1), and for each part its values, in order, with the number of sets that have each.
CHUNKS = "chunk string, part long, n long, values binary, counts binary, docs binary"
_KINDS = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending values as byte planes of their steps; the upper ones are nearly all zero and compress away."""
    steps = np.diff(values, prepend=np.uint64(0))
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, : len(data) // max(n, 1)] = np.frombuffer(data, dtype=np.uint8).reshape(-1, n).T
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def rarity(counts: np.ndarray) -> np.ndarray:
    """0: in one set only; else more, the more sets have it, in steps of an eighth of a doubling."""
    return np.where(counts < 2, 0, np.minimum(1 + np.log2(np.maximum(counts, 1)) * 8, 255)).astype(np.uint8)


def _rarities(table: pa.Table) -> pa.Table:
    """Of one part: for each chunk, how rare its values are among all sets."""
    n = table.column("n").to_pylist()
    values = np.concatenate([unpack_sorted(x, m) for x, m in zip(table.column("values").to_pylist(), n, strict=True)])
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype="<u4")
    kinds, inverse = np.unique(values, return_inverse=True)
    found = rarity(np.bincount(inverse, weights=counts, minlength=len(kinds)))[inverse]
    back = [x.tobytes() for x in np.split(found, np.cumsum(n)[:-1])]
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "rare": pa.array(back, pa.binary())})


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """For each document a row (doc_id, row, n, s: hash of the set, cells), and one for each shingle h of its prefix that
    repeats; documents of a chunk whose sets are equal have those once.

    How many sets have a shingle is counted over the corpus, by so many bits of its hash that few share a count by chance;
    that could only change the order, which is the same for all. So the prefix of a set holds its rarest shingles, and lists
    stay short however large the corpus is.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shift = np.uint64(64 - min(56, max(24, (size // 5 + 1).bit_length() + 4)))
    parts = max(2, partitions(docs.sparkSession), size // 5 // MOST_VALUES + 1)
    width = np.uint64((1 << 64 - int(shift)) // parts + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        values: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            kinds, n = np.unique(np.concatenate(values), return_counts=True)
            chunk = uuid.uuid4().hex
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as w:
                for x in held:
                    w.write_batch(x)
            rows = [(chunk, -1, 0, b"", b"", sink.getvalue().to_pybytes())]
            part = kinds // width
            edge = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(kinds)])) if len(kinds) else [0]
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                rows.append((chunk, int(part[a]), int(b - a), pack_sorted(kinds[a:b]), n[a:b].astype("<u4").tobytes(), b""))
            held.clear()
            values.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

        size = 0
        for block in blocks(batches):
            held.append(block.rows)
            values.extend(found >> shift for found in shingle_sets(block, k))
            size += len(block.buf)
            if size > CHUNK:
                yield flush()
                size = 0
        if held:
            yield flush()

    def entries(table: pa.Table) -> pa.Table:
        parts = table.column("part").to_pylist()
        own = parts.index(-1)
        order = [i for i in sorted(range(len(parts)), key=parts.__getitem__) if i != own]
        rare = np.frombuffer(b"".join(table.column("rare")[i].as_py() for i in order), dtype=np.uint8)
        rows = pa.ipc.open_stream(table.column("docs")[own].as_py()).read_all()
        sets = [found for block in blocks(iter(rows.to_batches())) for found in shingle_sets(block, k)]
        kinds = np.unique(np.concatenate([x >> shift for x in sets]))
        n, s, cells = list(map(len, sets)), list(map(keys, sets)), list(map(cells_of, sets))
        doc, pos, h = [], [], []
        seen: set[int] = set()
        for i, found in enumerate(sets):
            if len(found) and s[i] not in seen:
                seen.add(s[i])
                of = rare[np.searchsorted(kinds, found >> shift)]
                length = len(found) - -(-percent * len(found) // 100) + 1
                head = np.argsort(of, kind="stable")[:length]
                again = np.flatnonzero(of[head])
                doc.append(np.full(len(again), i))
                pos.append(again)
                h.append(found[head[again]])
        doc, pos = (np.concatenate(x).astype(np.int64) if x else np.empty(0, dtype=np.int64) for x in (doc, pos))
        h = np.concatenate(h) if h else np.empty(0, dtype=np.uint64)
        n, s = np.array(n, dtype=np.int64), np.array(s, dtype=np.int64)
        gone = pa.nulls(len(n), pa.int64())
        mine = pa.table({"doc_id": rows.column("doc_id"), "row": rows.column("row"), "n": pa.array(n), "s": pa.array(s), "cells": pa.array(cells, pa.binary()), "pos": gone, "h": gone})
        gone = pa.nulls(len(doc), pa.int64())
        return pa.concat_tables([mine, pa.table({"doc_id": gone, "row": gone, "n": pa.array(n[doc]), "s": pa.array(s[doc]), "cells": pa.nulls(len(doc), pa.binary()), "pos": pa.array(pos), "h": pa.array(signed(h))})])

    chunks = materialise(docs.select("doc_id", "row", "text").mapInArrow(tidy(run), CHUNKS), "setjoin-chunks")
    none = F.lit(None).cast("binary")
    rare = chunks.where("part >= 0").drop("docs").groupBy("part").applyInArrow(tidy_group(_rarities), "chunk string, part long, rare binary")
    both = rare.withColumn("docs", none).unionByName(chunks.where("part = -1").select("chunk", "part", none.alias("rare"), "docs"))
    schema = "doc_id long, row long, n long, s long, cells binary, pos long, h long"
    out = materialise(both.groupBy("chunk").applyInArrow(tidy_group(entries), schema), "setjoin-prefixes", free=True)
    release(chunks)
    return out


def cells_of(found: np.ndarray) -> bytes:
    """How many items of a set fall in each of a power of two of cells, about four in one; 255 stands for more, too."""
    size = 1 << max(4, (len(found) // 4).bit_length() - 1 if len(found) >= 4 else 0)
    return np.minimum(np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def most_common(a: bytes, b: bytes, nx: int, ny: int) -> int:
    """A bound from above of what two sets share: cell by cell, no more than the lesser has."""
    u, v = (np.frombuffer(x, dtype=np.uint8) for x in (a, b))
    if len(u) > len(v):
        u, v = v, u
    if u.max(initial=0) == 255 or v.max(initial=0) == 255:
        return min(nx, ny)
    return int(np.minimum(u, v.reshape(-1, len(u)).sum(axis=0)).sum())


def set_arrays(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """s and its sorted shingle hashes, for the sets of wanted (s, doc_id, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            items = [found.tobytes() for found in shingle_sets(block, k)]
            yield pa.RecordBatch.from_arrays([block.rows.column("s"), pa.array(items, pa.binary())], names=["s", "items"])

    ids = wanted.select("s", F.col("doc_id").alias("_d"), F.col("row").alias("_r"))
    if wanted.count() <= MOST_BROADCAST:  # three numbers a row
        ids = F.broadcast(ids)
    texts = docs.join(ids, (F.col("row") == F.col("_r")) & F.col("doc_id").eqNullSafe(F.col("_d"))).select("s", "text")
    # Rows that repeat id and text give equal arrays.
    return texts.mapInArrow(tidy(run), "s long, items binary").groupBy("s").agg(F.first("items").alias("items"))


def _linked(common, nx, ny, percent: int):
    return 100 * common >= percent * (nx + ny - common)


def _near_lengths(a, b, percent: int):
    return (100 * F.least(a, b)) >= (percent * F.greatest(a, b))


def verify(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (x, y, nx, ny) -> with lo and hi: bounds of what they share, equal for all that may be linked.

    Most pairs are refused by cells, so only sets that have a likely partner are read from their texts, and sent to it.
    """

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = [most_common(a.as_buffer(), b.as_buffer(), nx, ny) for a, b, nx, ny in zip(batch.column("a"), batch.column("b"), batch.column("nx").to_pylist(), batch.column("ny").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(most, pa.int64())], names=[*batch.schema.names[:-2], "hi"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                u, v = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (a, b))
                if len(u) > len(v):
                    u, v = v, u
                at = np.minimum(np.searchsorted(v, u), len(v) - 1)
                common.append(int(np.count_nonzero(v[at] == u)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(common, pa.int64())], names=[*batch.schema.names[:-2], "hi"])

    schema = "x long, y long, nx long, ny long, hi long"
    pairs = materialise(pairs, "setjoin-pairs", free=True)

    def with_both(of: DataFrame, what: DataFrame, column: str) -> DataFrame:
        half = join_hot(of, what.select(F.col("s").alias("x"), F.col(column).alias("a")), "x", "y")
        return join_hot(half, what.select(F.col("s").alias("y"), F.col(column).alias("b")), "y", "x").select("x", "y", "nx", "ny", "a", "b")

    bounded = materialise(with_both(pairs, sets, "cells").mapInArrow(tidy(bound), schema), "setjoin-bounded", free=True)
    likely = _linked(F.col("hi"), F.col("nx"), F.col("ny"), percent)
    open_pairs = bounded.where(likely).drop("hi")
    wanted = open_pairs.select(F.explode(F.array("x", "y")).alias("s")).distinct()
    wanted = materialise(sets.join(wanted, "s", "left_semi").select("s", "doc_id", "row"), "setjoin-wanted")
    arrays = materialise(set_arrays(docs, wanted, k), "setjoin-sets", free=True)
    open_pairs = materialise(open_pairs, "setjoin-likely")
    found = with_both(open_pairs, arrays, "items").mapInArrow(tidy(exact), schema).withColumn("lo", F.col("hi"))
    out = materialise(found.unionByName(bounded.where(~likely).withColumn("lo", F.lit(0).cast("long"))), "setjoin-verified", free=True)
    release(pairs, bounded, wanted, arrays, open_pairs)
    return out


def _ordered(pairs: DataFrame) -> DataFrame:
    """Pairs of a set (s, n) and a pivot p, the lesser of both as x."""
    first = F.col("s") < F.col("p.s")
    return pairs.select(
        F.least("s", "p.s").alias("x"),
        F.greatest("s", "p.s").alias("y"),
        F.when(first, F.col("n")).otherwise(F.col("p.n")).alias("nx"),
        F.when(first, F.col("p.n")).otherwise(F.col("n")).alias("ny"),
    ).distinct()


def _with_component(df: DataFrame, group: DataFrame) -> DataFrame:
    joined = join_hot(df, group.select(F.col("node").alias("s"), "component"), "s", "h", "left")
    return joined.withColumn("component", F.coalesce("component", "s"))


def matched_blocks(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that share a list, block by block.

    A block holds entries of one list, of about one length and one part of the prefix; those of the list's largest component
    have blocks of their own. Two blocks are skipped unseen if their lengths are too far apart, if what stands behind their
    foremost positions can't reach the similarity, or if one component holds both. In the others a pair becomes a row only if
    its lengths, its positions and what both share with the list's pivot leave it open.
    """
    step = -np.log(percent / 100)
    head = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1
    largest = rest.groupBy("h", "component").agg(F.count("*").alias("_n")).groupBy("h").agg(F.max_by("component", F.struct("_n", "component")).alias("largest"))
    entry = F.struct("s", "n", "pos", "component", "lo", "hi", "pivot_n")
    place = [F.floor(F.log("n") / F.lit(step) + 1e-9).alias("length"), F.floor(F.col("pos") * 4 / head).alias("quarter"), (F.col("component") == F.col("largest")).alias("of_largest"), F.pmod(F.xxhash64("s"), F.ceil(F.col("size") / BLOCK_ROWS)).alias("slot")]
    blocked = rest.join(largest, "h").select("h", *place, entry.alias("e"))
    blocked = blocked.groupBy("h", "length", "quarter", "of_largest", "slot").agg(F.collect_list("e").alias("rows"), F.min("e.n").alias("least_n"), F.max("e.n").alias("most_n"), F.min("e.pos").alias("least_pos"), F.min("e.component").alias("least_c"), F.max("e.component").alias("most_c"))
    blocked = materialise(blocked, "setjoin-blocks", free=True)
    at = F.struct(F.col("length").alias("l"), "quarter", "of_largest", "slot")
    block = F.struct("rows", "least_n", "most_n", "least_pos", "least_c", "most_c")
    a = blocked.select("h", F.explode(F.array("length", F.col("length") + 1)).alias("length"), at.alias("at"), block.alias("a"))
    b = blocked.select("h", "length", at.alias("bt"), block.alias("b"))
    need = lambda x, y: F.ceil((x + y) * F.lit(percent) / F.lit(100 + percent) - 1e-9)
    reach = F.least(F.col("a.most_n") - F.col("a.least_pos"), F.col("b.most_n") - F.col("b.least_pos"))
    one_component = (F.col("a.least_c") == F.col("a.most_c")) & (F.col("b.least_c") == F.col("b.most_c")) & (F.col("a.least_c") == F.col("b.least_c"))
    seen = (F.col("at") <= F.col("bt")) & (100 * F.col("a.most_n") >= percent * F.col("b.least_n")) & (reach >= need(F.col("a.least_n"), F.col("b.least_n"))) & ~one_component
    pairs = a.join(b, ["h", "length"]).where(seen)
    pairs = pairs.select((F.col("at") == F.col("bt")).alias("one"), F.explode("a.rows").alias("u"), F.col("b.rows").alias("rows"))

    def left_open(v):
        u = lambda c: F.col("u")[c]
        # Of v, at most its share with the pivot is in the pivot, and u has n - lo others.
        upper = F.least(v["hi"] + u("n") - u("lo"), u("hi") + v["n"] - v["lo"])
        by_position = F.least(u("n") - u("pos"), v["n"] - v["pos"])
        lacks = need(u("n"), v["n"])
        return (u("component") != v["component"]) & (~F.col("one") | (u("s") < v["s"])) & _near_lengths(u("n"), v["n"], percent) & (by_position >= lacks) & (upper >= lacks)

    pairs = pairs.select("u", F.explode(F.filter("rows", left_open)).alias("v"))
    u, v = (lambda c: F.col(f"u.{c}")), (lambda c: F.col(f"v.{c}"))
    x = u("s") < v("s")
    # Of the pivot, both together have at most pivot_n, so u and v share the rest of what each shares with it.
    pairs = pairs.select(F.least(u("s"), v("s")).alias("x"), F.greatest(u("s"), v("s")).alias("y"), F.when(x, u("n")).otherwise(v("n")).alias("nx"), F.when(x, v("n")).otherwise(u("n")).alias("ny"), F.greatest(F.lit(0), u("lo") + v("lo") - u("pivot_n")).alias("lower"))
    found = materialise(pairs.groupBy("x", "y", "nx", "ny").agg(F.max("lower").alias("lower")), "setjoin-open", free=True)
    release(blocked)
    return found


def link(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("row"))
    found = prefixes(docs, k, percent)
    own = found.where("h is null").select("doc_id", "row", "n", "s", "cells")
    # Documents of equal sets have the same entries; one exchange by shingle serves all three steps.
    index = found.where("h is not null").select("s", "n", "pos", "h").repartition(max(2, partitions(docs.sparkSession)), "h").distinct()
    lists = index.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    lists = materialise(index.join(lists, "h"), "setjoin-lists", free=True)
    # The set that meets most others is the pivot of its lists: of near copies, mostly the one that all were made from.
    meets = lists.groupBy("s").agg(F.sum("size").alias("meets"))
    index = materialise(lists.join(meets, "s"), "setjoin-index", free=True)
    release(lists)
    # One document stands for each set in a list.
    sets = own.where("n > 0").groupBy("s").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row", "cells")).alias("of"))
    sets = sets.join(index.select("s").distinct(), "s", "left_semi")
    sets = materialise(sets.select("s", "of.doc_id", "of.row", "of.cells"), "setjoin-representatives", free=True)
    group, checked, hubs, pivots = None, [], None, None
    for _ in range(PIVOTS):
        if group is None:
            open_index = index.withColumn("component", F.col("s"))
            pivots = open_index.groupBy("h").agg(F.max(F.struct("meets", "n", "s", "component")).alias("p"))
        else:
            # Lists that still hold several components get a pivot outside that of the last one.
            open_index = _with_component(index, group)
            last = open_index.join(pivots.select("h", F.col("p.s").alias("last")), "h")
            of_last = last.where(F.col("s") == F.col("last")).select("h", F.col("component").alias("of_last"))
            pivots = last.join(of_last, "h").where(F.col("component") != F.col("of_last")).groupBy("h").agg(F.max(F.struct("meets", "n", "s", "component")).alias("p"))
        pivots = materialise(pivots, "setjoin-pivots", free=True)
        hubs = pivots if hubs is None else hubs
        pairs = open_index.join(pivots, "h").select("s", "n", "component", "p")
        pairs = pairs.where((F.col("component") != F.col("p.component")) & (F.col("s") != F.col("p.s")) & _near_lengths(F.col("n"), F.col("p.n"), percent))
        checked.append(verify(_ordered(pairs), sets, docs, k, percent))
        links = checked[-1].where(_linked(F.col("lo"), F.col("nx"), F.col("ny"), percent)).select(F.col("x").alias("a"), F.col("y").alias("b"))
        group = components(links if group is None else group.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))
    known = _with_component(index, group)
    open_lists = known.groupBy("h").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("h")
    known = known.join(open_lists, "h", "left_semi")
    # What each set shares with the first pivot of a list is known, unless their lengths are too far apart.
    known = known.join(hubs.select("h", F.col("p.s").alias("pivot"), F.col("p.n").alias("pivot_n")), "h").where(F.col("s") != F.col("pivot"))
    shares = checked[0].unionByName(checked[1]) if len(checked) > 1 else checked[0]
    shares = shares.select(F.col("x").alias("s"), F.col("y").alias("pivot"), "lo", "hi").unionByName(shares.select(F.col("y").alias("s"), F.col("x").alias("pivot"), "lo", "hi"))
    shares = shares.groupBy("s", "pivot").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    known = known.join(shares, ["s", "pivot"], "left")
    rest = known.withColumns({"lo": F.coalesce("lo", F.lit(0)), "hi": F.coalesce("hi", F.least("n", "pivot_n"))})
    found = matched_blocks(rest, percent)
    sure = _linked(F.col("lower"), F.col("nx"), F.col("ny"), percent)
    exact = verify(found.where(~sure).select("x", "y", "nx", "ny"), sets, docs, k, percent)
    more = found.where(sure).select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(exact.where(_linked(F.col("lo"), F.col("nx"), F.col("ny"), percent)).select(F.col("x").alias("a"), F.col("y").alias("b")))
    if not more.isEmpty():
        group = components(group.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    # The least id of each set, then of each component, is handed back to the sets and to the documents.
    least = own.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("least"))
    least = materialise(least.join(group.select(F.col("node").alias("s"), "component"), "s", "left").withColumn("component", F.coalesce("component", "s")), "setjoin-components", free=True)
    of = least.groupBy("component").agg(F.min("least").alias("component_id"))
    of = materialise(join_hot(least, of, "component", "s").select("s", "component_id"), "setjoin-named", free=True)
    named = join_hot(own.select("doc_id", "row", "n", "s"), of, "s", "doc_id", "left")
    release(index, sets, hubs, *checked)
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
