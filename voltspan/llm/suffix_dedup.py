"""Exact substring removal by a distributed, common-prefix-aware merge sort of suffixes.

Every SPAN-byte string holds an anchor: the leftmost least hash among its GRAM-byte strings, at the same place wherever the
string stands. So only suffixes that begin at anchors are sorted, and of those only the ones whose first GRAM bytes occur
twice in the corpus (counted over all anchors, by hash).

1. Chunks of documents send the distinct hashes of their anchors to parts, which answer with one bit each.
2. Tasks sort their repeated anchors' suffixes, with what precedes them behind, into runs. Equal ones meet here: only the
   earliest of a run goes on. Runs are cut at sampled splitters, front-coded (length of the prefix shared with the entry
   before, and the rest) and exchanged.
3. Each range merges its runs with a loser tree that keeps, for each loser, the prefix length it shares with the winner.
   A longer shared prefix wins unseen, and an equal one is compared from there on. The merge gives every suffix the prefix
   length that it shares with its neighbours: equal suffixes repeat an earlier one in all their strings, and no string can
   repeat that reaches beyond the longest shared prefix.
4. The strings that remain open, at the borders of what is shared, are matched by a 128-bit hash, the earliest of a task
   first.
5. Each document gets the starts of its repeated strings, and is cut.

A hot string crosses an exchange once a task. Null text: empty. Texts under SPAN bytes lose nothing. Equal rows are judged
alike, and rows that share a doc_id are one document for what is earlier; so are those without one, which come after all
others. An empty table gives an empty result. Further columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltspan.llm._blocks import PRIME, SYMBOL, Block, as_bytes, blocks, minus, mix, powers, prefix_sums, prime_powers, prime_prefixes, span_hash, times
from voltspan.llm._io import materialise, partitions, release, tidy, tidy_group
from voltspan.llm._repeats import CHUNKS, answers, ask, hits

SPAN, GRAM = 100, 50
REACH = SPAN - GRAM
WIDTH = SPAN + REACH + 2
CHUNK, RUN = 16 << 20, 150_000
#: Sampled anchors a chunk, and at most in all, that place the splitters.
SAMPLED, MOST_SAMPLED = 32, 50_000
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Base of a second, independent hash of open strings, modulo a prime.
_BASE = 1_118_033_988_749_894_849
_UNBASE = pow(_BASE, -1, PRIME)
#: Stands for a missing doc_id.
_LAST = (1 << 63) - 1


def anchors(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first and last start of the strings that it stands for, hash of its gram), in order of place."""
    n = len(block.buf)
    none = np.empty(0, dtype=np.int64)
    if n < SPAN:
        return none, none, none, np.empty(0, dtype=np.uint64)
    sums = prefix_sums(SYMBOL[block.buf])
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * powers(n)[1][: n - GRAM + 1])
    value, at = (gram >> np.uint64(32)).astype(np.uint32), np.arange(len(gram), dtype=np.int32)
    width = 1
    while 2 * width <= REACH + 1:
        later = value[width:] < value[:-width]
        at = np.where(later, at[width:], at[:-width])
        value = np.where(later, value[width:], value[:-width])
        width *= 2
    if shift := REACH + 1 - width:
        at = np.where(value[shift:] < value[:-shift], at[shift:], at[:-shift])
    # at[p]: the anchor of the string from p on; strings that cross documents are none.
    edge = np.zeros(n + 1, dtype=np.int8)
    long = block.end - block.start >= SPAN
    edge[block.start[long]] += 1
    edge[block.end[long] - SPAN + 1] -= 1
    start = np.flatnonzero(np.cumsum(edge[:n], dtype=np.int8))
    if not len(start):
        return none, none, none, np.empty(0, dtype=np.uint64)
    at = at[start]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (np.diff(start) > 1))))
    a = at[new].astype(np.int64)
    return a, start[new], start[np.concatenate((new[1:], [len(start)])) - 1], gram[a]


def anchor_chunks(docs: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        sampled: list[bytes] = []

        def flush() -> pa.RecordBatch:
            hashes = np.concatenate([x[0] for x in held])
            table = pa.table({"doc_id": pa.concat_arrays([x[2] for x in held]), "row": pa.concat_arrays([x[3] for x in held]), "n": pa.array(np.concatenate([x[1] for x in held]))})
            out = ask(hashes, table, parts, b"".join(sampled[:: max(1, len(sampled) // SAMPLED)]))
            held.clear()
            sampled.clear()
            return out

        size = 0
        for block in blocks(batches):
            a, _, _, gram = anchors(block)
            doc = np.searchsorted(block.end, a)
            held.append((gram, np.bincount(doc, minlength=len(block)).astype(np.int64), block.rows.column("doc_id"), block.rows.column("row")))
            sampled.extend(block.buf[i : i + GRAM].tobytes() for i in a[:: max(1, len(a) // 4)])
            size += len(block.buf)
            if size > CHUNK:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.mapInArrow(tidy(run), CHUNKS)


def _flags(table: pa.Table) -> pa.Table:
    """Of one chunk: for each document, the ordinals of its repeated anchors."""
    hit, docs = hits(table)
    n = docs.column("n").to_numpy()
    first = np.cumsum(n) - n
    at = np.flatnonzero(hit)
    doc = np.repeat(np.arange(len(n)), n)[at] if len(at) else np.empty(0, dtype=np.int64)
    some, edge = np.unique(doc, return_index=True)
    lists = [x.astype("<i4").tobytes() for x in np.split(at - first[doc], edge[1:])] if len(some) else []
    picked = docs.take(pa.array(some))
    return pa.table({"doc_id": picked.column("doc_id"), "row": picked.column("row"), "ordinals": pa.array(lists, pa.binary())})


#: Rows of the exchanges: part and data of a run, or (part null) starts first to last of a document that repeat.
ROWS = "part int, data binary, doc_id long, row long, first long, last long"
_ROW_TYPES = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())


def _rows(parts: list[tuple[int, bytes]], doc_id=(), row=(), first=(), last=()) -> list[pa.Array]:
    k, n = len(parts), len(doc_id)
    gone = [None] * k
    return [
        pa.array([p for p, _ in parts] + [None] * n, pa.int32()),
        pa.array([d for _, d in parts] + [None] * n, pa.binary()),
        *(pa.concat_arrays([pa.array(gone, pa.int64()), pa.array(np.asarray(x, dtype=np.int64))]) for x in (doc_id, row, first, last)),
    ]


_NAMES = [x.split()[0] for x in ROWS.split(", ")]


class Records:
    """Suffixes at anchors: fixed-width strings (what follows, what precedes reversed, both lengths) and where they stand."""

    def __init__(self, text: np.ndarray, place: np.ndarray):
        self.text = text  # n x WIDTH
        self.place = place  # n x 5: doc_id, row, anchor, first, last

    def sort(self) -> Records:
        """In order of string, then of document and place."""
        order = np.lexsort((self.place[:, 2], self.place[:, 0]))
        order = order[np.argsort(_big(self.text[order]), kind="stable")]
        return Records(self.text[order], self.place[order])

    def shared(self) -> np.ndarray:
        """Length of the prefix that each string shares with the one before; the first shares none."""
        out = np.zeros(len(self.text), dtype=np.int64)
        if len(out) > 1:
            differ = self.text[1:] != self.text[:-1]
            out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
        return out


def _big(text: np.ndarray) -> np.ndarray:
    """Strings as objects that order as their bytes do."""
    raw = text.tobytes()
    out = np.empty(len(text), dtype=object)
    out[:] = [raw[i : i + WIDTH] for i in range(0, len(raw), WIDTH)]
    return out


def records(block: Block, ordinals: list[bytes]) -> Records:
    a, first, last, _ = anchors(block)
    doc = np.searchsorted(block.end, a)
    base = np.searchsorted(doc, np.arange(len(block)))
    wanted = np.concatenate([np.frombuffer(x, dtype="<i4") + base[i] for i, x in enumerate(ordinals)]) if ordinals else np.empty(0, dtype=np.int64)
    a, first, last, doc = a[wanted], first[wanted], last[wanted], doc[wanted]
    after, before = last + SPAN - a, a - first
    padded = np.concatenate((np.zeros(REACH, np.uint8), block.buf, np.zeros(SPAN, np.uint8)))
    text = np.empty((len(a), WIDTH), dtype=np.uint8)
    right, left = np.arange(SPAN), np.arange(REACH)
    text[:, :SPAN] = np.where(right < after[:, None], padded[(a + REACH)[:, None] + right], 0)
    text[:, SPAN : SPAN + REACH] = np.where(left < before[:, None], padded[(a + REACH - 1)[:, None] - left], 0)
    text[:, -2], text[:, -1] = after, before
    ids = block.rows.column("doc_id").to_numpy(zero_copy_only=False)[doc]
    rows = block.rows.column("row").to_numpy(zero_copy_only=False)[doc]
    start = block.start[doc]
    return Records(text, np.stack([ids, rows, a - start, first - start, last - start], axis=1).astype(np.int64))


def _pack(r: Records, shared: np.ndarray) -> bytes:
    """A front-coded run."""
    keep = np.arange(WIDTH) >= shared[:, None]
    return len(r.text).to_bytes(4, "little") + shared.astype(np.uint8).tobytes() + np.ascontiguousarray(r.place).tobytes() + r.text[keep].tobytes()


def _unpack(data: bytes) -> tuple[list[int], np.ndarray, list[bytes]]:
    """(shared prefix lengths, places, rests) of a front-coded run."""
    n = int.from_bytes(data[:4], "little")
    shared = np.frombuffer(data, dtype=np.uint8, count=n, offset=4)
    place = np.frombuffer(data, dtype=np.int64, count=5 * n, offset=4 + n).reshape(n, 5)
    edge = (4 + 41 * n + np.concatenate(([0], np.cumsum(WIDTH - shared.astype(np.int64))))).tolist()
    return shared.tolist(), place, [data[edge[i] : edge[i + 1]] for i in range(n)]


def runs(rows: DataFrame, splitters: list[bytes]) -> DataFrame:
    """Sorted, front-coded runs by range, and what repeats within a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Records] = []

        def flush() -> pa.RecordBatch:
            r = Records(np.concatenate([x.text for x in held]), np.concatenate([x.place for x in held])).sort()
            held.clear()
            shared = r.shared()
            head = shared < WIDTH
            group = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
            again = ~head & ((r.place[:, 0] > r.place[group, 0]) | (r.place[:, 2] > r.place[group, 2]))
            # Rows that share doc_id and place with the earliest are as early as it; they are decided with it.
            p = _joined(r.place[again][:, [0, 1, 3, 4]])
            r, shared = Records(r.text[~again], r.place[~again]), shared[~again]
            # What is left out was equal to the entry before, so the lengths still hold.
            cut = [0, *np.searchsorted(_big(r.text), np.array(splitters, dtype=object)).tolist(), len(r.text)] if splitters else [0, len(r.text)]
            out = []
            for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if a < b:
                    own = shared[a:b].copy()
                    own[0] = 0
                    out.append((k, _pack(Records(r.text[a:b], r.place[a:b]), own)))
            return pa.RecordBatch.from_arrays(_rows(out, *p.T), names=_NAMES)

        n = 0
        for batch in batches:
            ordinals = batch.column("ordinals").to_pylist()
            at = 0
            for block in blocks(iter([batch])):
                found = records(block, ordinals[at : at + len(block)])
                at += len(block)
                if len(found.text):
                    held.append(found)
                    n += len(found.text)
                if n > RUN:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    return rows.mapInArrow(tidy(run), ROWS)


class LoserTree:
    """Merges front-coded runs; each loser keeps the prefix length that it shares with the string that beat it."""

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.text: list[bytes | None] = [r[1][0] if r[1] else None for r in runs] + [None] * (self.size - len(runs))
        self.lcp = [0] * self.size
        self.loser = [0] * self.size
        self.winner = self._build(1)

    def _play(self, i: int, j: int) -> tuple[int, int]:
        """(winner, loser); both lengths are shared with the last winner, and the loser's is then with this one."""
        a, b = self.text[i], self.text[j]
        if a is None:
            return j, i
        if b is None:
            return i, j
        h, k = self.lcp[i], self.lcp[j]
        if h != k:
            return (i, j) if h > k else (j, i)
        x, y = int.from_bytes(a[h:], "big"), int.from_bytes(b[h:], "big")
        same = WIDTH - ((x ^ y).bit_length() + 7) // 8
        if x < y or x == y and i < j:
            self.lcp[j] = same
            return i, j
        self.lcp[i] = same
        return j, i

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.loser[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self) -> Iterator[tuple[int, int, int, bytes]]:
        """(run, entry, prefix length shared with the string before, string) in order."""
        text, lcp, loser, at, size = self.text, self.lcp, self.loser, self.at, self.size
        while (now := text[self.winner]) is not None:
            i = self.winner
            k = at[i]
            yield i, k, lcp[i], now
            shared, rests = self.runs[i]
            at[i] = k = k + 1
            if k < len(rests):
                lcp[i] = shared[k]
                text[i] = now[: shared[k]] + rests[k]
            else:
                text[i] = None
            node = (i + size) >> 1
            while node:
                i, loser[node] = self._play(i, loser[node])
                node >>= 1
            self.winner = i


def _windows(heads: np.ndarray, place: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (two words) and places (doc_id, row, start) of the strings of heads that start at least `low` before the anchor."""
    after, before = heads[:, -2].astype(np.int64), heads[:, -1].astype(np.int64)
    near = np.maximum(low, SPAN - after)  # a string may start from `before` to `near` bytes ahead of the anchor
    n = np.maximum(before - near + 1, 0)
    line = np.concatenate((heads[:, SPAN : SPAN + REACH][:, ::-1], heads[:, :SPAN]), axis=1).ravel()
    h = np.repeat(np.arange(len(heads)), n)
    ahead = before[h] - (np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n))
    start = h * (SPAN + REACH) + REACH - ahead
    sums = prime_prefixes(line.astype(np.uint64) + np.uint64(1), _BASE)
    second = times(minus(sums[start + SPAN], sums[start]), prime_powers(_UNBASE, len(line))[start])
    return np.stack((mix(span_hash(prefix_sums(SYMBOL[line]), start, start + SPAN)), second), axis=1), np.stack([place[h, 0], place[h, 1], place[h, 2] - ahead], axis=1)


def _earliest(hashes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows to keep, rows that repeat an earlier one) among strings."""
    order = np.lexsort((place[:, 2], place[:, 0], hashes[:, 1], hashes[:, 0]))
    h, p = hashes[order], place[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (h[1:] != h[:-1]).any(axis=1)
    group = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    again = ~new & ((p[:, 0] > p[group, 0]) | (p[:, 2] > p[group, 2]))
    return order[~again], order[again]


def _merge(parts: int):
    def merge(table: pa.Table) -> pa.Table:
        """Of one range: places that repeat an earlier one, and the strings that remain open, by part."""
        unpacked = [_unpack(x) for x in table.column("data").to_pylist()]
        tree = LoserTree([(s, t) for s, _, t in unpacked])
        heads: list[bytes] = []
        share: list[int] = []
        group: list[int] = []
        places: list[np.ndarray] = []
        for i, k, lcp, text in tree:
            if lcp < WIDTH or not heads:
                heads.append(text)
                share.append(min(lcp, SPAN))
            group.append(len(heads) - 1)
            places.append((i, k))
        source = np.array(places, dtype=np.int64).reshape(-1, 2)
        first_of = np.concatenate(([0], np.cumsum([len(p) for _, p, _ in unpacked])))[:-1]
        place = np.concatenate([p for _, p, _ in unpacked])[first_of[source[:, 0]] + source[:, 1]]
        g = np.array(group, dtype=np.int64)
        order = np.lexsort((place[:, 2], place[:, 0], g))
        place, g = place[order], g[order]
        new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        best = place[new]
        again = (place[:, 0] > best[g, 0]) | (place[:, 2] > best[g, 2])
        gone = place[again]
        # The neighbours' longer shared prefix bounds how far a repeated string can reach.
        with_before = np.array(share, dtype=np.int64)
        reach = np.maximum(with_before, np.append(with_before[1:], 0))
        matrix = np.frombuffer(b"".join(heads), dtype=np.uint8).reshape(-1, WIDTH)
        out: list[tuple[int, bytes]] = []
        more: list[np.ndarray] = []
        # Rows as early as the earliest share its strings; they go along as rows of their own.
        alike = np.flatnonzero(~again)
        left = alike[reach[g[alike]] >= GRAM]
        kept_h, kept_p = [], []
        for at in range(0, len(left), 20_000):
            which = left[at : at + 20_000]
            hashes, p = _windows(matrix[g[which]], place[which], SPAN - reach[g[which]])
            kept_h.append(hashes)
            kept_p.append(p)
        if kept_h:
            hashes, p = np.concatenate(kept_h), np.concatenate(kept_p)
            keep, again = _earliest(hashes, p)
            more.append(p[again])
            hashes, p = hashes[keep], p[keep]
            part = (hashes[:, 0] % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            for k in range(parts):
                own = order[edge[k] : edge[k + 1]]
                if len(own):
                    out.append((k, hashes[own].tobytes() + np.ascontiguousarray(p[own]).tobytes()))
        starts = np.concatenate(more) if more else np.empty((0, 3), dtype=np.int64)
        cover = _joined(np.concatenate((gone[:, [0, 1, 3, 4]], _ranges(starts))))
        return pa.table(_rows(out, *cover.T), names=_NAMES)

    return merge


def _ranges(starts: np.ndarray) -> np.ndarray:
    """Starts (doc_id, row, start) as ranges (doc_id, row, first, last)."""
    if not len(starts):
        return np.empty((0, 4), dtype=np.int64)
    s = starts[np.lexsort((starts[:, 2], starts[:, 1], starts[:, 0]))]
    new = np.flatnonzero(np.concatenate(([True], (s[1:, :2] != s[:-1, :2]).any(axis=1) | (s[1:, 2] - s[:-1, 2] > 1))))
    last = np.concatenate((new[1:], [len(s)])) - 1
    return np.column_stack((s[new, 0], s[new, 1], s[new, 2], s[last, 2]))


def _joined(ranges: np.ndarray) -> np.ndarray:
    """Ranges (doc_id, row, first, last), those that touch made one."""
    if not len(ranges):
        return np.empty((0, 4), dtype=np.int64)
    r = ranges[np.lexsort((ranges[:, 2], ranges[:, 1], ranges[:, 0]))]
    same = (r[1:, :2] == r[:-1, :2]).all(axis=1)
    # Anchors stand for starts in order of place, so in a document of one run the ends ascend as well.
    new = np.flatnonzero(np.concatenate(([True], ~same | (r[1:, 2] > r[:-1, 3] + 1) | (r[1:, 3] < r[:-1, 3]))))
    return np.column_stack((r[new, :3], r[np.concatenate((new[1:], [len(r)])) - 1, 3]))


def _settle(table: pa.Table) -> pa.Table:
    """Of one part of the open strings: those that repeat an earlier one."""
    hashes, place = [], []
    for data in table.column("data").to_pylist():
        n = len(data) // 40
        hashes.append(np.frombuffer(data, dtype=np.uint64, count=2 * n).reshape(n, 2))
        place.append(np.frombuffer(data, dtype=np.int64, count=3 * n, offset=16 * n).reshape(n, 3))
    h, p = np.concatenate(hashes), np.concatenate(place)
    r = _ranges(p[_earliest(h, p)[1]])
    return pa.table({"doc_id": pa.array(r[:, 0]), "row": pa.array(r[:, 1]), "first": pa.array(r[:, 2]), "last": pa.array(r[:, 3])})


def spans(first: list[int], last: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that strings starting from first to last cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first, last, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + SPAN))
        else:
            out.append((a, b + SPAN))
    return out


def _known_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id (missing ones as _LAST), row (hash of the text), ranges (first, last) of starts of strings that also start earlier."""
    spark = docs.sparkSession
    parts = max(2, partitions(spark))
    rows = docs.select(_known_id().alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    chunks = materialise(anchor_chunks(rows, parts), "suffix-anchors")
    flags = answers(chunks).groupBy("chunk").applyInArrow(tidy_group(_flags), "doc_id long, row long, ordinals binary").distinct()
    # Chunk names are random, so these are a fair sample of all chunks.
    seen = chunks.where("part = -1").select("chunk", "twice").orderBy("chunk").limit(MOST_SAMPLED // SAMPLED).toArrow().column("twice").to_pylist()
    sample = sorted(x[i : i + GRAM] for x in seen for i in range(0, len(x), GRAM))
    splitters = sorted({sample[len(sample) * k // parts] for k in range(1, parts)}) if sample else []
    wanted = rows.join(flags, ["doc_id", "row"]).select("doc_id", "row", "text", "ordinals")
    found = materialise(runs(wanted, splitters), "suffix-runs", free=True)
    release(chunks)
    merged = materialise(found.where("part is not null").groupBy("part").applyInArrow(tidy_group(_merge(parts)), ROWS), "suffix-merged", free=True)
    settled = merged.where("part is not null").groupBy("part").applyInArrow(tidy_group(_settle), "doc_id long, row long, first long, last long")
    known = [x.where("part is null").select("doc_id", "row", "first", "last") for x in (found, merged)]
    out = materialise(settled.unionByName(known[0]).unionByName(known[1]), "suffix-ranges", free=True)
    release(found, merged)
    return out


#: Name of the column that cut adds; none of the documents'.
RANGES = "voltspan suffix ranges"


def cut(docs: DataFrame) -> DataFrame:
    """Adds RANGES, the repeated starts of each row, to docs; null where nothing repeats."""
    d, r, i, w = (f"voltspan suffix {c}" for c in "driw")
    hits = repeated(docs).groupBy(F.col("doc_id").alias(d), F.col("row").alias(r)).agg(F.collect_set(F.struct("first", "last")).alias(RANGES))
    own = docs.withColumns({i: _known_id(), w: F.xxhash64("text")})
    return own.join(hits, (F.col(f"`{i}`") == F.col(f"`{d}`")) & (F.col(f"`{w}`") == F.col(f"`{r}`")), "left").drop(d, r, i, w)


def _kept(raw: bytes, ranges: list[dict] | None) -> tuple[bytes, int]:
    if not ranges:
        return raw, 0
    gone = spans([r["first"] for r in ranges], [r["last"] for r in ranges])
    out, at = [], 0
    for a, b in gone:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]), len(gone)


def dedup(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw, ranges in zip(as_bytes(batch.column("text")), batch.column(RANGES).to_pylist(), strict=True):
                kept, n = _kept(raw, ranges)
                rows.append((len(raw), len(raw) - len(kept), n, hashlib.sha256(kept).hexdigest()))
            a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "text", RANGES).mapInArrow(tidy(run), SCHEMA)


def removed_text(docs: DataFrame) -> DataFrame:
    """docs with repeated bytes cut out of text; what is left of a character that was cut in two goes."""

    def run(raw_texts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in raw_texts:
            texts = [None if t is None else _kept(raw, ranges)[0].decode("utf-8", "ignore") for t, raw, ranges in zip(batch.column("text"), as_bytes(batch.column("text")), batch.column(RANGES).to_pylist(), strict=True)]
            at = batch.schema.get_field_index("text")
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)][:-1]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return cut(docs).select(*docs.columns, RANGES).mapInArrow(tidy(run), docs.schema)
