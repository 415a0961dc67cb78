"""Best-fit decreasing packing with a segment tree over remaining capacities.

Best-fit decreasing depends on lengths alone, and there are at most `capacity` of them. So the driver packs the histogram
of lengths, never the documents: bins of equal content form a run of sequence ids, and a segment tree over capacities
finds the tightest open run for each group of equal pieces. Items of equal length go to the same bin until it is too full,
as they would one by one: a bin that just took an item is the tightest one that fits the next. The plan says which ranks
of a length go to which sequences; pieces are ranked within their length in shards, so a length that a third of all
pieces share is never in one task. The packing is the exact global one, at any size.

Null text: empty. An empty text is one piece with the end token alone. Rows that repeat a doc_id are packed as documents
of their own. An empty table gives no pieces. Further columns are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltspan.llm._io import materialise

CAPACITY, END_ID = 1024, 2
#: Ranks within a length are counted in this many shards.
SHARDS = 256
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of the vocabulary in a file for `tokenizers`.

    The same vocabulary stands beside it as ranks; tiktoken then gives equal ids in a fifth of the time. Texts that
    contain the special token go through `tokenizers` itself, as do all if the ranks are missing.
    """

    def __init__(self, json_path: str, ranks_path: str | None, pattern: str | None):
        import base64

        from tokenizers import Tokenizer

        self.slow, self.fast = Tokenizer.from_file(json_path), None
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or SPECIAL in text:
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def public_encoder() -> Encoder:
    import public_tokenizers

    return Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def pieces(docs: DataFrame, encoder=public_encoder, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most capacity tokens; of a cut document, the first piece holds what is left over."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
                at, to = 0, len(ids) % capacity or capacity
                for k in range(-(-len(ids) // capacity)):
                    rows.append((doc_id, k, at, to - at, zlib.crc32(ids[at:to].tobytes())))
                    at, to = to, to + capacity
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECES)


class CapacityTree:
    """A segment tree over remaining capacities; each leaf holds the runs of open bins with that capacity left."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def put(self, left: int, first: int, count: int) -> None:
        self.runs[left].append((first, count))
        i = left + self.size
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def pop(self, left: int) -> tuple[int, int]:
        run = self.runs[left].pop()
        i = left + self.size
        if not self.runs[left]:
            self.any[i] = 0
            while i > 1 and not self.any[i] | self.any[i ^ 1]:
                i >>= 1
                self.any[i] = 0
        return run

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least `least` that an open bin has left."""
        i = least + self.size
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit decreasing over a histogram: for each length, (first rank, first sequence, pieces a sequence, offset).

    From its first rank on, an entry gives `pieces a sequence` consecutive ranks to each of consecutive sequences.
    """
    tree, out, bins = CapacityTree(capacity), {}, 0
    for length in sorted(counts, reverse=True):
        rank, todo, entries = 0, counts[length], []
        while todo:
            left = tree.tightest(length)
            if left is None:
                first, left = bins, capacity
                each = min(todo, capacity // length)
                count = todo // each
                bins += count
            else:
                first, count = tree.pop(left)
                each = min(todo, left // length)
                if (use := min(count, todo // each)) < count:
                    tree.put(left, first + use, count - use)
                    count = use
            entries.append((rank, first, each, capacity - left))
            rank, todo = rank + each * count, todo - each * count
            tree.put(left - each * length, first, count)
        out[length] = entries
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32)."""
    cut = materialise(cut, "packing-pieces")
    cut = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SHARDS)))
    cells = cut.groupBy("length", "shard").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = cells.select(F.col("length").alias("_l"), F.col("shard").alias("_s"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    # At most `capacity` rows reach the driver, however many documents there are.
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    entries = {length: ([e[0] for e in found], found) for length, found in plan(counts, capacity).items()}
    inside = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("in_shard", F.row_number().over(inside) - 1)
    ranked = ranked.join(bases, (F.col("length") == F.col("_l")) & (F.col("shard") == F.col("_s"))).withColumn("rank", F.col("base") + F.col("in_shard"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist(), strict=True):
                ranks, found = entries[length]
                first_rank, first, each, at = found[bisect_right(ranks, rank) - 1]
                k, j = divmod(rank - first_rank, each)
                sequence.append(first + k)
                offset.append(at + j * length)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, PIECES + ", sequence_id long, offset long")
