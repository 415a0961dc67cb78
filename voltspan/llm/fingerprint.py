"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for each i, the polynomial of its first i code points modulo the prime 2 ** 61 - 1. Two
entries give the hash of any span, so span equality is one comparison and a longest common extension a binary search.

A fingerprint keeps a part of those arrays: the text's length, its whole hash under two bases, prefix hashes on a grid of at most STEPS
places from the text's beginning and suffix hashes on one from its end, and the least hashes of its distinct
spans. Of two fingerprints, binary search on the grids locates the longest common extension from both beginnings and from
both ends, and the span samples estimate the share of spans in common wherever they stand; the likeness is the greater.

Null text: empty; two empty texts have likeness 1, an empty and another one 0. A text shorter than a span is one span, and
its grid has every place. Rows that repeat a doc_id follow each other in order of text; rows without one come last, in order
of text. An empty table gives an empty result; in a table of one document, the next document is itself. Further columns are
not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.llm._blocks import minus, mix, prime_powers, prime_prefixes, prime_whole, times
from voltspan.llm._io import partitions

SPAN, SAMPLE, STEPS = 12, 64, 32
#: Drawn at random, once.
BASES = (1_592_653_589_793_238_463, 2_141_897_110_332_645_907)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class PrefixHash:
    """Prefix array of one text. A span's hash is moved to the text's beginning, so equal spans have equal ones."""

    def __init__(self, text: str, base: int = BASES[0]):
        values = codes(text).astype(np.uint64) + np.uint64(1)
        self.n, self.base = len(text), base
        self.sums = prime_prefixes(values, base)
        self.inverse = pow(base, -1, (1 << 61) - 1)

    def span(self, start: np.ndarray | int, length: np.ndarray | int) -> np.ndarray:
        """Hash of the spans that begin at start."""
        start = np.atleast_1d(start)
        return times(minus(self.sums[start + length], self.sums[start]), prime_powers(self.inverse, self.n)[start])

    def same(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether two spans are equal."""
        return bool(self.span(i, length)[0] == other.span(j, length)[0])

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension of self from i and other from j."""
        return longest(min(self.n - i, other.n - j), lambda n: self.same(i, other, j, n))


def longest(most: int, same) -> int:
    """The greatest n up to most for which same(n) holds; it holds for all lesser ones as well, and for 0."""
    low, high = 0, most
    while low < high:
        middle = (low + high + 1) // 2
        if same(middle):
            low = middle
        else:
            high = middle - 1
    return low


class Fingerprint:
    """What is kept of a text: n, step of the grids, whole hashes, prefix and suffix hashes on the grids, least span hashes."""

    def __init__(self, text: str):
        hashed = PrefixHash(text)
        self.n = hashed.n
        self.whole = (int(hashed.sums[-1]), prime_whole(codes(text).astype(np.uint64) + np.uint64(1), BASES[1]))
        # A power of two, so that of any two grids one holds the other's places.
        self.step = 1 << max(0, (self.n - 1) // STEPS).bit_length()
        at = np.arange(self.step, self.n + 1, self.step)
        self.heads = _short(hashed.sums[at])
        self.tails = _short(hashed.span(self.n - at, at)) if len(at) else at.astype(np.uint32)
        length = min(SPAN, self.n)
        spans = mix(hashed.span(np.arange(self.n - length + 1), length)) if length else np.empty(0, dtype=np.uint64)
        # Repeated spans count once; taking some more than needed first spares sorting them all.
        take = 4 * SAMPLE
        if len(spans) > 4 * take:
            least = np.unique(np.partition(spans, take)[:take])
            spans = least if len(least) >= SAMPLE else spans
        self.spans = (np.unique(spans)[:SAMPLE] >> np.uint64(32)).astype(np.uint32)

    def __str__(self) -> str:
        part = lambda x: x.astype(">u4").tobytes().hex()
        return f"{self.n:x}.{self.whole[0]:016x}{self.whole[1]:016x}.{part(self.heads)}.{part(self.tails)}.{part(self.spans)}"

    def like(self, other: Fingerprint) -> float:
        """0 to 1: twice what is in common over all of both."""
        if (self.n, self.whole) == (other.n, other.whole):
            return 1.0
        if not self.n or not other.n:
            return 0.0
        step, least = max(self.step, other.step), min(self.n, other.n)
        stride = step // self.step, step // other.step
        common = 0
        for a, b in ((self.heads, other.heads), (self.tails, other.tails)):
            a, b = a[stride[0] - 1 :: stride[0]], b[stride[1] - 1 :: stride[1]]
            common += step * longest(min(len(a), len(b)), lambda n, a=a, b=b: n == 0 or a[n - 1] == b[n - 1])
        by_extension = 2 * min(common, least) / (self.n + other.n)
        # The least of the union are a fair sample of it where neither side ran out of its own sample.
        union = np.union1d(self.spans, other.spans)[:SAMPLE]
        jaccard = np.isin(np.intersect1d(self.spans, other.spans), union).sum() / len(union)
        return float(min(max(by_extension, 2 * jaccard / (1 + jaccard)), 1 - 1e-9))


def _short(x: np.ndarray) -> np.ndarray:
    return (mix(x) >> np.uint64(32)).astype(np.uint32)


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _landing(spark, n: int) -> np.ndarray:
    """For each of n shuffle partitions, a number that a hash exchange sends there; so parts are dealt out evenly."""
    seen = spark.range(40 * n + 200).select("id", F.expr(f"pmod(hash(id), {n})").alias("to")).groupBy("to").agg(F.min("id").alias("id")).collect()
    found = {r["to"]: r["id"] for r in seen}
    return np.array([found.get(i, -1 - i) for i in range(n)], dtype=np.int64)


class _Parts:
    """Ranges of rows in descending order of (whether there is a doc_id, doc_id, hash of the text)."""

    def __init__(self, cuts: list[tuple]):
        self.cuts = np.array(cuts, dtype=np.int64).reshape(-1, 3)
        self.heads: dict[int, tuple] = {}
        self.before: dict[int, int] = {}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """How many cuts are no greater than each key."""
        every = np.concatenate((self.cuts, keys))
        mine = np.concatenate((np.zeros(len(self.cuts), dtype=np.int64), np.ones(len(keys), dtype=np.int64)))
        order = np.lexsort((mine, every[:, 2], every[:, 1], every[:, 0]))
        out = np.empty(len(every), dtype=np.int64)
        out[order] = np.cumsum(1 - mine[order])
        return out[len(self.cuts) :]

    def guests(self, keys: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The part that a row also goes to, as the one behind its last; -1 for most rows."""
        out = np.full(len(part), -1, dtype=np.int64)
        for p in np.unique(part).tolist():
            out[(part == p) & (keys == np.array(self.heads[p])).all(axis=1)] = self.before[p]
        return out


def _keys(table: pa.RecordBatch) -> np.ndarray:
    return np.stack([table.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("known", "at", "tie")], axis=1)


def _ranked(docs: DataFrame) -> DataFrame:
    """doc_id, text, known, at, tie, part, follower, in descending order within the tasks; follower 1: a row that only stands
    behind a part's last one."""
    spark = docs.sparkSession
    n = max(2, partitions(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"known": F.col("doc_id").isNotNull().cast("long"), "at": F.coalesce("doc_id", F.lit(0)), "tie": F.xxhash64("text")})
    keys = rows.select("known", "at", "tie")
    # A sample of bounded size; it only places the borders of the parts.
    rate = min(1.0, 40 * n / max(1, rows.count()))
    sampled = sorted(tuple(r) for r in keys.where(F.pmod(F.xxhash64("at", "tie", F.lit(5)), F.lit(1 << 20)) < rate * (1 << 20)).collect())
    parts = _Parts(sorted({sampled[len(sampled) * i // n] for i in range(1, n)}) if sampled else [])

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, tuple] = {}
        for batch in batches:
            key = _keys(batch)
            part = parts.of(key)
            order = np.lexsort((key[:, 2], key[:, 1], key[:, 0], part))
            last = order[np.append(part[order][1:] != part[order][:-1], True)] if len(order) else order
            for i in last.tolist():
                p, k = int(part[i]), tuple(key[i].tolist())
                most[p] = max(most.get(p, k), k)
        yield pa.RecordBatch.from_arrays([pa.array([x for x in c], pa.int64()) for c in (most, *zip(*most.values(), strict=True))] if most else [pa.array([], pa.int64())] * 4, names=["part", "known", "at", "tie"])

    found = keys.mapInArrow(least, "part long, known long, at long, tie long").groupBy("part").agg(F.max(F.struct("known", "at", "tie")).alias("head"))
    parts.heads = {r["part"]: tuple(r["head"]) for r in found.collect()}
    order = sorted(parts.heads, reverse=True)
    # A part's first row also goes to the part before it; the table's first one behind the last.
    parts.before = {p: order[i - 1] for i, p in enumerate(order)}
    landing = spark.sparkContext.broadcast((parts, _landing(spark, n)))

    def deal(known: pd.Series, at: pd.Series, tie: pd.Series) -> pd.DataFrame:
        parts, landing = landing_of()
        key = np.stack([known, at, tie], axis=1).astype(np.int64)
        part = parts.of(key)
        guest = parts.guests(key, part)
        to = lambda x: np.where(x < 0, -1, landing[np.maximum(x, 0) % len(landing)])
        return pd.DataFrame({"part": part, "key": to(part), "guest": guest, "guest_key": to(guest)})

    def landing_of():
        return landing.value

    dealt = rows.withColumn("d", F.pandas_udf(deal, "part long, key long, guest long, guest_key long")("known", "at", "tie"))
    own = F.struct(F.col("d.part").alias("part"), F.col("d.key").alias("key"), F.lit(0).alias("follower"))
    guest = F.struct(F.col("d.guest").alias("part"), F.col("d.guest_key").alias("key"), F.lit(1).alias("follower"))
    both = dealt.withColumn("p", F.explode(F.when(F.col("d.guest") >= 0, F.array(own, guest)).otherwise(F.array(own))))
    both = both.select("doc_id", "text", "known", "at", "tie", "p.part", "p.key", "p.follower")
    return both.repartition(n, "key").sortWithinPartitions("part", "follower", F.col("known").desc(), F.col("at").desc(), F.col("tie").desc(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> fingerprints of each text and of it with the next document's beginning at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        last = None

        def close(following: str, found: Fingerprint) -> None:
            doc_id, text, own = last
            new = edited(text, following)
            after = Fingerprint(new)
            out.append((doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), str(own), str(after), own.like(after), own.like(found)))

        for batch in batches:
            for doc_id, text, follower in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "follower")), strict=True):
                if follower and last is None:
                    continue
                found = Fingerprint(text)
                if last is not None:
                    close(text, found)
                last = None if follower else (doc_id, text, found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])
                out.clear()

    return _ranked(docs).select("doc_id", "text", "follower").mapInArrow(run, SCHEMA)
