"""Product quantisation of integer vectors by Hamerly's form of Lloyd's algorithm.

Each vector is cut into consecutive parts, and each part position has a codebook of its own. For each part of each vector the
table of a round keeps its entry, an upper bound of the distance to that entry, and a lower bound of the distance to the
second nearest. Bounds move with the entries. While the upper bound stays strictly below the lower one, the entry is the only
nearest one, and no distance is computed; else the upper bound is made exact, and if it still is not strictly below, all
entries are scanned in integers and the first of the nearest is taken. Bounds are rounded outwards, so they never lie.

A round reads the last round's table once and writes its own: vectors, entries, bounds, and a row a task with the sums and
numbers of parts by entry, which the driver adds up (as many numbers as the codebooks have). So a lost executor repeats one
round's tasks.

Vectors that are null or hold a null or non-finite component are left out. Repeated rows count as often as they stand there;
of rows that share an id the lesser vector comes first among the starts, and a null id comes last. Vectors that are shorter
than the longest, or than the next multiple of the number of parts, count as filled up with zeros. Fewer vectors than entries
give as many entries, none an empty result. Components are cut at `bound`, so that every error fits into a long (2 ** 27 for
64 of them). Labels of null share a sum. Further columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.llm._io import materialise, release, tidy
from voltspan.llm._skew import join_counted
from voltspan.llm._vectors import bound, distances, finite, lists, matrix, whole

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SCHEMA = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
_STATE = "vec_id long, label string, q array<int>, code array<tinyint>, upper array<float>, lower array<float>, error long, sums array<bigint>"
#: Far more than the rounding of a double's root and sum.
_SLACK = 1e-12
_LONGEST = (1 << 63) - 1


def _up(x: np.ndarray) -> np.ndarray:
    """Floats of single precision that are not below x."""
    y = (x := x * (1 + _SLACK)).astype(np.float32)
    return np.where(y < x, np.nextafter(y, np.float32(np.inf)), y)


def _down(x: np.ndarray) -> np.ndarray:
    y = (x := np.maximum(x, 0) * (1 - _SLACK)).astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(0)), y)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first nearest entry, upper, lower) of one part of each vector, by all distances."""
    d = distances(x, entries)
    code = d.argmin(1)
    best = d[np.arange(len(x)), code]
    if len(entries) == 1:
        return code, _up(np.sqrt(best.astype(np.float64))), np.full(len(x), np.inf, dtype=np.float32)
    return code, _up(np.sqrt(best.astype(np.float64))), _down(np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64)))


def moved(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry how far it has moved, and how far the farthest of the others has."""
    way = np.sqrt(((new - old).astype(np.float64) ** 2).sum(1)) * (1 + _SLACK)
    first = int(way.argmax())
    others = np.full(len(way), way[first])
    others[first] = np.delete(way, first).max(initial=0.0)
    return way, others


def settle(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, upper, lower, number of full scans) after the entries moved from old to new."""
    way, others = moved(old, new)
    upper, lower = _up(upper.astype(np.float64) + way[code]), _down(lower.astype(np.float64) - others[code])
    code = code.copy()
    open_ = np.flatnonzero(~(upper < lower))
    own = ((x[open_] - new[code[open_]]) ** 2).sum(1)
    upper[open_] = _up(np.sqrt(own.astype(np.float64)))
    open_ = open_[~(upper[open_] < lower[open_])]
    if len(open_):
        code[open_], upper[open_], lower[open_] = scan(x[open_], new)
    return code, upper, lower, len(open_)


def _totals(q: np.ndarray, code: np.ndarray, entries: int) -> np.ndarray:
    """Numbers and component sums of parts by position and entry."""
    n, parts, width = q.shape
    out = np.zeros((parts, entries, 1 + width), dtype=np.int64)
    for p in range(parts):
        out[p, :, 0] = np.bincount(code[:, p], minlength=entries)
        order = np.argsort(code[:, p], kind="stable")
        there = np.flatnonzero(out[p, :, 0])
        if len(there):
            out[p, there, 1:] = np.add.reduceat(q[order, p], np.concatenate(([0], np.cumsum(out[p, there, 0])[:-1])), axis=0)
    return out


def _step(state: DataFrame, old: np.ndarray | None, books: np.ndarray, last: bool) -> DataFrame:
    """The table of a round. old: the codebooks of the round before; None at first."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, scans = np.zeros((parts, entries, 1 + width), dtype=np.int64), 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            q = matrix(b.column("q")).reshape(n, parts, width)
            code = np.zeros((n, parts), dtype=np.int64)
            upper, lower = np.zeros((n, parts), dtype=np.float32), np.zeros((n, parts), dtype=np.float32)
            if old is not None:
                code, upper, lower = matrix(b.column("code")), matrix(b.column("upper"), np.float32).copy(), matrix(b.column("lower"), np.float32).copy()
                code = code.copy()
            for p in range(parts):
                if old is None:
                    code[:, p], upper[:, p], lower[:, p] = scan(q[:, p], books[p])
                    scans += n
                else:
                    code[:, p], upper[:, p], lower[:, p], more = settle(q[:, p], code[:, p], upper[:, p], lower[:, p], old[p], books[p])
                    scans += more
            error = sum(((q[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts)) if last else None
            total += _totals(q, code, entries)
            none = lambda kind: pa.nulls(n, kind)  # noqa: B023,E731
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id"), b.column("label"), none(pa.list_(pa.int32())) if last else b.column("q"), lists(code.astype(np.int8), pa.int8()),
                    none(pa.list_(pa.float32())) if last else lists(upper, pa.float32()), none(pa.list_(pa.float32())) if last else lists(lower, pa.float32()),
                    pa.array(error, pa.int64()) if last else none(pa.int64()), none(pa.list_(pa.int64())),
                ],
                names,
            )
        sums = pa.array([[*total.reshape(-1).tolist(), scans]], pa.list_(pa.int64()))
        kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.float32()), pa.list_(pa.float32()), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.nulls(1, k) for k in kinds] + [sums], names)

    names = [x.split()[0] for x in _STATE.split(", ")]
    return state.mapInArrow(tidy(run), _STATE)


def _added(state: DataFrame) -> np.ndarray:
    """Sums over the tasks' rows, in Python's integers; the last is the number of full scans."""
    rows = state.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).orderBy("at").collect()
    return np.array([int(r.x) for r in rows], dtype=object)


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, label, code, error of each vector; codebooks by part, entry and place; full scans of each round).

    vectors (vec_id, embedding, label)."""
    kept = vectors.where(finite("embedding"))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = max(1, -(-longest // parts))
    padded = F.concat(F.col("embedding").cast("array<double>"), F.array_repeat(F.lit(0.0), F.lit(parts * width) - F.size("embedding")))
    base = kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), padded.alias("x"))
    base = base.select("vec_id", "label", whole("x", scale, bound(parts * width)).cast("array<int>").alias("q"))
    state = materialise(base, "codes-vectors")
    starts = state.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).collect()
    if not starts:
        return state.select("vec_id", "label", F.lit(None).cast("array<tinyint>").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, width), dtype=np.int64), []
    books = np.array([r.q for r in starts], dtype=np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    old, scans = None, []
    for r in range(rounds + 1):
        new = materialise(_step(state.where("sums is null") if r else state, old, books, r == rounds), "codes-round")
        release(state)
        state, added = new, _added(new)
        scans.append(added[-1])
        if r < rounds:
            old, total = books, added[:-1].reshape(parts, -1, 1 + width)
            books = old.copy()
            for p, e in zip(*np.nonzero(total[:, :, 0] > 0), strict=True):
                books[p, e] = [x // total[p, e, 0] for x in total[p, e, 1:]]
    return state.where("sums is null").select("vec_id", "label", "code", "error"), books, scans


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """SCHEMA for vectors (vec_id, embedding, label)."""
    coded, books, _ = train(vectors, parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    hexed = F.array_join(F.transform("code", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    # A label that is null has a key of its own.
    coded = coded.select("vec_id", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), "label")).alias("_key"), hexed.alias("code"), "error")
    sums = coded.groupBy("_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"), F.count("*").alias("_n"))
    sums = materialise(sums.select("_key", "_n", F.least("s", F.lit(_LONGEST).cast("decimal(38,0)")).cast("long").alias("label_error")), "codes-labels")
    total = sums.agg(F.sum("_n")).first()[0] or 0
    return join_counted(coded, sums, "_key", "vec_id", "_n", total).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
