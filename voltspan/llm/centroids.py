"""Lloyd's clustering of integer vectors on weighted distinct vectors.

1. Kept vectors become integers; equal ones are one row with a multiplicity (counted map-side first, so a vector that holds a
   third of all rows crosses the exchange once a task).
2. A round assigns each distinct vector to its nearest centroid, exactly, and sums up components times multiplicity in
   integers: a task sends one row a centroid and component, and the driver gets as many rows in all.
3. After the last round distinct vectors are assigned once more, and the assignments are joined back to the ids. Rows of a
   vector that many share are dealt over several tasks.

Vectors that are null, of another length, or hold a null or a non-finite component are left out. A repeated row counts as often
as it stands there; rows that share an id are vectors of their own, and a null id is kept and comes last in the choice of
starts. With equal hashes the lesser vector starts first, with equal distances the centroid of smaller number is taken. Fewer
vectors than centroids give as many centroids, none an empty result. Components are cut at `bound` (2 ** 27 for 64 of them),
so that every squared distance fits into a long; inertias stop at the largest long. Further columns are not looked at.
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

DIMS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, multiplicity long"
_SUMS = "cluster int, part int, total decimal(38,0)"
_LONGEST = (1 << 63) - 1


def weighted_sums(q: np.ndarray, weight: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """For each centroid its vectors' number, and their components' sums, in Python's integers."""
    out = np.zeros((k, 1 + q.shape[1]), dtype=object)
    rows = np.column_stack((np.ones(len(q), dtype=np.int64), q))
    if len(q) and int(np.abs(rows).max()) * int(weight.max()) * len(q) > _LONGEST // 2:
        rows, weight = rows.astype(object), weight.astype(object)
    rows = rows * weight[:, None]
    for j in np.unique(cluster):
        out[j] = rows[cluster == j].sum(0).astype(object)
    return out


def _nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(q, centroids)
    at = d.argmin(1)
    return at, d[np.arange(len(q)), at]


def _round(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after the distinct vectors' assignment and mean."""
    k, dims = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dims + 1), dtype=object)
        for b in batches:
            if b.num_rows:
                q = matrix(b.column("q"))
                total = total + weighted_sums(q, b.column("weight").to_numpy(), _nearest(q, centroids)[0], k)
        used = np.flatnonzero(total[:, 0] > 0)
        flat = [int(x) for x in total[used].reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, dims + 1), pa.int32()), pa.array(np.tile(np.arange(dims + 1), len(used)), pa.int32()), pa.array(flat, pa.decimal128(38, 0))], ["cluster", "part", "total"])

    found = distinct.select("q", "weight").mapInArrow(tidy(sums), _SUMS).groupBy("cluster", "part").agg(F.sum("total").alias("total"))
    table = {(r[0], r[1]): int(r[2]) for r in found.collect()}
    new = centroids.copy()
    for j in range(k):
        if (j, 0) in table:
            new[j] = [table[j, p + 1] // table[j, 0] for p in range(dims)]
    return new


def _assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                q = matrix(b.column("q"))
                cluster, distance = _nearest(q, centroids)
                yield pa.RecordBatch.from_arrays([lists(q, pa.int64()), b.column("weight"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], ["q", "weight", "cluster", "distance"])

    return distinct.mapInArrow(tidy(assign), "q array<bigint>, weight long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: str = "1:") -> DataFrame:
    """SCHEMA for vectors (vec_id, embedding); the k starts are the kept vectors of least sha256 of seed and id."""
    spark = vectors.sparkSession
    kept = vectors.where((F.size("embedding") == dims) & finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), whole("embedding", scale, bound(dims)).alias("q"))
    kept = materialise(kept, "centroid-vectors")
    distinct = materialise(kept.groupBy("q").agg(F.count("*").alias("weight")), "centroid-distinct")
    hashed = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    starts = kept.orderBy(hashed.asc_nulls_last(), "q").limit(k).collect()
    if not starts:
        return spark.createDataFrame([], SCHEMA)
    centroids = np.array([r.q for r in starts], dtype=np.int64)
    for _ in range(rounds):
        centroids = _round(distinct, centroids)
    assigned = materialise(_assigned(distinct, centroids), "centroid-assigned")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    inertia = {r[0]: (int(r[1]), r[2]) for r in assigned.groupBy("cluster").agg(F.sum(wide("weight") * wide("distance")), F.sum("weight")).collect()}
    every, n = min(_LONGEST, sum(i for i, _ in inertia.values())), sum(c for _, c in inertia.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # One row a centroid.
    of = F.broadcast(spark.createDataFrame([(j, min(_LONGEST, i), every, digest[j]) for j, (i, _) in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    release(distinct)
    out = join_counted(kept, assigned, "q", "vec_id", "weight", n).join(of, "cluster")
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", F.col("weight").alias("multiplicity"))
