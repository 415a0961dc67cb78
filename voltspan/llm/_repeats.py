"""Which of many hashes occur twice in the corpus, asked chunk by chunk.

A chunk sends each part its distinct hashes of that part once, and gets back one bit each. A hash that stands in every
document crosses the exchange once a chunk, and no document crosses it at all.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.llm._io import tidy_group

CHUNKS = "chunk string, part int, hashes binary, twice binary, docs binary"
_TYPES = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
_NAMES = [x.split()[0] for x in CHUNKS.split(", ")]


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def ask(hashes: np.ndarray, docs: pa.Table, parts: int, note: bytes = b"") -> pa.RecordBatch:
    """Rows of a chunk: one (part -1) with its documents and where each hash stands among the distinct ones, one a part."""
    kinds, inverse, n = np.unique(hashes, return_inverse=True, return_counts=True)
    part = (kinds % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    place = np.empty(len(kinds), dtype="<i4")
    place[order] = np.arange(len(kinds), dtype="<i4")
    kinds, n, part = kinds[order], n[order], part[order]
    chunk = uuid.uuid4().hex
    rows = [(chunk, -1, place[inverse].tobytes(), note, _ipc(docs))]
    edge = np.searchsorted(part, np.arange(parts + 1))
    for p in range(parts):
        if edge[p] < edge[p + 1]:
            rows.append((chunk, p, kinds[edge[p] : edge[p + 1]].tobytes(), np.packbits(n[edge[p] : edge[p + 1]] > 1).tobytes(), b""))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _answer(table: pa.Table) -> pa.Table:
    """Of one part: for each chunk, whether each of its hashes occurs twice in the corpus."""
    hashes = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
    twice = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(h)) for x, h in zip(table.column("twice").to_pylist(), hashes, strict=True)]
    kinds, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    n = np.bincount(inverse, weights=1.0 + np.concatenate(twice), minlength=len(kinds))
    back = np.split((n > 1)[inverse], np.cumsum([len(x) for x in hashes])[:-1])
    return pa.table({
        "chunk": table.column("chunk"),
        "part": table.column("part"),
        "repeats": pa.array([np.packbits(x).tobytes() for x in back], pa.binary()),
        "count": pa.array([len(x) for x in back], pa.int64()),
    })


def answers(chunks: DataFrame) -> DataFrame:
    """Rows to group by chunk: the chunk's own one and the parts' answers."""
    none = F.lit(None).cast("binary")
    repeats = chunks.where("part >= 0").select("chunk", "part", "hashes", "twice").groupBy("part").applyInArrow(tidy_group(_answer), "chunk string, part int, repeats binary, count long")
    own = chunks.where("part = -1").select("chunk", "part", none.alias("repeats"), F.lit(None).cast("long").alias("count"), "hashes", "docs")
    return repeats.select("chunk", "part", "repeats", "count", none.alias("hashes"), none.alias("docs")).unionByName(own)


def hits(table: pa.Table) -> tuple[np.ndarray, pa.Table]:
    """Of one chunk of answers: for each hash that it asked about, whether it repeats; its documents."""
    parts = table.column("part").to_pylist()
    own = parts.index(-1)
    order = [i for i in sorted(range(len(parts)), key=parts.__getitem__) if i != own]
    bits = [np.unpackbits(np.frombuffer(table.column("repeats")[i].as_py(), dtype=np.uint8), count=table.column("count")[i].as_py()) for i in order]
    repeats = np.concatenate(bits) if bits else np.empty(0, dtype=np.uint8)
    return repeats[np.frombuffer(table.column("hashes")[own].as_py(), dtype="<i4")].astype(bool), pa.ipc.open_stream(table.column("docs")[own].as_py()).read_all()
