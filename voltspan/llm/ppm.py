"""Language-model scores by prediction by partial matching over bytes.

A pretrained trie of byte contexts holds the training texts' counts up to ORDER bytes. A symbol's probability blends the
orders by escape estimation (method C: as many escapes as distinct symbols) with exclusion: what a longer context has seen
no longer counts in shorter ones. Bytes and an end symbol are coded; a text's code length is the sum over its symbols.

The trie is never in one place and nothing of it is left out. Chunks of documents send their distinct grams (ORDER bytes
and the symbol after them) to parts, which add up the corpus counts. Grams whose last three context bytes agree then meet
in one task, where all their contexts of three bytes and more are complete; counts of shorter contexts are broadcast (at
most 2 ** 24 entries, since there are no more three-byte strings). So each distinct gram is coded once, and each chunk gets
back the code lengths of the grams it sent.

A word unigram with add-one smoothing stands beside it. Its counts cover the whole corpus and take the same way: a word
that stands in every document crosses the exchange once a chunk.

Null text: empty; it has the end token and the end symbol alone. Rows that repeat a doc_id get a row each. Without
training rows all counts are 0 and bytes are equally likely. An empty table gives an empty result. Further columns are not
looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.llm._blocks import Block, blocks, mix
from voltspan.llm._io import materialise, partitions
from voltspan.llm.langid import held_out

ORDER = 5
#: Context bytes whose grams meet in one task; shorter contexts are broadcast.
MEET = 3
CHUNK = 8 << 20
SLICE = 1 << 20
#: Bytes that no UTF-8 text holds.
START, END = 0xFE, 0xFF
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, sum_log double, score double"


def _grams(block: Block) -> Iterator[tuple[int, np.ndarray]]:
    """Codes of ORDER + 1 bytes that end at each byte of the texts and at their ends: slices, and where they start."""
    buf = np.concatenate((np.full(ORDER, START, np.uint8), block.buf))
    buf[block.end + ORDER] = END
    for first in range(0, len(block.buf), SLICE):
        last = min(first + SLICE, len(block.buf))
        padded = buf[first : last + ORDER].astype(np.uint64)
        code = np.zeros(last - first, dtype=np.uint64)
        for k in range(ORDER + 1):
            code = (code << np.uint64(8)) | padded[k : k + len(code)]
        # The first bytes of a text (and the END of a short one) see START where the array has the text before.
        for k in range(ORDER):
            at = block.start + k
            at = at[(at <= block.end) & (first <= at) & (at < last)] - first
            keep = np.uint64((1 << (8 * (k + 1))) - 1)
            fill = np.uint64(sum(START << (8 * j) for j in range(k + 1, ORDER + 1)))
            code[at] = (code[at] & keep) | fill
        yield first, code


def _low(code: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes of each code."""
    return code & np.uint64((1 << (8 * k)) - 1)


def _sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, weights=n, minlength=len(found))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, and whether each is there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def code_lengths(code: np.ndarray, n: np.ndarray, short: np.ndarray, short_n: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each code after the bytes before it.

    code, n: distinct grams and how often training has them (0: never), with all grams of each context of MEET bytes.
    short, short_n: training counts of all grams of MEET bytes.
    """
    met = n > 0
    grams, counts = [], []
    for k in range(ORDER + 1):
        source = (short, short_n) if k < MEET else (code[met], n[met])
        key, total = _sums(_low(source[0], k + 1), source[1])
        grams.append(key)
        counts.append(total)
    contexts, total, kinds = [], [], []
    for k in range(ORDER + 1):
        key, inverse = np.unique(grams[k] >> np.uint64(8), return_inverse=True)
        contexts.append(key)
        total.append(np.bincount(inverse, weights=counts[k], minlength=len(key)))
        kinds.append(np.bincount(inverse, minlength=len(key)).astype(float))
    # What the symbols that a context has seen count in the next shorter one. All of them are there.
    gone = [np.zeros(0)]
    for k in range(1, ORDER + 1):
        at, _ = _find(grams[k - 1], _low(grams[k], k))
        inverse = np.searchsorted(contexts[k], grams[k] >> np.uint64(8))
        gone.append(np.bincount(inverse, weights=counts[k - 1][at] if len(at) else None, minlength=len(contexts[k])))
    out, waits = np.zeros(len(code)), np.ones(len(code), dtype=bool)
    longer: tuple[np.ndarray, np.ndarray] | None = None
    for k in range(ORDER, -1, -1):
        at, there = _find(contexts[k], _low(code >> np.uint64(8), k))
        left, symbols = np.zeros(len(code)), np.zeros(len(code))
        left[there], symbols[there] = total[k][at[there]], kinds[k][at[there]]
        if longer is not None:
            above, hit = longer
            left[hit] -= gone[k + 1][above[hit]]
            symbols[hit] -= kinds[k + 1][above[hit]]
        place, seen = _find(grams[k], _low(code, k + 1))
        now = waits & seen
        out[now] += np.log10(counts[k][place[now]] / (left[now] + symbols[now]))
        waits &= ~seen
        escapes = waits & (left > 0)
        out[escapes] += np.log10(symbols[escapes] / (left[escapes] + symbols[escapes]))
        longer = at, there
    # What no context has seen is equally likely; START is never coded.
    out[waits] -= np.log10(255 - len(grams[0]))
    return out


WORDS = "chunk string, part int, hashes binary, counts binary, grams binary, learnt binary, docs binary"


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def _by_part(code: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of distinct sorted codes by part, then by code, and where each part starts in it."""
    part = (mix(code) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _pack(code: np.ndarray) -> bytes:
    """Sorted codes as differences, byte plane by byte plane, which compresses well."""
    return np.diff(code, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, : ORDER + 1].T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(ORDER + 1, len(data) // (ORDER + 1))
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : ORDER + 1] = planes.T
    return np.cumsum(out.view(np.uint64).ravel(), dtype=np.uint64)


def chunks_of(docs: DataFrame, parts: int) -> DataFrame:
    """For each chunk of documents a row with them (part -1), and a row for each part of its distinct words and grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        grams: list[tuple] = []

        def merge() -> None:
            grams[:] = [_sums(np.concatenate([x[0] for x in grams]), np.concatenate([x[1] for x in grams]))]

        def flush() -> Iterator[pa.RecordBatch]:
            words, inverse = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            counts = np.bincount(inverse, weights=np.concatenate([x[1] for x in held]), minlength=len(words)).astype("<i4")
            # By part, then by hash: the order in which the totals come back.
            part = (words % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            words, counts, part = words[order], counts[order], part[order]
            merge()
            code, learnt = grams[0]
            order, gram_edge = _by_part(code, parts)
            code, learnt = code[order], learnt[order].astype("<i4")
            table = pa.table({"doc_id": pa.concat_arrays([x[3] for x in held]), "held_out": pa.concat_arrays([x[4] for x in held]), "n": pa.array(np.concatenate([x[2] for x in held])), "text": pa.chunked_array([x[5] for x in held], pa.string())})
            chunk = uuid.uuid4().hex
            rows = [(chunk, -1, b"", b"", b"", b"", _ipc(table))]
            edge = np.searchsorted(part, np.arange(parts + 1))
            for p in range(parts):
                w, g = slice(edge[p], edge[p + 1]), slice(gram_edge[p], gram_edge[p + 1])
                if w.start < w.stop or g.start < g.stop:
                    rows.append((chunk, p, words[w].tobytes(), counts[w].tobytes(), _pack(code[g]), learnt[g].tobytes(), b""))
            held.clear()
            grams.clear()
            kinds = (pa.string(), pa.int32(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in WORDS.split(", ")])

        size = 0
        for block in blocks(batches):
            block.words()
            learnt = ~np.array(block.rows.column("held_out").to_pylist(), dtype=bool)
            held.append((block.word_hashes(lower=True), np.repeat(learnt, block.n_words), block.n_words, block.rows.column("doc_id"), block.rows.column("held_out"), block.rows.column("text")))
            weight = np.repeat(learnt, block.end + 1 - block.start)
            for at, code in _grams(block):
                grams.append(_sums(code, weight[at : at + len(code)]))
                if sum(len(x[0]) for x in grams[1:]) > SLICE:
                    merge()
            size += len(block.buf)
            if size > CHUNK:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, WORDS)


def gram_counts(chunks: DataFrame, parts: int) -> DataFrame:
    """Each distinct gram: part, meet (where its contexts are complete), code, n in training."""

    def run(table: pa.Table) -> pa.Table:
        code = np.concatenate([_unpack(x) for x in table.column("grams").to_pylist()])
        code, n = _sums(code, np.concatenate([np.frombuffer(x, dtype="<i4") for x in table.column("learnt").to_pylist()]))
        meet = (mix(_low(code >> np.uint64(8), MEET)) % np.uint64(parts)).astype(np.int32)
        part = pa.array(np.full(len(code), table.column("part")[0].as_py(), dtype=np.int32))
        return pa.table({"part": part, "meet": pa.array(meet), "code": pa.array(code.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    return chunks.where("part >= 0").select("part", "grams", "learnt").groupBy("part").applyInArrow(run, "part int, meet int, code long, n long")


def gram_logs(grams: DataFrame) -> DataFrame:
    """part, code, log: log10 probability of each distinct gram's last byte after the others."""
    rows = grams.where("n > 0").groupBy(F.expr(f"code & {(1 << 8 * MEET) - 1}").alias("code")).agg(F.sum("n").alias("n")).toArrow()
    shared = grams.sparkSession.sparkContext.broadcast((rows.column("code").to_numpy().astype(np.uint64), rows.column("n").to_numpy().astype(float)))

    def run(table: pa.Table) -> pa.Table:
        logs = code_lengths(table.column("code").to_numpy().astype(np.uint64), table.column("n").to_numpy().astype(float), *shared.value)
        return pa.table({"part": table.column("part"), "code": table.column("code"), "log": pa.array(logs.astype(np.float32))})

    return grams.groupBy("meet").applyInArrow(run, "part int, code long, log float")


def _replies(asked: pa.Table, known: pa.Table) -> pa.Table:
    """Of one part: for each chunk, the logs of its grams in the order in which it sent them."""
    code, log = known.column("code").to_numpy().astype(np.uint64), known.column("log").to_numpy()
    order = np.argsort(code)
    code, log = code[order], log[order]
    back = [log[np.searchsorted(code, _unpack(x))].astype("<f4").tobytes() for x in asked.column("grams").to_pylist()]
    return pa.table({"chunk": asked.column("chunk"), "part": asked.column("part"), "logs": pa.array(back, pa.binary())})


def _totals(table: pa.Table) -> pa.Table:
    """Of one part: for each chunk, the corpus counts of its words in the order in which it sent them."""
    hashes = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
    counts = [np.frombuffer(x, dtype="<i4") for x in table.column("counts").to_pylist()]
    _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
    back = np.split(total[inverse], np.cumsum([len(x) for x in hashes])[:-1])
    known = [int(total.sum()), int((total > 0).sum())]
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "totals": pa.array([x.astype("<i8").tobytes() for x in back], pa.binary()), "n": pa.array([known[0] if i == 0 else 0 for i in range(len(back))], pa.int64()), "v": pa.array([known[1] if i == 0 else 0 for i in range(len(back))], pa.int64())})


def _documents(table: pa.Table, parts: int) -> pa.Table:
    """Of one chunk: its documents' sums over words and over symbols."""
    kinds = table.column("part").to_pylist()
    own = kinds.index(-1)
    order = sorted(range(len(kinds)), key=kinds.__getitem__)

    def joined(name: str, kind: str) -> np.ndarray:
        found = [table.column(name)[i].as_py() for i in order]
        return np.frombuffer(b"".join(x for x in found if x), dtype=kind)

    docs = pa.ipc.open_stream(table.column("docs")[own].as_py()).read_all()
    n = docs.column("n").to_numpy()
    text = docs.select(["text"]).to_batches()
    hashes = []
    for block in blocks(iter(text)):
        block.words()
        hashes.append(block.word_hashes(lower=True))
    words, index = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.empty(len(words), dtype=np.int64)
    total[np.argsort(words % np.uint64(parts), kind="stable")] = joined("totals", "<i8")
    edge = np.concatenate(([0], np.cumsum(n)))
    logs = np.concatenate(([0.0], np.cumsum(np.log10(total + 1.0)[index])))
    known = np.concatenate(([0], np.cumsum((total > 0)[index])))
    held, scores = [], []
    for block in blocks(iter(text)):
        scores.append(np.zeros(len(block)))
        for at, found in _grams(block):
            kinds, inverse = np.unique(found, return_inverse=True)
            # The text that the slice starts in, and those that start in the slice.
            own = np.searchsorted(block.start, at, side="right") - 1
            starts = np.maximum(block.start[own : np.searchsorted(block.start, at + len(found))] - at, 0)
            held.append((kinds, inverse.astype(np.int32), scores[-1][own : own + len(starts)], starts))
    code = np.unique(np.concatenate([x[0] for x in held]))
    log = np.empty(len(code))
    log[_by_part(code, parts)[0]] = joined("logs", "<f4")
    for kinds, inverse, total, starts in held:
        total += np.add.reduceat(log[np.searchsorted(code, kinds)][inverse], starts)
    return pa.table({"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array((known[edge[1:]] - known[edge[:-1]]).astype(np.int64)), "sum_log": pa.array(logs[edge[1:]] - logs[edge[:-1]]), "score": pa.array(np.concatenate(scores))})


def score(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(docs, 7), F.lit(False)).alias("held_out"), "text")
    learnt = rows.where(~F.col("held_out"))
    n_learnt = learnt.select("held_out").count()
    parts = partitions(docs.sparkSession)
    chunks = materialise(chunks_of(rows, parts), "ppm-chunks")
    asked = chunks.where("part >= 0")
    grams = materialise(gram_counts(chunks, parts), "ppm-grams", free=True)
    logs = gram_logs(grams).groupBy("part")
    replies = asked.select("chunk", "part", "grams").groupBy("part").cogroup(logs).applyInArrow(_replies, "chunk string, part int, logs binary")
    replies = materialise(replies, "ppm-replies", free=True)
    words = asked.select("chunk", "part", "hashes", "counts")
    totals = materialise(words.groupBy("part").applyInArrow(_totals, "chunk string, part int, totals binary, n long, v long"), "ppm-totals", free=True)
    n, v = totals.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = n + n_learnt, v + (n_learnt > 0)
    none = F.lit(None).cast("binary")
    columns = ("totals", "logs", "docs")
    row = lambda df, **have: df.select("chunk", "part", *(F.col(have[c]).alias(c) if c in have else none.alias(c) for c in columns))
    both = row(totals, totals="totals").unionByName(row(replies, logs="logs")).unionByName(row(chunks.where("part = -1"), docs="docs"))
    found = both.groupBy("chunk").applyInArrow(lambda group: _documents(group, parts), SCHEMA)
    n_tokens = F.col("n_tokens") + 1
    return found.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("n_known") + int(n_learnt > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("sum_log") + F.lit(float(np.log10(n_learnt + 1))) - n_tokens * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        "score",
    )
