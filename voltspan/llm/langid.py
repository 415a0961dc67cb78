"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

A bounded sample of labelled texts (PER_LANG a language) is learnt in one task by follow-the-regularised-leader with an
elastic net; a fifth of it is held back, and a temperature is fitted on it. The model, of fixed size for each language,
then scores every whole text.

Text that is null or has no letter: `und`, score 0. Ties go to the language that sorts first. Rows that repeat a doc_id
get a row each. If nothing can be learnt (an empty table, no label), every text is `und`. Further columns are not looked
at.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.llm._ftrl import Ftrl, softmax, temperature

#: Most texts of a language that are learnt from, and rounds over them.
PER_LANG, EPOCHS = 1200, 2
BITS, ORDERS = 15, 3
UNKNOWN = "und"
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII other than letters is one symbol, as a space.
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def features(text: str, idf: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to ORDERS-grams of the characters: indices, and TF-IDF of length one."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    c = np.where(c < 128, _FOLD[np.minimum(c, 127)], c)
    parts, h = [], np.zeros(len(c), dtype=np.uint32)
    for n in range(ORDERS):
        if len(c) <= n:
            break
        h = (h[: len(c) - n] + c[n:] + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        parts.append((h >> np.uint32(3)) & np.uint32((1 << BITS) - 1))
    counts = np.bincount(np.concatenate(parts).astype(np.int64), minlength=1 << BITS) if parts else np.zeros(1 << BITS, dtype=np.int64)
    index = np.flatnonzero(counts)
    value = 1 + np.log(counts[index])
    if idf is not None:
        value = value * idf[index]
    return index, value / max(np.sqrt(value @ value), 1e-12)


def learn(texts: list[str], langs: list[str]) -> dict | None:
    names = sorted(set(langs))
    if not names:
        return None
    label = np.array([names.index(x) for x in langs])
    df = np.zeros(1 << BITS)
    for t in texts:
        df[features(t, None)[0]] += 1
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    rows = [features(t, idf) for t in texts]
    order = np.random.Generator(np.random.PCG64(5)).permutation(len(texts))
    held, seen = order[: len(order) // 5], order[len(order) // 5 :]
    model = Ftrl(1 << BITS, len(names), alpha=1.0, l1=0.01, l2=0.01)
    for _ in range(EPOCHS):
        for i in seen:
            model.learn(*rows[i], label[i])
    w = model.weights()
    scores = np.array([rows[i][1] @ w[rows[i][0]] for i in held]).reshape(len(held), len(names))
    return {"names": names, "idf": idf.astype(np.float32), "w": (w / temperature(scores, label[held])).astype(np.float32)}


def held_out(docs: DataFrame, parts: int = 4, rest: int = 2) -> F.Column:
    return F.crc32(docs["doc_id"].cast("string")) % parts == rest


def train(docs: DataFrame) -> dict | None:
    """Learns from rows that are not held out, have text with a letter and a language."""
    rows = docs.where(~held_out(docs) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id", F.lit(11)).alias("h"), "text")
    counts = rows.groupBy("lang").count().select(F.col("lang").alias("_l"), "count")
    share = F.lit(1.1 * PER_LANG) / F.col("count")
    drawn = rows.join(F.broadcast(counts), F.col("lang") == F.col("_l")).where(F.pmod("h", F.lit(1 << 20)) < share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(h, doc_id, lang, text) for b in batches for h, doc_id, lang, text in zip(*(b.column(c).to_pylist() for c in ("h", "doc_id", "lang", "text")), strict=True) if _LETTER.search(text)]
        found.sort(key=lambda x: (x[0], x[1]))
        model = learn([x[3] for x in found], [x[2] for x in found])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    rows = drawn.select("h", "doc_id", "lang", "text").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else None


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                if m is None or text is None or not _LETTER.search(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                index, value = features(text, m["idf"])
                p = softmax((value @ m["w"][index]).astype(np.float64))
                names.append(m["names"][int(np.argmax(p))])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(docs), F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(docs))
