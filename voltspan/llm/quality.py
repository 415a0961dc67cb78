"""Quality rules and robust multivariate outliers.

Counted statistics decide the base rules. What passes them becomes a vector of transformed statistics, and for each
language and source the minimum covariance determinant is estimated: from several starts (quartiles, the moments of all
rows, and those of the rows whose every statistic lies in its middle four fifths), concentration steps take the half of the
rows with the smallest Mahalanobis distance and estimate location and scatter anew, until no determinant falls any more;
of all subsets met, the one of least determinant is the estimate. A step is one aggregation: rows are pre-aggregated by
(group, start, distance cell) to counts, sums and sums of products, so a group that holds a third of all rows is never
gathered, and every row counts at every step; of the cell in which the half ends, its mean row counts as often as is left.
A row is kept if its distance is within the cut.

Groups of fewer than LEAST rows use the estimate of their language, or else of all rows. Null text: no words, so the base
rules reject it. Null lang or source: a group of its own. Repeated rows count as often as they stand. An empty table gives
an empty result. Further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.llm._blocks import Block, blocks, windows
from voltspan.llm._io import materialise

LEAST_WORDS, MOST_REPEATED = 20, 30
WINDOW = 8
LEAST, HALF = 50, 0.5
#: Starts; a determinant that falls by less than SETTLED of it has settled. Cells bound the number of steps that can go on falling.
STARTS, SETTLED, ENDLESS = 3, 1e-3, 100
#: Squared distances beyond which a row is an outlier: the 0.9999 quantile of chi squared with as many degrees as VECTOR has.
CUT = 27.9
CELLS = 160
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
VECTOR = ("v_length", "v_symbols", "v_lines", "v_repeats", "v_upper", "v_marks")
#: Least standard deviation of each part of VECTOR: statistics that are zero nearly everywhere would else have no scatter.
FLOOR = np.array([0.08, 0.01, 0.3, 0.03, 0.03, 0.05])
STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long"
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
MARKS = np.zeros(256, dtype=bool)
MARKS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _sums(mask: np.ndarray, block: Block) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return total[block.end] - total[block.start]


def _repeated(block: Block) -> np.ndarray:
    """Of each document, the words in WINDOW-word windows that stand twice or more in it."""
    out = np.zeros(len(block), dtype=np.int64)
    hashes = block.word_hashes(lower=False)
    for i in np.flatnonzero(block.n_words > WINDOW):
        found = windows(hashes[block.first[i] : block.last[i]], WINDOW)
        order = np.argsort(found)
        same = found[order[1:]] == found[order[:-1]]
        if same.any():
            twice = np.zeros(len(found), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(len(found) + WINDOW + 1, dtype=np.int64)
            at = np.flatnonzero(twice)
            edge[at] += 1
            edge[at + WINDOW] -= 1
            out[i] = np.count_nonzero(np.cumsum(edge) > 0)
    return out


def _dup_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in raw.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(b" \t\n\r\x0b\x0c"):
            seen.add(line)
    return n


def statistics(docs: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            block.words()
            solid = np.zeros(len(block.buf), dtype=np.int8)
            solid[block.w_start] = 1
            solid[block.w_end] -= 1
            chars = np.cumsum(solid, dtype=np.int8).view(bool) & ((block.buf & 0xC0) != 0x80)
            columns = [block.n_words, _sums(chars, block), _sums(SYMBOLS[block.buf], block), np.fromiter(map(_dup_lines, block.raw), dtype=np.int64, count=len(block)), _repeated(block), _sums(UPPER[block.buf], block), _sums(MARKS[block.buf], block)]
            yield pa.RecordBatch.from_arrays([*(block.rows.column(c) for c in ("doc_id", "lang", "source")), *(pa.array(x.astype(np.int64)) for x in columns)], names=[x.split()[0] for x in STATS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text").mapInArrow(count, STATS)


def with_rules(stats: DataFrame) -> DataFrame:
    n = F.col("n_words")
    stats = stats.withColumn("base_failed", (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n))
    per = F.greatest(n, F.lit(1))
    parts = {
        "v_length": F.log((F.col("word_chars") + 1) / per),
        "v_symbols": F.sqrt(F.col("n_symbols") / per),
        "v_lines": F.log1p(F.col("n_dup_lines")),
        "v_repeats": F.sqrt(F.col("n_repeat_words") / per),
        "v_upper": F.sqrt(F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))),
        "v_marks": F.sqrt(F.col("n_marks") / per),
    }
    return stats.withColumns(parts)


def _moments(group: pd.DataFrame, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Location and scatter of the nearest cells that hold the wanted share of the rows."""
    group, d = group.sort_values("cell"), len(VECTOR)
    n = group["n"].to_numpy(dtype=float)
    total = share * n.sum()
    part = np.clip((total - (np.cumsum(n) - n)) / n, 0, 1)
    mean = (group[[f"s{i}" for i in range(d)]].to_numpy() * part[:, None]).sum(axis=0) / total
    cov = np.empty((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = (group[f"p{i}_{j}"].to_numpy() * part).sum() / total - mean[i] * mean[j]
    return mean, cov


def _row(key: tuple, mean: np.ndarray, cov: np.ndarray, spread: float) -> pd.DataFrame:
    """spread: the median of the squared distances that led to the subset."""
    scatter = cov + np.diag(FLOOR**2)
    inverse = np.linalg.inv(scatter)
    return pd.DataFrame({"g_lang": [key[0]], "g_source": [key[1]], "start": [key[2]], "mean": [mean.tolist()], "inverse": [inverse.ravel().tolist()], "logdet": [float(np.linalg.slogdet(scatter)[1])], "spread": [spread]})


ESTIMATE = "g_lang string, g_source string, start int, mean array<double>, inverse array<double>, logdet double, spread double"


def _distance() -> F.Column:
    d = len(VECTOR)
    off = [F.col(v) - F.col("mean")[i] for i, v in enumerate(VECTOR)]
    terms = [off[i] * off[j] * F.col("inverse")[i * d + j] * (1 if i == j else 2) for i in range(d) for j in range(i, d)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return F.greatest(total, F.lit(0.0))


def _step(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """A concentration step over the cells of a group and start."""
    g = group.sort_values("cell")
    at = np.searchsorted(np.cumsum(g["n"].to_numpy(dtype=float)), HALF * g["n"].sum())
    return _row(key, *_moments(group, HALF), float(2 ** ((g["cell"].iloc[min(at, len(g) - 1)] + 0.5 - 80) / 8)))


def _all(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """Moments of all rows of a start."""
    return _row(key, *_moments(group, 1.0), 0.0)


def _sized(rows: DataFrame, *by: str) -> DataFrame:
    d = len(VECTOR)
    sums = [F.count("*").alias("n"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(VECTOR)), *(F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d))]
    return rows.groupBy("g_lang", "g_source", *by).agg(*sums)


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows with what was found for their group; groups are few, so Spark broadcasts them where their size allows."""
    of = found.withColumnsRenamed({"g_lang": "_gl", "g_source": "_gs"})
    return rows.join(of, F.col("g_lang").eqNullSafe(F.col("_gl")) & F.col("g_source").eqNullSafe(F.col("_gs"))).drop("_gl", "_gs")


def starts(rows: DataFrame) -> DataFrame:
    d = len(VECTOR)
    marks = [F.percentile_approx(v, [0.1, 0.25, 0.5, 0.75, 0.9], 1000).alias(f"q{i}") for i, v in enumerate(VECTOR)]
    marks = materialise(rows.groupBy("g_lang", "g_source").agg(*marks), "quality-quantiles")
    # Medians and quartile spreads: consistent for a normal, and not moved by a quarter of bad rows.
    sd = [F.greatest((F.col(f"q{i}")[3] - F.col(f"q{i}")[1]) / 1.349, F.lit(float(FLOOR[i]))) for i in range(d)]
    logdet = sum((2 * F.log(x) for x in sd), F.lit(0.0))
    first = marks.select("g_lang", "g_source", F.lit(0).alias("start"), F.array(*(F.col(f"q{i}")[2] for i in range(d))).alias("mean"), F.array(*((1 / (sd[i] * sd[i])) if i == j else F.lit(0.0) for i in range(d) for j in range(d))).alias("inverse"), logdet.alias("logdet"), F.lit(0.0).alias("spread"))
    inside = F.lit(True)
    for i, v in enumerate(VECTOR):
        inside &= F.col(v).between(F.col(f"q{i}")[0], F.col(f"q{i}")[4])
    picked = _joined(rows, marks).select("g_lang", "g_source", *VECTOR, F.explode(F.when(inside, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("start"))
    more = _sized(picked.withColumn("cell", F.lit(0)), "start", "cell").groupBy("g_lang", "g_source", "start").applyInPandas(_all, ESTIMATE)
    return first.unionByName(more)


def estimate(rows: DataFrame) -> DataFrame:
    """Minimum covariance determinant of VECTOR for each (g_lang, g_source) of rows: mean and inverse."""
    found = materialise(starts(rows), "quality-estimate")
    best = None
    for _ in range(ENDLESS):
        cell = F.least(F.floor(F.log2(_distance() + 1e-3) * 8 + 80), F.lit(CELLS)).cast("int")
        cells = _sized(_joined(rows, found).withColumn("cell", cell), "start", "cell")
        # A cell in which the half ends counts in part, so a determinant may rise a little before it settles: the least is kept.
        now = cells.groupBy("g_lang", "g_source", "start").applyInPandas(_step, ESTIMATE)
        if best is not None:
            last = best.withColumnsRenamed({"g_lang": "_gl", "g_source": "_gs", "start": "_st", "logdet": "before"}).select("_gl", "_gs", "_st", "before")
            now = now.join(last, F.col("g_lang").eqNullSafe(F.col("_gl")) & F.col("g_source").eqNullSafe(F.col("_gs")) & (F.col("start") == F.col("_st"))).drop("_gl", "_gs", "_st")
        else:
            now = now.withColumn("before", F.lit(None).cast("double"))
        found = materialise(now, "quality-estimate")
        own = found.select("g_lang", "g_source", "start", "mean", "inverse", "logdet", "spread")
        every = own if best is None else best.unionByName(own)
        best = materialise(every.groupBy("g_lang", "g_source", "start").agg(F.min_by(F.struct("mean", "inverse", "logdet", "spread"), "logdet").alias("b")).select("g_lang", "g_source", "start", "b.*"), "quality-best")
        falling = found.where(F.col("before").isNull() | (F.col("logdet") < F.col("before") - SETTLED)).select("g_lang", "g_source", "start")
        found = found.drop("before").join(falling.select(F.col("g_lang").alias("_gl"), F.col("g_source").alias("_gs"), F.col("start").alias("_st")), F.col("g_lang").eqNullSafe(F.col("_gl")) & F.col("g_source").eqNullSafe(F.col("_gs")) & (F.col("start") == F.col("_st")), "left_semi")
        if falling.isEmpty():
            break
    out = best.groupBy("g_lang", "g_source").agg(F.min_by(F.struct("mean", "inverse", "spread"), F.struct("logdet", "start")).alias("b"))
    # Scaled up to consistency: the median distance seen against the median of chi squared with d degrees. FLOOR is scatter
    # of its own, so the scale is bounded.
    d = len(VECTOR)
    scale = F.least(F.greatest(F.col("b.spread") / (d * (1 - 2 / (9 * d)) ** 3), F.lit(1.0)), F.lit(4.0))
    return out.select("g_lang", "g_source", F.col("b.mean").alias("mean"), F.transform("b.inverse", lambda x: x / scale).alias("inverse"))


def judge(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) -> statistics, base_failed, distance, kept."""
    rows = materialise(with_rules(statistics(docs)), "quality-statistics")
    good = rows.where(~F.col("base_failed"))
    sizes = good.groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy(F.col("lang").alias("_l")).agg(F.sum("n").alias("n_lang"))
    own = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("_l")))
    rest, every = F.lit("\u0000any"), F.lit("\u0000any")
    of = own.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), F.when(F.col("n_lang") >= LEAST, F.col("lang")).otherwise(every).alias("g_lang"), F.when((F.col("n") >= LEAST) & (F.col("n_lang") >= LEAST), F.col("source")).otherwise(rest).alias("g_source"))
    of = materialise(of, "quality-groups")
    joined = good.join(of, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_l", "_s")
    # Estimates of a language or of all rows rest on all their rows, not just on those of small groups.
    wide = of.select("g_lang", "g_source").distinct().where(F.col("g_source") == rest)
    langs = good.select(F.col("lang").alias("g_lang"), rest.alias("g_source"), *VECTOR).join(wide.where(F.col("g_lang").isNull() | (F.col("g_lang") != every)).withColumnRenamed("g_lang", "_l").drop("g_source"), F.col("g_lang").eqNullSafe(F.col("_l"))).drop("_l")
    all_rows = good.select(every.alias("g_lang"), rest.alias("g_source"), *VECTOR).join(wide.where(F.col("g_lang") == every).select(F.col("g_lang").alias("_l")), F.col("g_lang") == F.col("_l"), "left_semi")
    named = joined.where(F.col("g_source").isNull() | (F.col("g_source") != rest)).select("g_lang", "g_source", *VECTOR)
    found = materialise(estimate(materialise(named.unionByName(langs).unionByName(all_rows), "quality-vectors")), "quality-found")
    found = found.select(F.col("g_lang").alias("_gl"), F.col("g_source").alias("_gs"), "mean", "inverse")
    scored = rows.join(of, ~F.col("base_failed") & F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    scored = scored.join(found, F.col("g_lang").eqNullSafe(F.col("_gl")) & F.col("g_source").eqNullSafe(F.col("_gs")), "left")
    distance = F.when(~F.col("base_failed"), _distance())
    return scored.withColumn("distance", distance).withColumn("kept", F.coalesce(F.col("distance") <= CUT, F.lit(False))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
