"""Toxicity scores of deobfuscated text.

A noisy channel writes letters as look-alike digits and symbols, repeats them, sets spaces between them and leaves others
out. Each word whose writing may be disguised, and each row of single characters, is one lattice: every position has the
letters that it may stand for, a run of one letter may be fewer of it, a written space may stand for none, and a
space may be missing before any letter, each at a price. Exact Viterbi decoding under a character language model restores
the text: of all paths that end in the same letters the best is kept, and no other is dropped. Words in plain letters stay as
they are; one with doubled letters is decoded where it is unknown as written and known without them. A logistic regression on hashed words and word beginnings of the restored text,
trained by follow-the-regularised-leader, gives the score.

All labelled rows are learnt from: letters are counted over all words of theirs in the tasks, and the driver gets one row a
sequence of ORDER letters; the words themselves are known by a filter of fixed size (three bits of one of 2 ** SLOTS numbers a
word), so that a word that never occurred may be taken for known: 0.003 % of them at a million words, 5.5 % at forty million.
The regression is trained in parts of about PART_LABELS rows at once. After each round a weight's state is the mean of the parts' states, each counted by the squared gradients
that it has added, and the next round begins there; a single part learns as one run over its rows.

Nulls: a null text is empty; an empty text has the score of the bias alone; a null label is not learnt from. Several
labels of one doc_id are several rows to learn from. Repeated rows get a row each. Without any label, scores are 0.
Further columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltspan.llm._blocks import LOWER, SYMBOL_LOWER, Block, as_bytes, blocks, keyed_hashes, mix
from voltspan.llm._ftrl import Ftrl
from voltspan.llm._io import free_shuffles, materialise, release, tidy, tidy_group
from voltspan.llm.langid import held_out

#: About as many labelled rows are a part, which one task learns from; rounds over all of them.
PART_LABELS, EPOCHS = 12000, 2
THRESHOLD = 0.3
BITS = 20
HEADS = (4, 5)
#: Letters' and words' results that a task remembers; they only spare work.
KNOWN = 30_000
#: Different words that a task counts before it passes their letters on.
MOST_WORDS = 100_000
#: The filter of known words has 2 ** SLOTS numbers of 64 bits.
SLOTS = 22
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "#": "h", "*": "aeiou", "(": "c", "€": "e", "¡": "i"}
#: Signs inside a word that may stand for nothing.
GAPS = "-_.*'~^,"
#: Letters that the character model looks at, the one it prices included.
ORDER = 4
#: Prices in natural log units: a sign for a letter, a sign for nothing, a run for fewer letters, a space for nothing, none for a space.
SWAP, GAP, REPEAT, JOIN, SPLIT = -0.4, -0.7, -0.6, -0.7, -2.5
_DISGUISE = np.zeros(256, dtype=np.int8)
_DISGUISE[[ord(c) for c in LEET if ord(c) < 128] + [ord(c) for c in GAPS]] = 1
_LETTER = np.zeros(256, dtype=np.int8)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_SIGN = np.zeros(256, dtype=np.int8)
_SIGN[[ord(c) for c in LEET if ord(c) < 128 and not c.isdigit()]] = 1
_EDGE = np.zeros(256, dtype=bool)
_EDGE[[ord(c) for c in ".,;:!?\"'()[]{}<>#*%&|-_~^/\\"]] = True
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


class CharModel:
    """Character n-grams of up to ORDER with Witten-Bell backoff, and a filter that knows the words they come from."""

    def __init__(self, words: Counter):
        found = list(words)
        slots, bits = _marks(_word_hashes(found))
        self._fill(zip(*_grams(found, list(words.values())), strict=True), slots, bits)

    @classmethod
    def of(cls, grams: Iterable[tuple[str, int]], slots: np.ndarray, bits: np.ndarray) -> CharModel:
        """From counts of n-grams and the filter's numbers."""
        model = cls.__new__(cls)
        model._fill(grams, slots, bits)
        return model

    def _fill(self, grams: Iterable[tuple[str, int]], slots: np.ndarray, bits: np.ndarray) -> None:
        self.counts: dict[str, Counter] = {}
        for gram, n in grams:
            self.counts.setdefault(gram[:-1], Counter())[gram[-1]] += n
        self.total = {c: (sum(x.values()), len(x)) for c, x in self.counts.items()}
        self.words = np.zeros(1 << SLOTS, dtype=np.uint64)
        np.bitwise_or.at(self.words, slots, bits)
        self.known: dict[tuple[str, str], float] = {}

    def log(self, context: str, char: str) -> float:
        found = self.known.get((context, char))
        if found is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            found = self.known[context, char] = self._log(context, char)
        return found

    def _log(self, context: str, char: str) -> float:
        p = 1 / 256
        for k in range(len(context) + 1):
            c = context[len(context) - k :]
            if c not in self.total:
                break
            total, kinds = self.total[c]
            p = (self.counts[c][char] + kinds * p) / (total + kinds)
        return float(np.log(p))

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether words are among those that the model was made from; the filter's chance of a wrong yes is small."""
        slots, bits = _marks(hashes)
        return self.words[slots] & bits == bits


def _marks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's number in the filter, and its bits there."""
    found = mix(hashes)
    bits = np.zeros(len(found), dtype=np.uint64)
    for shift in (0, 6, 12):
        bits |= np.uint64(1) << (found >> np.uint64(shift) & np.uint64(63))
    return (found >> np.uint64(64 - SLOTS)).astype(np.int64), bits


def _grams(words: list[str], counts: list[int]) -> tuple[list[str], list[int]]:
    """The n-grams of up to ORDER characters of ^word$, but ^ alone, and how often each occurs."""
    whole = "".join("^" + w + "$" for w in words)
    code = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    inside = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    weight = np.repeat(np.array(counts, dtype=np.float64), size)
    out, n = [], []
    before = np.zeros(len(code), dtype=np.int64)
    for k in range(ORDER):
        # An n-gram is the number of the one that ends before its last character, and that character.
        at = np.flatnonzero(inside >= k)
        key, first, number = np.unique((before[at - 1] << 21 if k else 0) | code[at], return_index=True, return_inverse=True)
        found = np.bincount(number, weight[at] * (inside[at] > 0), len(key))
        before[at] = number
        some = np.flatnonzero(found)
        out.extend(whole[i - k : i + 1] for i in at[first[some]].tolist())
        n.extend(found[some].astype(np.int64).tolist())
    return out, n


def _word_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words if w]
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    end = np.cumsum(np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)))
    return keyed_hashes(SYMBOL_LOWER, buf, np.concatenate(([0], end[:-1])) if len(end) else end, end)


def _edges(token: str) -> list[list[tuple[str, int, float]]]:
    """The lattice of a token: from each position, (letters, next position, price); a space ends a word."""
    n = len(token)
    run = [n] * n
    for i in range(n - 2, -1, -1):
        run[i] = run[i + 1] if token[i] == token[i + 1] else i + 1
    out: list[list[tuple[str, int, float]]] = []
    for i, c in enumerate(token):
        if c == " ":
            out.append([(" ", i + 1, 0.0), ("", i + 1, JOIN)])
            continue
        edges = [(c, i + 1, 0.0)] if c.isalpha() else []
        stands = LEET.get(c, "")
        edges.extend((x, i + 1, SWAP) for x in stands)
        if c in GAPS:
            edges.append(("", i + 1, GAP))
        if run[i] - i > 1:
            edges.extend((x, run[i], REPEAT + (0.0 if x == c else SWAP)) for x in (c if c.isalpha() else "") + stands)
        out.append(edges or [("", i + 1, GAP)])
    return out


def decode(token: str, model: CharModel) -> str:
    """The likeliest words behind a token of lower-case characters."""
    return viterbi(token, model)[1]


def viterbi(token: str, model: CharModel) -> tuple[float, str]:
    """The best score of a path through a token's lattice, and the words that it spells.

    A state is the letters that the model looks back on; of the paths into one, the best is all that matters.
    """
    lattice = _edges(token)
    # Of each state: score, then (path before, letters).
    states: list[dict[str, tuple[float, tuple | None]]] = [{} for _ in range(len(token) + 1)]
    states[0] = {"^": (0.0, None)}
    log, look = model.log, ORDER - 1
    for i, edges in enumerate(lattice):
        here, states[i] = states[i], {}
        if i and token[i] != " " and token[i - 1] != " ":
            for context, (score, path) in list(here.items()):
                if context != "^":
                    score += SPLIT + log(context, "$")
                    if "^" not in here or here["^"][0] < score:
                        here["^"] = (score, (path, " "))
        for context, (score, path) in here.items():
            for letters, to, price in edges:
                if letters == " ":
                    now, at = (score + price + log(context, "$"), "^") if context != "^" else (score + price, context)
                elif letters:
                    now, at = score + price + log(context, letters), (context + letters)[-look:]
                else:
                    now, at = score + price, context
                known = states[to].get(at)
                if known is None or known[0] < now:
                    states[to][at] = (now, (path, letters) if letters else path)
    ends = [(score + (log(context, "$") if context != "^" else 0.0), context) for context, (score, _) in states[-1].items()]
    score, context = max(ends)
    path, letters = states[-1][context][1], []
    while path is not None:
        path, x = path
        letters.append(x)
    return score, " ".join("".join(reversed(letters)).split())


def _cores(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Words without the marks at their edges."""
    inner, place = ~_EDGE[block.buf], np.arange(len(block.buf))
    last = np.maximum.accumulate(np.where(inner, place, -1))
    first = np.minimum.accumulate(np.where(inner, place, len(block.buf))[::-1])[::-1]
    start = np.minimum(first[block.w_start], block.w_end)
    return start, np.maximum(last[block.w_end - 1] + 1, start)


def _doubled(block: Block, start: np.ndarray, end: np.ndarray, n_letters: np.ndarray, model: CharModel) -> np.ndarray:
    """Words of letters that are unknown as written, but known without their doubled letters."""
    buf = block.buf
    low = LOWER[buf]
    first = np.ones(len(buf), dtype=bool)
    first[1:] = (low[1:] != low[:-1]) | (_LETTER[buf[1:]] == 0) | (buf[1:] > 127)
    at = np.concatenate(([0], np.cumsum(first, dtype=np.int64)))
    # A word's first byte counts even where it equals the byte before.
    double = np.flatnonzero((n_letters == end - start) & (at[end] - at[np.minimum(start + 1, end)] < end - start - 1))
    unknown = double[~model.has(keyed_hashes(SYMBOL_LOWER, buf, start[double], end[double]))]
    short, begin = buf[first], at[start[unknown] + 1] - 1
    out = np.zeros(len(start), dtype=bool)
    out[unknown] = model.has(keyed_hashes(SYMBOL_LOWER, short, begin, at[end[unknown]]))
    return out


def restored(block: Block, decoder, model: CharModel) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Start and end of plain words (equal where a word is none), and the restored words of each document."""
    block.words()
    start, end = _cores(block)
    buf = block.buf
    letters = np.concatenate(([0], np.cumsum(_LETTER[buf], dtype=np.int64)))
    n_letters = letters[end] - letters[start]
    odd = np.concatenate(([0], np.cumsum(_DISGUISE[buf], dtype=np.int64)))
    triple = np.zeros(len(buf), dtype=np.int8)
    low = LOWER[buf]
    triple[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2])
    triple = np.concatenate(([0], np.cumsum(triple, dtype=np.int64)))
    # Edge marks can be disguised letters too: a word that begins or ends in one is looked at as a whole.
    wide = odd[block.w_end] - odd[block.w_start]
    # Digits with marks between are a number, and one mark is a mark.
    signs = np.concatenate(([0], np.cumsum(_SIGN[buf], dtype=np.int64)))
    written = ((n_letters > 0) | (signs[block.w_end] - signs[block.w_start] > 0)) & (block.w_end - block.w_start > 1)
    disguised = written & (odd[end] - odd[start] > 0)
    disguised |= (n_letters > 0) & (triple[end] - triple[np.minimum(start + 2, end)] > 0)
    disguised |= _doubled(block, start, end, n_letters, model)
    disguised |= written & (wide > 0) & (block.w_start < start) & np.isin(buf[np.maximum(start - 1, 0)], [ord(c) for c in "!|#*("])
    solid = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)))
    single = (solid[end] - solid[start] == 1) & (n_letters + (odd[end] - odd[start]) > 0)
    doc = np.repeat(np.arange(len(block)), block.n_words)
    beside = np.zeros(len(single), dtype=bool)
    if len(single) > 1:
        two = single[:-1] & single[1:] & (doc[:-1] == doc[1:])
        beside[:-1] |= two
        beside[1:] |= two
    out: list[list[str]] = [[] for _ in range(len(block))]
    for i in np.flatnonzero(disguised & ~beside):
        token = buf[block.w_start[i] : block.w_end[i]].tobytes()
        out[doc[i]].extend(decoder(token))
    at = np.flatnonzero(beside)
    if len(at):
        for run in np.split(at, np.flatnonzero((np.diff(at) > 1) | (np.diff(doc[at]) > 0)) + 1):
            out[doc[run[0]]].extend(decoder(b" ".join(buf[start[i] : end[i]].tobytes() for i in run)))
    plain = ~(disguised | beside) & (n_letters > 0)
    return np.where(plain, start, 0), np.where(plain, end, 0), out


def _hashed(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Feature indices of words: the word and its beginnings; one row a word, of zeros where start and end are equal."""
    out = np.zeros((len(start), 1 + len(HEADS)), dtype=np.int64)
    some = np.flatnonzero(end > start)
    start, end = start[some], end[some]
    for j, k in enumerate((None, *HEADS)):
        found = keyed_hashes(SYMBOL_LOWER, buf, start, end if k is None else np.minimum(start + k, end))
        out[some, j] = (mix(found + np.uint64(k or 0)) >> np.uint64(64 - BITS)).astype(np.int64)
    return out


def doc_features(block: Block, decoder, model: CharModel) -> Iterator[np.ndarray]:
    """Distinct feature indices of each document."""
    start, end, extra = restored(block, decoder, model)
    own = _hashed(block.buf, start, end)
    word = end > start
    joined = [w.encode() for ws in extra for w in ws]
    if joined:
        buf = np.frombuffer(b" ".join(joined) + b" ", dtype=np.uint8)
        size = np.fromiter(map(len, joined), dtype=np.int64, count=len(joined))
        e = np.cumsum(size + 1) - 1
        more = _hashed(buf, e - size, e)
    at = 0
    for i in range(len(block)):
        a, b = block.first[i], block.last[i]
        found = own[a:b][word[a:b]].ravel()
        if n := len(extra[i]):
            found = np.concatenate((found, more[at : at + n].ravel()))
            at += n
        yield np.unique(found)


def make_decoder(model: CharModel):
    @lru_cache(maxsize=KNOWN)
    def decoder(token: bytes) -> tuple[str, ...]:
        word = token.decode("utf-8", "replace").lower()
        whole = decode(word, model)
        core = word.strip(".,;:!?\"'()[]{}<>#*%&|-_~^/\\")
        inner = decode(core, model) if core != word else whole
        return tuple(sorted({x for y in (whole, inner, core.replace("-", " ").replace("/", " ")) for x in y.split()}))

    return decoder


def _chars(rows: DataFrame) -> CharModel:
    """The character model of the words in plain letters of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: Counter = Counter()
        known = np.zeros(1 << SLOTS, dtype=np.uint64)

        def grams() -> pa.RecordBatch:
            words: Counter = Counter()
            for w, n in written.items():
                w = w.strip(".,;:!?\"'()").lower()
                if w.isalpha():
                    words[w] += n
            written.clear()
            found = list(words)
            np.bitwise_or.at(known, *_marks(_word_hashes(found)))
            return _counted(*_grams(found, list(words.values())), [], [])

        for b in batches:
            for t in as_bytes(b.column("text")):
                written.update(t.decode("utf-8", "replace").split())
                if len(written) > MOST_WORDS:
                    yield grams()
        yield grams()
        slots = np.flatnonzero(known)
        for at in np.split(slots, range(MOST_WORDS, len(slots), MOST_WORDS)):
            yield _counted([], [], at, known[at].view(np.int64))

    each = rows.select("text").mapInArrow(tidy(count), "gram string, n long, slot int, bits long")
    found = each.groupBy("gram", "slot").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits")).toArrow()
    grams, words = found.filter(pc.is_valid(found.column("gram"))), found.filter(pc.is_valid(found.column("slot")))
    return CharModel.of(zip(grams.column("gram").to_pylist(), grams.column("n").to_pylist(), strict=True), words.column("slot").to_numpy(), words.column("bits").to_numpy().view(np.uint64))


def _counted(grams: list[str], n: list[int], slots: np.ndarray | list, bits: np.ndarray | list) -> pa.RecordBatch:
    """Rows of n-grams, then rows of the filter."""
    none = [None] * len(slots)
    return pa.RecordBatch.from_arrays([pa.array([*grams, *none], pa.string()), pa.array([*n, *none], pa.int64()), pa.array([*[None] * len(n), *slots], pa.int32()), pa.array([*[None] * len(n), *bits], pa.int64())], names=["gram", "n", "slot", "bits"])


def _regression() -> Ftrl:
    return Ftrl((1 << BITS) + 1, 1, alpha=0.3, l1=1.0, l2=0.1)


def _round(rows: DataFrame, ftrl: Ftrl, epoch: int) -> Ftrl:
    """The state after one more round over rows (part, doc_id, toxic, features)."""
    begin = rows.sparkSession.sparkContext.broadcast((ftrl.z, ftrl.n))

    def fit(part: pa.Table) -> pa.Table:
        ids, toxic = (part.column(c).to_numpy() for c in ("doc_id", "toxic"))
        lists = part.column("features").combine_chunks()
        start, value = lists.offsets.to_numpy(), lists.values.to_numpy()
        # Rows of one doc_id are put in order by what they hold.
        held = np.fromiter((crc32(value[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)), dtype=np.int64, count=len(ids))
        found = np.lexsort((toxic, held, ids))
        now = _regression()
        z, n = (x[:, 0].copy() for x in begin.value)
        rng = np.random.Generator(np.random.PCG64(3))
        for _ in range(epoch + 1):
            order = rng.permutation(len(found))
        for i in found[order]:
            index = np.append(value[start[i] : start[i + 1]], 1 << BITS)
            z_i, n_i = z[index], n[index]
            w = now.weigh(z_i, n_i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = p - toxic[i]
            more = n_i + g * g
            z[index] = z_i + (g - (np.sqrt(more) - np.sqrt(n_i)) / now.alpha * w)
            n[index] = more
        gain = n - begin.value[1][:, 0]
        at = np.flatnonzero(gain)
        return pa.table({"part": pa.array(np.full(len(at), part.column("part")[0].as_py(), dtype=np.int32)), "index": at, "z": z[at], "n": n[at], "gain": gain[at]})

    parts = rows.groupBy("part").applyInArrow(tidy_group(fit), "part int, index long, z double, n double, gain double")
    # Added up in the order of the parts, so that reruns agree.
    each = parts.groupBy("index").agg(F.array_sort(F.collect_list(F.struct("part", "z", "n", "gain"))).alias("x"))
    mean = lambda c: F.when(F.size("x") == 1, F.col("x")[0][c]).otherwise(F.aggregate("x", F.lit(0.0), lambda s, x: s + x[c] * x["gain"]) / F.aggregate("x", F.lit(0.0), lambda s, x: s + x["gain"])).alias(c)
    got = each.select("index", mean("z"), mean("n")).toArrow()
    out = _regression()
    out.z, out.n = ftrl.z.copy(), ftrl.n.copy()
    at = got.column("index").to_numpy()
    out.z[at, 0], out.n[at, 0] = got.column("z").to_numpy(), got.column("n").to_numpy()
    begin.destroy()
    return out


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """Character model, weights and bias from all labelled texts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(labels)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # Tables of labels grow with the documents: they aren't broadcast, nor are texts sorted to find them.
    rows = materialise(docs.select("doc_id", "text").join(known.hint("shuffle_hash"), "doc_id").where("text is not null").select("doc_id", "text", "toxic"), "labelled", free=True)
    parts = -(-rows.count() // PART_LABELS)
    if not parts:
        release(rows)
        return None
    chars = _chars(rows)
    shared = docs.sparkSession.sparkContext.broadcast(chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = make_decoder(shared.value)
        for block in blocks(batches):
            found = pa.array(list(doc_features(block, decoder, shared.value)), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), block.rows.column("toxic"), found], names=["doc_id", "toxic", "features"])

    features = rows.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(tidy(run), "doc_id long, toxic int, features array<int>")
    features = materialise(features.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(parts)).cast("int")), "features", free=True)
    release(rows)
    shared.destroy()
    ftrl = _regression()
    for epoch in range(EPOCHS):
        ftrl = _round(features, ftrl, epoch)
        free_shuffles(docs.sparkSession)
    release(features)
    w = ftrl.weights()[:, 0]
    index = np.flatnonzero(w[:-1])
    return {"chars": chars, "index": index.astype(np.int32), "w": w[index].astype(np.float32), "bias": float(w[-1])}


class Scorer:
    """Scores blocks under a model, in a task."""

    def __init__(self, model: dict | None):
        self.model = model
        if model is not None:
            self.weight = np.zeros(1 << BITS, dtype=np.float32)
            self.weight[model["index"]] = model["w"]
            self.decoder = make_decoder(model["chars"])

    def __call__(self, block: Block) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(block))
        sums = np.array([self.weight[x].sum(dtype=np.float64) for x in doc_features(block, self.decoder, self.model["chars"])])
        return 1 / (1 + np.exp(-np.clip(sums + self.model["bias"], -30, 30)))


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for block in blocks(batches):
            scores = scorer(block)
            yield pa.RecordBatch.from_arrays([block.rows.column("doc_id"), block.rows.column("held_out"), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(docs), F.lit(False)).alias("held_out"), "text").mapInArrow(tidy(run), SCHEMA)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def keep_clean(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs, all columns as they are, whose text isn't predicted toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for block in blocks(batches):
            yield block.rows.filter(pa.array(scorer(block) < THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)
