"""Texts as byte blocks: vectorised words and polynomial hashes over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
SYMBOL = np.random.Generator(np.random.PCG64(20240607)).integers(0, 2**64, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SYMBOL_LOWER = SYMBOL[LOWER]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, _INVERSE):
        x = np.full(size, base, dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i from 0 to n."""
    return _powers(1 << max(12, int(n + 1).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=2)
def _place_keys(size: int) -> np.ndarray:
    return mix(np.arange(1, max(4096, size) + 1, dtype=np.uint64) * _U(BASE))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial of 64-bit symbol values: entry i covers the first i symbols."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * powers(len(values))[0][: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span of symbols; equal spans have equal hashes, wherever they start."""
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def keyed_hashes(symbols: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans that aren't empty: the sum of a well-mixed value of each byte and its place, so that no algebra of the
    bytes cancels out."""
    size = end - start
    if not len(size):
        return np.empty(0, dtype=np.uint64)
    edge = np.cumsum(size) - size
    place = np.arange(edge[-1] + size[-1]) - np.repeat(edge, size)
    keys = _place_keys(1 << int(place.max()).bit_length())
    value = symbols[buf[np.repeat(start, size) + place]]
    return mix(np.add.reduceat(mix(value ^ keys[place]), edge) + size.astype(np.uint64))


#: A Mersenne prime. Polynomials modulo a power of two have texts that collide whatever the base; modulo a prime there are none
#: such, and two texts of n symbols collide for at most n of all bases.
PRIME = (1 << 61) - 1
_P, _LOW31, _LOW30 = _U(PRIME), _U((1 << 31) - 1), _U((1 << 30) - 1)


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for values below it."""
    a, b = np.asarray(a, dtype=np.uint64), np.asarray(b, dtype=np.uint64)
    ah, al, bh, bl = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
    middle = al * bh + ah * bl
    return _reduce(_reduce(ah * bh * _U(2) + (middle >> _U(30))) + _reduce(((middle & _LOW30) << _U(31)) + al * bl))


def minus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(a >= b, a - b, a + _P - b)


_POWERS: dict[int, np.ndarray] = {}


def prime_powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo PRIME, for i from 0 to n at least."""
    out = _POWERS.get(base, np.ones(1, dtype=np.uint64))
    while len(out) <= n:
        out = np.concatenate((out, times(out, _U(pow(base, len(out), PRIME)))))
    if len(out) <= 1 << 20:
        _POWERS[base] = out
    return out


def _scaled(values: np.ndarray, base: int) -> np.ndarray:
    """values[j] * base ** j, for values below 2 ** 21, as code points are; sums of two are below 2 ** 63."""
    power = prime_powers(base, len(values))[: len(values)]
    high = values * (power >> _U(31))
    return ((high & _LOW30) << _U(31)) + (high >> _U(30)) + values * (power & _LOW31)


def prime_whole(values: np.ndarray, base: int) -> int:
    """The last entry of prime_prefixes, for values below 2 ** 21."""
    terms = _scaled(values, base)
    return ((int((terms >> _U(32)).sum()) << 32) + int((terms & _U(0xFFFFFFFF)).sum())) % PRIME


def prime_prefixes(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix polynomial modulo PRIME: entry i is the sum of values[j] * base ** j over j < i."""
    small = not len(values) or values.max() < 1 << 21
    terms = _scaled(values, base) if small else times(values, prime_powers(base, len(values))[: len(values)])
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    # Halves are summed apart, so that nothing overflows; the upper one counts 2 ** 32 times.
    high, low = np.cumsum(terms >> _U(32), dtype=np.uint64), np.cumsum(terms & _U(0xFFFFFFFF), dtype=np.uint64)
    high = _reduce(high)
    out[1:] = _reduce(_reduce(((high << _U(32)) & _P) + (high >> _U(29))) + _reduce(low))
    return out


class Block:
    """Some documents as one byte array in which a space follows each text."""

    def __init__(self, rows: pa.RecordBatch, raw: list[bytes]):
        self.rows, self.raw = rows, raw
        self.buf = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size

    def __len__(self) -> int:
        return len(self.raw)

    def ids(self) -> list:
        return self.rows.column("doc_id").to_pylist()

    def words(self) -> None:
        """Sets w_start, w_end (bytes), first and last (the words of each document) of runs without white space."""
        solid = ~SPACE[self.buf]
        edge = np.flatnonzero(np.diff(solid.view(np.int8), prepend=np.int8(0)))
        self.w_start, self.w_end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.w_start, self.start)
        self.last = np.searchsorted(self.w_start, self.end)
        self.n_words = self.last - self.first

    def word_hashes(self, lower: bool) -> np.ndarray:
        return keyed_hashes((SYMBOL_LOWER if lower else SYMBOL), self.buf, self.w_start, self.w_end)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null: none."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], limit: int = BLOCK) -> Iterator[Block]:
    """Blocks of about limit bytes; a longer text is a block of its own."""
    for batch in batches:
        raw, at, size = as_bytes(batch.column("text")), 0, 0
        for i, x in enumerate(raw):
            if size and size + len(x) > limit:
                yield Block(batch.slice(at, i - at), raw[at:i])
                at, size = i, 0
            size += len(x) + 1
        if at < len(raw):
            yield Block(batch.slice(at), raw[at:])


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive 64-bit values (none if there are fewer)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out *= _U(BASE)
        out += values[i : i + n]
    return mix(out)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
