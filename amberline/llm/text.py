"""Whole-batch work on UTF-8 texts with NumPy: words, hashes, rolling windows.

An Arrow string column is one byte buffer with offsets, so words and hashes of all its
rows are found together, in slices of about ``SLICE`` bytes that bound the memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

SLICE = 1 << 20

SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: digits, a-z, all from 0x80.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(20240116)
_TABLES = [_rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
_BASES = [int(x) | 1 for x in _rng.integers(2**61, 2**63, 4, dtype=np.uint64)]
#: Bytes of a word that the running sums hash.
SHORT = 32
_PLACE_BITS = 6
PLACES = 1 << _PLACE_BITS
_PLACES = [_rng.integers(0, 2**64, PLACES * 256, dtype=np.uint64) for _ in range(2)]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse) modulo 2**64 for i < n, kept between calls."""
    key = (base, inverse)
    if len(_powers.get(key, ())) < n:
        size = max(n + n // 8, 1 << 16)
        step = pow(base, -1, 1 << 64) if inverse else base
        out = np.full(size, step, np.uint64)
        out[0] = 1
        _powers[key] = np.multiply.accumulate(out)
    return _powers[key][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (1 << 64) - 1], np.uint64))[0])


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and its offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    data, off = rows_of(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each row (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    w = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    before &= ~edge[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    after &= ~edge[1:]
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word (or other span).

    Up to ``SHORT`` bytes a polynomial modulo 2**64, over running sums of all bytes. Among longer
    words there are patterns that collide whatever the base, so those get the sum of a random
    number for each byte at its place in the word.
    """
    n, sizes = len(data), ends - starts
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLES[which][data] * powers(_BASES[which], n), out=total[1:])
    h = (total[ends] - total[starts]) * powers(_BASES[which], n + 1, True)[starts]
    if len(far := np.flatnonzero(sizes > SHORT)):
        h[far] = _placed(data, starts[far], sizes[far], which)
    return mix(h + sizes.astype(np.uint64) * np.uint64(_BASE))


def _placed(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: int) -> np.ndarray:
    """The sum over each span of a random number for the byte and its place."""
    place = spread(np.zeros(len(sizes), np.int64), sizes)
    each = data[np.repeat(starts, sizes) + place]
    h = _PLACES[which][((place & (PLACES - 1)) << 8) | each]
    late = np.flatnonzero(place >= PLACES)
    h[late] = mix(h[late] + (place[late] >> _PLACE_BITS).astype(np.uint64) * np.uint64(_BASE))
    return np.add.reduceat(h, np.concatenate([[0], np.cumsum(sizes)[:-1]]))


def windows(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A hash of each run of n items; one entry for each start from 0 to len(h) - n."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    base = _BASES[2 + which]
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(base, len(h)), out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(base, len(h) + 1, True)[: len(h) - n + 1])


def within(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which starts 0 .. total - n have all n items in one row; first: as from words()."""
    ok = np.ones(max(0, total - n + 1), bool)
    if len(ok):
        # a start is bad if a row begins among its later items
        marks = np.zeros(total + 2, np.int32)
        inner = np.unique(first[(first > 0) & (first < total)])
        np.add.at(marks, np.maximum(inner - n + 1, 0), 1)
        np.add.at(marks, inner, -1)
        ok = np.cumsum(marks[: len(ok)]) == 0
    return ok


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + counts[i] - 1."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the half-open spans."""
    d = np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(d)[:n] > 0


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours; len(h) - w + 1 entries."""
    out, k = h, 1
    while k * 2 <= w:
        out = np.minimum(out[:-k], out[k:])
        k *= 2
    return np.minimum(out[: len(out) - (w - k)], out[w - k :]) if w > k else out


def sliding_max(h: np.ndarray, w: int) -> np.ndarray:
    """The greatest of each w neighbours; len(h) - w + 1 entries."""
    out, k = h, 1
    while k * 2 <= w:
        out = np.maximum(out[:-k], out[k:])
        k *= 2
    return np.maximum(out[: len(out) - (w - k)], out[w - k :]) if w > k else out


def pack(fields: list[np.ndarray], text: bytes = b"") -> bytes:
    """Arrays of one length and a text, compressed."""
    head = np.array([len(fields), len(fields[0])], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(x.astype(np.int64).tobytes() for x in fields) + text)


def unpack(pack: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(pack)
    k, n = np.frombuffer(raw, np.int64, 2)
    fields = np.frombuffer(raw, np.int64, k * n, 16).reshape(k, n)
    return list(fields), raw[16 + 8 * k * n :]
