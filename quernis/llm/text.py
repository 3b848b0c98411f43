"""Words of a batch of texts as arrays: no Python object per word.

A word is a run of bytes outside space and ``\\t \\n \\v \\f \\r``. Texts are
handled in pieces of about a megabyte, cut between words, so memory follows
the longest word, not the longest text.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
U64 = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(0, 2**64, 256, dtype=U64)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, PIECE + 4096)
        for name, base in (("p", _P), ("i", pow(_P, -1, 2**64))):
            step = np.full(size, base, U64)
            step[0] = 1
            _POWERS[name] = np.multiply.accumulate(step)
    return _POWERS["p"], _POWERS["i"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Gives freed memory back to the system, so that Python workers kept for later tasks stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has this call
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, column: int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Parts of batches with some ``size`` bytes of text each, so that arrays of words stay small; a longer text is a part of its own."""
    for b in batches:
        total = np.cumsum(np.array(pc.fill_null(pc.binary_length(b.column(column)), 0), np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, end - at)
            at = end


def _cuts(data: np.ndarray, begin: int, end: int) -> Iterator[tuple[int, int]]:
    while begin < end:
        stop = begin + PIECE
        if stop >= end:
            yield begin, end
            return
        while stop < end:
            gap = np.flatnonzero(SPACE[data[stop : stop + 65536]])
            if len(gap):
                stop += int(gap[0])
                break
            stop += 65536
        stop = min(stop, end)
        yield begin, stop
        begin = stop


def spans(data: np.ndarray, off: np.ndarray, solo: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text number of every word of ``data``, where text ``k`` is ``data[off[k]:off[k+1]]``.

    With ``solo`` each character of scripts without blanks (U+3000 to U+9FFF) is a word.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = off[(off > 0) & (off < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    if solo and len(alone := np.flatnonzero((data >= 0xE3) & (data <= 0xE9))):
        after = alone + 3
        first[alone] = True
        last[alone[alone > 0] - 1] = word[alone[alone > 0] - 1]
        last[after - 1] = True
        after = after[after < len(data)]
        first[after] = word[after]
    begin = np.flatnonzero(first)
    return begin, np.flatnonzero(last) + 1, np.searchsorted(off, begin, "right") - 1


def hash_spans(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes, with A-Z as a-z if asked."""
    if not len(begin):
        return np.zeros(0, U64)
    p, inv = _powers(len(data) + 1)
    table = _BYTE[LOWER] if lower else _BYTE
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(table[data] * p[: len(data)], out=total[1:])
    return mix((total[end] - total[begin]) * inv[begin] + (end - begin).astype(U64) * U64(0xD6E8FEB86659FD93))


def located(data: np.ndarray, off: np.ndarray, lower: bool = True, solo: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin, end and text number of all words in order."""
    found, k, n = [], 0, len(off) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(off, off[k] + PIECE, "right")) - 1)
        for a, b in _cuts(data, int(off[k]), int(off[stop])) if stop == k + 1 else [(int(off[k]), int(off[stop]))]:
            begin, end, doc = spans(data[a:b], off[k : stop + 1] - a if stop > k + 1 else np.array([0, b - a]), solo)
            found.append((hash_spans(data[a:b], begin, end, lower), begin + a, end + a, doc + k))
        k = stop
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U64), none, none, none
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def word_hashes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where those of each text begin."""
    data, off = text_bytes(texts)
    h, _, _, doc = located(data, off, lower)
    at = np.zeros(len(off), np.int64)
    np.cumsum(np.bincount(doc, minlength=len(off) - 1), out=at[1:])
    return h, at


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; of the whole sequence if it is shorter."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = words[: n - size + 1].copy()
    for k in range(1, size):
        out = mix(out * U64(0xA24BAED4963EE407) + words[k : n - size + 1 + k])
    return np.unique(out)
