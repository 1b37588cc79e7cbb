"""Vectorised words, windows and sorted hash arrays, for Arrow batches.

Words are found and hashed with whole-array operations over the bytes of many texts: a word's hash is a polynomial
over its bytes, taken from one running sum, then mixed. Windows of words are hashed the same way over word hashes.
"""

from __future__ import annotations

from functools import cache

import numpy as np

U = np.uint64
_BASE, _MIX1, _MIX2, _ODD = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed at once; memory is about 40 times that.
CHUNK = 2_000_000


def _is_space() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[32, *range(9, 14)]] = True
    return out


SPACE = _is_space()


@cache
def _byte_values(fold: bool) -> np.ndarray:
    values = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=U)
    if fold:
        values[65:91] = values[97:123]
    return values


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base=_BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; kept for sizes up to a few million."""
    key = int(base)
    have = _powers.get(key)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        inverse = U(pow(key, -1, 2**64))
        out = []
        for b in (base, inverse):
            a = np.full(size, b, U)
            a[0] = U(1)
            np.multiply.accumulate(a, out=a)
            out.append(a)
        have = tuple(out)
        if size <= 4 * CHUNK:
            _powers[key] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * _MIX1
    h = (h ^ (h >> U(27))) * _MIX2
    return h ^ (h >> U(31))


def window_hashes(h: np.ndarray, width: int, base=_BASE) -> np.ndarray:
    """Hash of every run of width consecutive values: len(h) - width + 1 of them."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U)
    pw, inverse = powers(len(h), base)
    total = np.empty(len(h) + 1, U)
    total[0] = 0
    np.cumsum(h * pw, out=total[1:])
    return mix((total[width:] - total[:n]) * inverse[:n] + U(int(width) * int(_ODD) % 2**64))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word of a byte array."""
    full = ~SPACE[buf]
    edge = np.flatnonzero(np.diff(full.view(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


def hash_words(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in order, and the offsets of each text's words. fold: A-Z count as a-z."""
    hashes, counts, at = [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK):
            size += len(texts[end])
            end += 1
        h, c = _hash_piece(texts[at:end], fold) if size <= 4 * CHUNK else _hash_long(texts[at], fold)
        hashes.append(h)
        counts.append(c)
        at = end
    offsets = np.zeros(len(texts) + 1, np.int64)
    if texts:
        np.cumsum(np.concatenate(counts), out=offsets[1:])
    return np.concatenate(hashes) if hashes else np.empty(0, U), offsets


def span_hashes(buf: np.ndarray, first: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hash of each span of a byte array."""
    pw, inverse = powers(len(buf))
    total = np.empty(len(buf) + 1, U)
    total[0] = 0
    np.cumsum(_byte_values(fold)[buf] * pw, out=total[1:])
    return mix((total[end] - total[first]) * inverse[np.minimum(first, max(len(buf) - 1, 0))] + (end - first).astype(U) * _ODD)


def _hash_piece(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(b" ".join(texts), np.uint8)
    first, end = word_spans(buf)
    h = span_hashes(buf, first, end, fold)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    upto = np.searchsorted(first, ends)
    return h, np.diff(upto, prepend=0)


def _hash_long(text: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """One very long text, cut at white space into pieces; a word longer than a piece stays whole."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + 2 * CHUNK)
        while end < len(text) and not SPACE[text[end]]:
            end += 1
        out.append(_hash_piece([text[at:end]], fold)[0])
        at = end
    h = np.concatenate(out)
    return h, np.array([len(h)])


def encode_texts(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches, most: int = 4_000_000):
    """Slices of record batches whose column ``text`` has about so many bytes; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        for a, n in zip(*runs(part), strict=True):
            yield batch.slice(a, n)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal values, and the length of each."""
    if not len(sorted_values):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return start, np.diff(start, append=len(sorted_values))


def contains(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each wanted value is among the sorted ones."""
    if not len(sorted_values):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == wanted


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[k], starts[k] + 1, ... for each k, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
