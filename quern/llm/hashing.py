"""Hashes of the words of many texts at once, in numpy.

Words are runs of bytes other than ASCII white space, which are the same words in UTF-8 as in code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer text is hashed alone.
CHUNK_BYTES = 1 << 20

_SPACE = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every bit depends on all bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


_BYTES = stream(1, 256)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 64)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, 0xD6E8FEB86659FD93, np.uint64)]))
    return _powers


@dataclass
class Words:
    """The words of texts ``first`` to ``first + len(ends)``: hashes of all, and where each text's words end."""

    first: int
    hashes: np.ndarray
    ends: np.ndarray
    prefixes: np.ndarray | None = None

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and n + 1 offsets; nulls are empty."""
    texts = pa.array(texts) if not isinstance(texts, pa.Array) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return data, offsets


def word_hashes(texts: pa.Array, fold: bool = False, separators: np.ndarray = _SPACE, prefix: int = 0) -> Iterator[Words]:
    """Words of consecutive texts, some at a time.

    ``fold``: A-Z count as a-z. ``separators``: which bytes part words. ``prefix``: also hash so many first bytes.
    """
    if not len(texts):
        return
    data, offsets = text_buffer(texts)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK_BYTES, side="right")) - 1)
        yield _words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], low, _FOLDED if fold else _BYTES, separators, prefix)
        low = high


def _words(data: np.ndarray, offsets: np.ndarray, first: int, table: np.ndarray, separators: np.ndarray, prefix: int) -> Words:
    ends_of_texts = offsets[1:]
    word = ~separators[data]
    begins, stops = word.copy(), word.copy()
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    if len(data) > 1:
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
    begins[inner] = word[inner]
    stops[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(stops) + 1 - starts
    if not len(starts):
        none = np.empty(0, np.uint64)
        return Words(first, none, np.zeros(len(ends_of_texts), np.int64), none if prefix else None)
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(at, lengths)
    values = table[data[word]] * powers(int(lengths.max()))[place]
    found = Words(first, mixed(np.add.reduceat(values, at)), np.searchsorted(starts, ends_of_texts))
    if prefix:
        found.prefixes = mixed(np.add.reduceat(np.where(place < prefix, values, np.uint64(0)), at) ^ np.uint64(0x2545F4914F6CDD1D))
    return found


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` words; also across texts, which callers leave out."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    factors = stream(2, n)
    size = len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total += hashes[k : k + size] * factors[k]
    return mixed(total)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word runs of one text; of fewer words, the whole as one."""
    if not len(hashes):
        return hashes
    return np.unique(gram_hashes(hashes, min(n, len(hashes))))
