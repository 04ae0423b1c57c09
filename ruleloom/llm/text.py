"""Bytes, words and word hashes of Arrow text columns, in numpy.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. A null text
has no words. Words are known by 64-bit hashes of their bytes; texts are taken in blocks of bounded size, and a text
longer than a block is cut between words, so whole texts of any length pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
LONG_WORD = 512

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Everything below 128 that is no letter parts words.
NOT_LETTERS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_draw = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _draw.integers(1, 2**64 - 1, 256, np.uint64, True)
_GRAM = _draw.integers(1, 2**64 - 1, 64, np.uint64, True) | np.uint64(1)
_POWER = np.cumprod(np.r_[np.uint64(1), np.full(LONG_WORD, _draw.integers(1, 2**63, dtype=np.uint64) | np.uint64(1))])


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value scrambled, one to one."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column and each value's bounds in them; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def _blocks(data: np.ndarray, bounds: np.ndarray, parting: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first byte, last byte, text bounds in between) of blocks; a long text is cut at a parting byte."""
    k, n = 0, len(bounds) - 1
    while k < n:
        last = max(k + 1, int(np.searchsorted(bounds, bounds[k] + BLOCK_BYTES, "right")) - 1)
        start, end = int(bounds[k]), int(bounds[last])
        if last == k + 1 and end - start > BLOCK_BYTES:
            while end - start > BLOCK_BYTES:
                cut = start + BLOCK_BYTES
                while cut < end and not parting[data[cut]]:
                    cut += 1
                yield start, cut, np.array([start, cut])
                start = cut
        yield start, end, bounds[k : last + 1] if start == bounds[k] else np.array([start, end])
        k = last


def _block_words(raw: np.ndarray, firsts: np.ndarray, lower: bool, parting: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the words of one block, hashes of the words and of their stems; ``firsts`` are the texts' first bytes."""
    inside = ~parting[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = firsts[firsts < len(raw)]
    begins[firsts] = inside[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    kept = np.flatnonzero(inside).astype(np.int32)
    heads = np.searchsorted(kept, starts.astype(np.int32))
    lengths = np.diff(np.r_[heads, len(kept)])
    place = kept - np.repeat(starts.astype(np.int32), lengths)
    letters = (LOWER if lower else SAME)[raw[kept]]
    values = _BYTE[letters]
    values *= _POWER[np.minimum(place, LONG_WORD)]
    hashes = np.add.reduceat(values, heads) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in np.flatnonzero(lengths > LONG_WORD):
        word = letters[heads[i] : heads[i] + lengths[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    stems = np.zeros(len(starts) if stem else 0, np.uint64)
    if stem:
        lead = (letters & 0xC0) != 0x80
        lead[heads] = True
        letter = np.cumsum(lead, dtype=np.int32)
        letter -= np.repeat(letter[heads] - 1, lengths)
        front = np.add.reduceat(np.where(letter <= stem, values, np.uint64(0)), heads)
        long = letter[heads + lengths - 1] >= stem
        stems[long] = mixed(front[long] ^ np.uint64(0x6A09E667F3BCC909))
    return starts, mixed(hashes), stems


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True, parting: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more bound at the end)."""
    return stemmed_hashes(data, bounds, lower, parting, 0)[:2]


def stemmed_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool, parting: np.ndarray, stem: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_hashes, and hashes of the words' first ``stem`` letters (UTF-8 code points), 0 for shorter words."""
    hashes, stems, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], np.zeros(len(bounds) - 1, np.int64)
    for start, end, inner in _blocks(data, bounds, parting):
        starts, h, s = _block_words(data[start:end], inner[:-1] - start, lower, parting, stem)
        text = np.searchsorted(bounds, starts + start, "right") - 1
        counts += np.bincount(text, minlength=len(counts)) if len(counts) else 0
        hashes.append(h)
        stems.append(s)
    return np.concatenate(hashes), np.r_[0, np.cumsum(counts)], np.concatenate(stems)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; the last n - 1 positions have none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(m, n, np.uint64)
    for k in range(n):
        total += words[k : k + m] * _GRAM[k % 64] if k < 64 else mixed(words[k : k + m] + np.uint64(k))
    return mixed(total)


def inner_grams(words: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, positions and texts of the n-word windows that lie within one text."""
    grams = gram_hashes(words, n)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(grams)]
    whole = np.flatnonzero(np.arange(len(grams)) + n <= at[1:][text]) if len(grams) else np.zeros(0, np.int64)
    return grams[whole], whole, text[whole]


def ranges(bounds: np.ndarray, most_bytes: int = 1 << 22, most_texts: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of texts that are together short enough, or one text alone."""
    k = 0
    while k < len(bounds) - 1:
        end = max(k + 1, int(np.searchsorted(bounds, bounds[k] + most_bytes, "right")) - 1)
        end = min(end, k + most_texts)
        yield k, end
        k = end
