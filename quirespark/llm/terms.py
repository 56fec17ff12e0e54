"""Words of whole columns of texts at once: bytes are mapped by a table, so that what parts words becomes a space."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are split at once; a longer text is split alone.
SLICE = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def byte_table(inside: Callable[[int], bool]) -> np.ndarray:
    """For each byte the one that stands for it: A-Z lower-cased, and a space for what is not ``inside`` a word.

    Bytes of 0x80 and above belong to characters outside ASCII and stay.
    """
    return np.array([ord(chr(b).lower()) if b < 0x80 and inside(b) else b if b >= 0x80 else 0x20 for b in range(256)], np.uint8)


LETTERS = byte_table(lambda b: chr(b).isalpha())
LETTERS_DIGITS = byte_table(lambda b: chr(b).isalnum())


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    """``texts`` as string arrays of about ``SLICE`` bytes without nulls, in order."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")))
        yield texts.slice(low, high - low)
        low = high


def mapped(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """``texts`` (large strings without nulls) with every byte mapped."""
    start, data = texts.offset, texts.buffers()[2]
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[start : start + len(texts) + 1]
    new = table[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(new))


def words(texts: pa.Array, table: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts``, one after another, and where those of each text begin and the last ones end."""
    lists = pc.ascii_split_whitespace(mapped(texts, table))
    flat, offsets = lists.flatten(), lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), before[offsets - offsets[0]].astype(np.int64)


def hashes(flat: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; every distinct word is hashed once."""
    codes = flat.dictionary_encode()
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in codes.dictionary.to_pylist()), np.uint64, len(codes.dictionary))
    return own[codes.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)


def gram_hashes(each: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` words in a row, also of those that lie in two texts."""
    size = max(len(each) - n + 1, 0)
    out = np.full(size, n, np.uint64)
    for j in range(n):
        out = (out ^ each[j : j + size]) * _ODD
        out ^= out >> np.uint64(31)
    return out


def inside_texts(offsets: np.ndarray, n: int) -> np.ndarray:
    """Where the ``n`` words in a row begin that lie in one text."""
    lasts = np.repeat(offsets[1:], np.diff(offsets))
    starts = np.arange(len(lasts))
    return starts[starts + n <= lasts]
