"""Words of texts and hashes of word windows, computed on whole Arrow columns at once.

A word is a run of bytes other than space and the controls 09 to 0D. Its hash is an XXH3 digest of its bytes, taken once
for each distinct word of a run of texts. A window's hash is a polynomial in the hashes of its words, taken from
prefix sums, so that it costs the same for every width. Polynomials modulo 2**64 tell apart windows of fewer than a
thousand words only: words and whole texts, which may be longer, are digested instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: The odd base of the polynomial in the words of a window.
WORD_BASE = 0xD6E8FEB86659FD93
#: The seed of the words' digests, and the key of those of whole texts.
SEED, KEY = 0xA0761D6478BD642F, b"words of texts"
#: Bytes of text that are worked on at once; a longer text is worked on by itself.
CHUNK_BYTES = 1 << 20

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.full(size, b, dtype=np.uint64)
            out[:1] = 1
            both.append(np.cumprod(out))
        have = both[0], both[1]
        if size == CHUNK_BYTES:
            _powers[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """All bits of x spread over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@dataclass
class Words:
    """Words of a run of texts: where each begins and ends in data, its hash, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(column: pa.Array, hashed: bool = True) -> Words:
    """The words of a string column, with their hashes if wanted; a null has none."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    edges = offsets - low
    space = SPACE[data]
    before, after = np.ones(len(data) + 1, dtype=bool), np.ones(len(data) + 1, dtype=bool)
    before[1:], after[:-1] = space, space
    before, after = before[:-1], after[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    before[inner], after[inner - 1] = True, True
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    words = Words(data, starts, ends, np.zeros(0, np.uint64), np.searchsorted(starts, edges))
    if hashed:
        words.hashes = digests(words)
    return words


def word_column(words: Words) -> pa.DictionaryArray:
    """The words as a column that holds each distinct one once."""
    sizes = words.ends - words.starts
    edges = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    at = np.repeat(words.starts - edges[:-1], sizes) + np.arange(edges[-1])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(edges), pa.py_buffer(words.data[at])]).dictionary_encode()


def digests(words: Words) -> np.ndarray:
    """64 bits of the digest of each word."""
    if not len(words.starts):
        return np.zeros(0, np.uint64)
    coded, one = word_column(words), xxhash.xxh3_64_intdigest
    own = np.fromiter((one(w, SEED) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    return own[coded.indices.to_numpy()]


def window_sums(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the words' polynomial, and the inverse powers to shift a window to the start."""
    power, inverse = powers(WORD_BASE, len(words.hashes) + 1)
    sums = np.zeros(len(words.hashes) + 1, dtype=np.uint64)
    np.cumsum(words.hashes * power[:len(words.hashes)], out=sums[1:])
    return sums, inverse


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every window of `width` words inside a text, and its hash."""
    sums, inverse = window_sums(words)
    n = np.maximum(words.counts - width + 1, 0)
    at = np.repeat(words.first[:-1] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return at, mixed((sums[at + width] - sums[at]) * inverse[at])


def whole(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of the digest of all words of each text, in order; 0 without words."""
    edges = words.first.tolist()
    own = b"".join(hashlib.blake2b(words.hashes[a:b].tobytes(), digest_size=16, key=KEY).digest() if b > a else bytes(16) for a, b in zip(edges, edges[1:]))
    halves = np.frombuffer(own, dtype=np.uint64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


def chunks(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text."""
    column = batch.column(text)
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1] if column.buffers()[1] else np.zeros(len(column) + 1, np.int64)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        stop = min(stop, len(column))
        yield batch.slice(start, stop - start)
        start = stop


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by their first `keys` columns, which hold integers."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(i)[-1] for i in range(keys)]
        same = np.ones(batch.num_rows, dtype=bool)
        for i, value in enumerate(last):
            same &= batch.column(i).to_numpy(zero_copy_only=False) == value.as_py()
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*kept, batch.slice(0, cut)])
            kept = []
        elif kept and any(kept[-1].column(i)[-1].as_py() != v.as_py() for i, v in enumerate(last)):
            yield pa.Table.from_batches(kept)
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield pa.Table.from_batches(kept)
