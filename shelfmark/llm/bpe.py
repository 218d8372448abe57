"""BPE encoding and decoding with a contiguous rank array.

A text is cut at special tokens and then into words by the vocabulary's pattern. Each short word is held as a contiguous
array of parts and one of the ranks of adjacent pairs: the smallest rank is sought by scanning, its boundary is deleted
and the neighbouring ranks are refreshed, until no pair has a rank. Words of like length are rows of one matrix, so that
a step is taken for all of them at once. Long words, where scanning would grow with the square of the length, use a heap
of the same ranks with the same result. Words seen are kept in a bounded table, for most words of a text are common. Rows are encoded where they are; nothing is shuffled.

Defined results: a null text is an empty one; an empty text has no ids; whole texts are encoded, whatever their length;
repeated rows give repeated results; an empty table gives an empty one. Ids outside the vocabulary decode to nothing;
bytes that are not UTF-8 decode to U+FFFD. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern that this family of vocabularies was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Its white space is Unicode's property, without the four separators U+001C to U+001F.
WORDS = regex.compile(PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
#: The same for texts within Latin-1, with the letters, numbers and white space of that range spelled out.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN_WORDS = re.compile(rf"""'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+""")
NONE = 1 << 30
#: Longer words, in bytes, use the heap.
SHORT_WORD = 192
#: Words kept with their ids from one batch to the next; beyond that only those stay that came up again.
KEPT_WORDS = 150_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encodes and decodes with the vocabulary file of a byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.of_byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.rank, self.made = {}, []
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[vocab[left] << 20 | vocab[right]] = r
            self.made.append(vocab[left + right])
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if self.special else None
        self.words: dict[str, bytes] = {}
        pairs = np.array(sorted((k, r) for k, r in self.rank.items()), dtype=np.int64).reshape(-1, 2)
        self.pairs, self.pair_ranks = pairs[:, 0].copy(), pairs[:, 1].astype(np.int32)
        self.made_ids, self.byte_ids = np.array(self.made, dtype=np.int32), np.array(self.of_byte, dtype=np.int32)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NONE where there is none or a part is missing (-1)."""
        if not len(self.pairs):
            return np.full(left.shape, NONE, dtype=np.int32)
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NONE).astype(np.int32)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of short words of like length, each a row of parts (-1 behind its end) and one of ranks."""
        longest, n = max(map(len, words)), len(words)
        sizes = np.array([len(w) for w in words])
        columns = np.arange(longest)
        parts = np.full((n, longest), -1, dtype=np.int32)
        parts[columns < sizes[:, None]] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ranks = np.full((n, longest), NONE, dtype=np.int32)
        ranks[:, :-1] = self.ranks_of(parts[:, :-1], parts[:, 1:])
        done, row, live, live_ranks = parts, np.arange(n), parts, ranks
        while len(row):
            at = live_ranks.argmin(axis=1)
            each = np.arange(len(row))
            low = live_ranks[each, at]
            go = low < NONE
            if not go.all():
                done[row[~go]] = live[~go]
                row, live, live_ranks, at, low, each = row[go], live[go], live_ranks[go], at[go], low[go], np.arange(go.sum())
                if not len(row):
                    break
            live[each, at] = self.made_ids[low]
            # the boundary goes: what stands behind it moves up by one
            moved = np.minimum(columns + (columns > at[:, None]), longest - 1)
            gone = np.minimum(columns + (columns >= at[:, None]), longest - 1)
            live, live_ranks = np.take_along_axis(live, moved, 1), np.take_along_axis(live_ranks, gone, 1)
            live[:, -1] = -1
            live_ranks[:, -1] = NONE
            behind = np.minimum(at + 1, longest - 1)
            live_ranks[each, at] = np.where(at < longest - 1, self.ranks_of(live[each, at], live[each, behind]), NONE)
            before = np.maximum(at - 1, 0)
            live_ranks[each, before] = np.where(at > 0, self.ranks_of(live[each, before], live[each, at]), live_ranks[each, before])
        kept = done >= 0
        ids, ends = done[kept].astype("<u4").tobytes(), np.concatenate(([0], np.cumsum(kept.sum(axis=1)) * 4)).tolist()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same for a long word: candidate pairs in a heap, stale ones skipped."""
        n = len(parts)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := self.rank.get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j < 0 or self.rank.get(parts[i] << 20 | parts[j]) != r:
                continue
            parts[i], parts[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] >= 0 and (q := self.rank.get(parts[left] << 20 | parts[after[left]])) is not None:
                    heapq.heappush(heap, (q, left))
        return [p for p in parts if p >= 0]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words, as little-endian 32-bit integers."""
        words = list(words)
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        order = np.argsort(sizes, kind="stable").tolist()
        words, data, sizes = [words[i] for i in order], [data[i] for i in order], np.sort(sizes)
        short = int(np.searchsorted(sizes, SHORT_WORD, "right"))
        ids, start = [], 0
        while start < short:
            end = min(short, start + max(1, 131_072 // int(sizes[start])))
            ids += self.merge(data[start:end])
            start = end
        ids += [np.array(self.merge_long([self.of_byte[b] for b in d]), dtype="<u4").tobytes() for d in data[short:]]
        return dict(zip(words, ids))

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        return (LATIN_WORDS if text.isascii() or within_latin(text) else WORDS).findall(text)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts as little-endian 32-bit integers; the strings of special tokens become those."""
        cut = []
        for text in texts:
            pieces = [text or ""]
            if self.cut and text and any(s in text for s in self.special):
                pieces = self.cut.split(text)
            cut.append([self.split(p) if k % 2 == 0 else p for k, p in enumerate(pieces)])
        words = set().union(*(p for pieces in cut for p in pieces[::2]))
        new = words - self.words.keys()
        if len(new) + len(self.words) > KEPT_WORDS:  # those that came up again are the common ones
            self.words = {w: self.words[w] for w in words - new}
        self.words.update(self.learn(new))
        known, out = self.words.__getitem__, []
        for pieces in cut:
            ids = [np.uint32(self.special[p]).astype("<u4").tobytes() if k % 2 else b"".join(map(known, p)) for k, p in enumerate(pieces)]
            out.append(ids[0] if len(ids) == 1 else b"".join(ids))
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]

    def decode_bytes(self, ids: bytes) -> bytes:
        known, n = self.bytes_of, len(self.bytes_of)
        listed = np.frombuffer(ids, dtype="<u4")
        if len(listed) and listed.max() >= n:
            listed = listed[listed < n]
        return b"".join(map(known.__getitem__, listed.tolist()))

    def decode(self, ids: bytes) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def within_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """id, n_tokens and ids of every row; with `check` also whether they decode to the text (round_trip)."""
    narrow = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for piece in pieces(batches):
            texts = piece.column(1).to_pylist()
            made = own.encode_many(texts)
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in made]))).astype(np.int32)
            values = np.frombuffer(b"".join(made), dtype="<i4")
            columns = [piece.column(0), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))]
            if check:
                columns.append(pa.array([own.decode(ids) == (t or "") for ids, t in zip(made, texts)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", "ids", *(["round_trip"] if check else [])])

    own_type = narrow.schema[0].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{id_col}` {own_type}, n_tokens long, ids array<int>" + (", round_trip boolean" if check else ""))


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids; null ids decode to an empty text."""
    narrow = tokens.select(id_col, F.coalesce(ids_col, F.array().cast("array<int>")).alias(ids_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [codec(path).decode(np.array([i for i in x if i is not None and i >= 0], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return narrow.mapInArrow(run, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: digests of the ids of every row and of what they decode to."""
    narrow = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for piece in pieces(batches):
            counts, of_ids, of_text = [], [], []
            for ids in own.encode_many(piece.column(1).to_pylist()):
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(own.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())],
                [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return narrow.mapInArrow(run, f"`{id_col}` {narrow.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small batches, so that what a task holds does not depend on Spark's batch size."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
