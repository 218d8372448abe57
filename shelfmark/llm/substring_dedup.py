"""Substring dedup with fixed-block anchors.

A passage is a window of consecutive words. Words of a text that a window covers which also starts in a text with a
smaller id are removed; what is left of repeats is judged on the input, so the order of removal does not matter.

First the anchors: every text is cut into blocks of half a window, side by side, and their hashes are the index. Every
rolling window of half a window's width probes it. Any passage that two texts share holds a whole block of either text,
at the same place of the passage in both, so both probe that block, and places that no other text's probe has in common
are done with. Then the hits are extended: around each, the passages that hold it are hashed whole, the smallest id of
every hash is found, and passages of larger ids are removed; passages that follow one another make up maximal repeats.

Hashes travel in packed blobs, one for each bucket of texts and share of the hash space, about four bytes for a probed
word. Within a bucket equal hashes are reduced to the smallest and the largest id first, so that a passage which very
many texts hold is one entry for each bucket. Texts move once, to their bucket. Anchors use 24 bits of a hash within
its share, which lets a few false hits through to the second step; passages use 64 bits and their share.

Defined results: words are runs of bytes other than space and 09 to 0D, unchanged; a null text has none; rows with a
null id lose nothing and take nothing from others; rows that repeat an id take nothing from each other; an empty table
gives an empty one. Whole texts are used, whatever their length. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.grams import WORD_BASE, Words, chunks, mixed, powers, words_of

WINDOW = 50
#: Bytes of text of a bucket, about. There are as many shares of the hash space as buckets.
BUCKET_BYTES = 4 << 20
ANCHOR_BITS = 24
ALIGNED = np.uint32(1 << 31)
BLOB = "__dest int, __bucket int, __blob binary"
BLOB_SCHEMA = pa.schema([("__dest", pa.int32()), ("__bucket", pa.int32()), ("__blob", pa.binary())])


def planes(x: np.ndarray) -> bytes:
    """An array's bytes by significance: those of small numbers are mostly zero and compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplaned(data: memoryview, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).ravel()


def pack(ids: np.ndarray, places: np.ndarray, values: np.ndarray) -> bytes:
    """Entries (id, place, value), sorted by id and place."""
    fresh = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1)) if len(ids) else np.zeros(0, np.int64)
    counts = np.diff(np.append(fresh, len(ids))).astype(np.uint32)
    gaps = np.diff(places, prepend=0)
    gaps[fresh] = places[fresh]
    head = np.array([len(fresh), len(ids), values.dtype.itemsize], dtype=np.int64).tobytes()
    return b"".join([head, planes(np.diff(ids[fresh], prepend=0)), planes(counts), planes(gaps.astype(np.uint32)), planes(values)])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    view = memoryview(blob)
    n_ids, n, size = np.frombuffer(view[:24], np.int64).tolist()
    at = 24
    parts = []
    for count, kind in ((n_ids, np.int64), (n_ids, np.uint32), (n, np.uint32), (n, np.dtype(f"u{size}"))):
        end = at + count * np.dtype(kind).itemsize
        parts.append(unplaned(view[at:end], count, kind))
        at = end
    ids, counts, gaps, values = np.cumsum(parts[0]), parts[1].astype(np.int64), parts[2].astype(np.int64), parts[3]
    places = np.cumsum(gaps)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64) if n_ids else np.zeros(0, np.int64)
    if n_ids:  # each id counts its places from zero
        places -= np.repeat(places[starts] - gaps[starts], counts)
    return np.repeat(ids, counts), places, values


def entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a table of blobs."""
    found = [unpack(b) for b in table["__blob"].to_pylist()]
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def blobs(key: np.ndarray, ids: np.ndarray, places: np.ndarray, values: np.ndarray) -> list[tuple[int, bytes]]:
    """Entries packed by key; within a key in order of id and place."""
    order = np.lexsort((places, ids, key))
    key, ids, places, values = key[order], ids[order], places[order], values[order]
    edges = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key)) if len(key) else [0]
    return [(int(key[a]), pack(ids[a:b], places[a:b], values[a:b])) for a, b in zip(edges, edges[1:])]


def blob_table(to_dest: list[tuple[int, bytes]], to_bucket: list[tuple[int, bytes]], n: int) -> pa.Table:
    """Blobs for shares of the hash space, and finished answers for buckets, which pass through some share."""
    rows = [(d, -1, b) for d, b in to_dest] + [(k % n, k, b) for k, b in to_bucket]
    return pa.table(list(zip(*rows)) if rows else [[], [], []], schema=BLOB_SCHEMA)


class Bucket:
    """The texts of a bucket in order of id; texts of one id follow each other and count their words on."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        known = np.array([x is not None for x in table["__id"].to_pylist()], dtype=bool)
        ids = table["__id"].fill_null(0).to_numpy()
        batch = table.select(["__id", "__text"]).to_batches()[0] if table.num_rows else None
        self.pieces: list[Words] = [words_of(c.column(1)) for c in chunks(batch, 1)] if batch is not None else []
        self.n_rows = table.num_rows
        self.hashes = np.concatenate([np.zeros(0, np.uint64), *(p.hashes for p in self.pieces)])
        self.first = np.concatenate([[0], np.cumsum(np.concatenate([np.zeros(0, np.int64), *(p.counts for p in self.pieces)]))]).astype(np.int64)
        self.counts, self.ids, self.known = np.diff(self.first), ids, known
        # the order of rows that repeat an id follows from their words, so that it is the same in each step
        sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(self.hashes + np.arange(len(self.hashes), dtype=np.uint64)))))
        order = np.lexsort((sums[self.first[1:]] - sums[self.first[:-1]], ids))
        ahead = np.cumsum(self.counts[order]) - self.counts[order]
        fresh = np.flatnonzero(np.diff(ids[order], prepend=ids[order][0] - 1)) if len(ids) else np.zeros(0, np.int64)
        base = np.repeat(ahead[fresh], np.diff(np.append(fresh, len(ids))))
        self.offset = np.empty(len(ids), np.int64)
        self.offset[order] = ahead - base
        self.order = order

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word (in the bucket) and hash of every window of the texts with an id."""
        power, inverse = powers(WORD_BASE, len(self.hashes) + 1)
        sums = np.zeros(len(self.hashes) + 1, dtype=np.uint64)
        np.cumsum(self.hashes * power[:len(self.hashes)], out=sums[1:])
        n = np.where(self.known, np.maximum(self.counts - width + 1, 0), 0)
        row = np.repeat(np.arange(self.n_rows), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.first[row]
        return row, at, mixed((sums[at + width] - sums[at]) * inverse[at])

    def place(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The place of a word as the other steps know it: counted over the texts of its id."""
        return at - self.first[row] + self.offset[row]

    def words_at(self, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and word of places, the reverse of place()."""
        rows = self.order[(self.known & (self.counts > 0))[self.order]]
        start = np.searchsorted(self.ids[rows], ids, "left")
        stop = np.searchsorted(self.ids[rows], ids, "right")
        row = np.full(len(ids), -1, np.int64)
        step = start.copy()
        while True:  # as often as an id repeats
            here = np.flatnonzero((step < stop) & (row < 0))
            if not len(here):
                break
            r = rows[step[here]]
            inside = (places[here] >= self.offset[r]) & (places[here] < self.offset[r] + self.counts[r])
            row[here[inside]] = r[inside]
            step[here] += 1
        return row, self.first[row] + places - self.offset[row]


def reduced(hashes: np.ndarray, ids: np.ndarray, largest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of entries with one hash and several ids: which stay (those of the smallest id, or one each of the smallest and
    the largest), and which belong to such a hash."""
    order = np.lexsort((ids, hashes))
    h, i = hashes[order], ids[order]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(h)))
    low, high = np.repeat(i[start], size), np.repeat(i[start + size - 1], size)
    several = low != high
    stay = ~several | (i == low)
    if largest:
        edge = np.zeros(len(h), dtype=bool)
        edge[start], edge[start + size - 1] = True, True
        stay = ~several | edge
    out_stay, out_several = np.empty(len(h), dtype=bool), np.empty(len(h), dtype=bool)
    out_stay[order], out_several[order] = stay, several
    return out_stay, out_several


def probe(table: pa.Table, n: int, width: int) -> pa.Table:
    """Every rolling window of a bucket, with a mark on those that are blocks, to its share of the hash space."""
    bucket = Bucket(table)
    row, at, hashes = bucket.windows(width)
    ids, place = bucket.ids[row], bucket.place(row, at)
    block = (at - bucket.first[row]) % width == 0
    dest = ((hashes >> np.uint64(ANCHOR_BITS)) % np.uint64(n)).astype(np.int32)
    short = (hashes & np.uint64((1 << ANCHOR_BITS) - 1)).astype(np.uint32)
    stay, several = reduced(hashes, ids, largest=True)
    if several.any():  # a block of any of them is a block of those that stay
        marked = np.unique(hashes[several & block])
        at_mark = np.minimum(np.searchsorted(marked, hashes), max(len(marked) - 1, 0))
        block = block | (several & (marked[at_mark] == hashes if len(marked) else False))
    own = table["__bucket"][0].as_py()
    local = [(own, pack_sorted(ids[several], place[several]))] if several.any() else []
    values = np.where(block, short | ALIGNED, short)
    return blob_table(blobs(dest[stay], ids[stay], place[stay], values[stay]), local, n)


def pack_sorted(ids: np.ndarray, places: np.ndarray) -> bytes:
    order = np.lexsort((places, ids))
    return pack(ids[order], places[order], np.zeros(len(ids), np.uint8))


def answered(table: pa.Table, ids: np.ndarray, places: np.ndarray, n: int) -> pa.Table:
    """Answers for buckets, beside those that were finished before."""
    done = table.filter(pa.array(table["__bucket"].to_numpy() >= 0)).select(["__bucket", "__blob"])
    made = blobs(bucket_of(ids, n), ids, places, np.zeros(len(ids), np.uint8))
    new = pa.table(list(zip(*made)) if made else [[], []], schema=done.schema)
    return pa.concat_tables([done, new])


def bucket_of(ids: np.ndarray, n: int) -> np.ndarray:
    """The bucket of an id: the same arithmetic as in bucket_column."""
    return ((ids ^ (ids >> 17)) % n).astype(np.int32)


def bucket_column(id_col: str, n: int):
    own = F.col(id_col).cast("long")
    return F.coalesce(F.pmod(own.bitwiseXOR(F.shiftright(own, 17)), F.lit(n)).cast("int"), F.pmod(F.xxhash64("__text"), F.lit(n)).cast("int"))


def hits(table: pa.Table, n: int) -> pa.Table:
    """Places whose anchor hash is that of a block and is probed by several ids."""
    sent = table.filter(pa.array(table["__bucket"].to_numpy() < 0))
    if not sent.num_rows:
        return answered(table, np.zeros(0, np.int64), np.zeros(0, np.int64), n)
    ids, places, values = entries(sent)
    block = np.zeros(1 << ANCHOR_BITS, dtype=bool)
    short = values & ~ALIGNED
    block[short[values >= ALIGNED]] = True
    near = np.flatnonzero(block[short])
    ids, places, short = ids[near], places[near], short[near]
    _, several = reduced(short, ids, largest=False)
    return answered(table, ids[several], places[several], n)


def extend(bucket_table: pa.Table, answers: pa.Table, n: int, width: int) -> pa.Table:
    """The whole passages around hits, to their share of the hash space."""
    if not bucket_table.num_rows or not answers.num_rows:
        return blob_table([], [], n)
    bucket = Bucket(bucket_table)
    row, word = bucket.words_at(*entries(answers)[:2])
    row, word = row[row >= 0], word[row >= 0]
    half, total = width // 2, len(bucket.hashes)
    low = np.maximum(word - half, bucket.first[row])
    high = np.minimum(word, bucket.first[row] + bucket.counts[row] - width)
    fits = high >= low
    change = np.bincount(low[fits], minlength=total + 1) - np.bincount(high[fits] + 1, minlength=total + 1)[:total + 1]
    wanted = np.cumsum(change)[:total] > 0
    row, at, hashes = bucket.windows(width)
    keep = wanted[at]
    row, at, hashes = row[keep], at[keep], hashes[keep]
    ids, place = bucket.ids[row], bucket.place(row, at)
    stay, _ = reduced(hashes, ids, largest=False)
    dest = (mixed(hashes) % np.uint64(n)).astype(np.int32)
    own = bucket_table["__bucket"][0].as_py()
    local = [(own, pack_sorted(ids[~stay], place[~stay]))] if not stay.all() else []
    return blob_table(blobs(dest[stay], ids[stay], place[stay], hashes[stay]), local, n)


def later(table: pa.Table, n: int) -> pa.Table:
    """Places of passages that start in a text with a smaller id too."""
    sent = table.filter(pa.array(table["__bucket"].to_numpy() < 0))
    if not sent.num_rows:
        return answered(table, np.zeros(0, np.int64), np.zeros(0, np.int64), n)
    ids, places, hashes = entries(sent)
    stay, _ = reduced(hashes, ids, largest=False)
    return answered(table, ids[~stay], places[~stay], n)


def joined(words: Words, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    starts, sizes = words.starts[kept], (words.ends - words.starts)[kept]
    text = np.repeat(np.arange(len(words.counts)), words.counts)[kept]
    gap = np.append(text[1:] == text[:-1], False).astype(np.int64) if len(text) else np.zeros(0, np.int64)
    length = sizes + gap
    ends = np.cumsum(length)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint8)
    source = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    target = np.repeat(ends - length, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[target] = words.data[source]
    per_text = np.bincount(text, weights=length, minlength=len(words.counts)).astype(np.int64) if len(text) else np.zeros(len(words.counts), np.int64)
    offsets = np.concatenate(([0], np.cumsum(per_text))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(words.counts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def trim(bucket_table: pa.Table, answers: pa.Table, width: int, id_col: str) -> pa.Table:
    """id, n_words, n_removed and the text that is left, for the texts of a bucket."""
    schema = pa.schema([(id_col, pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.large_string())])
    if not bucket_table.num_rows:
        return schema.empty_table().cast(pa.schema([(f.name, pa.string() if f.name == "text" else f.type) for f in schema]))
    bucket = Bucket(bucket_table)
    total = len(bucket.hashes)
    change = np.zeros(total + 1, dtype=np.int64)
    if answers.num_rows:
        row, word = bucket.words_at(*entries(answers)[:2])
        word = word[row >= 0]
        change += np.bincount(word, minlength=total + 1) - np.bincount(word + width, minlength=total + 1)[:total + 1]
    kept = np.cumsum(change)[:total] == 0
    removed = np.concatenate(([0], np.cumsum(~kept)))
    texts, at = [], 0
    for piece in bucket.pieces:
        texts.append(joined(piece, kept[at:at + len(piece.hashes)]).cast(pa.string()))
        at += len(piece.hashes)
    return pa.table({
        id_col: bucket_table["__id"], "n_words": pa.array(bucket.counts), "n_removed": pa.array(removed[bucket.first[1:]] - removed[bucket.first[:-1]]),
        "text": pa.chunked_array(texts, pa.string())})


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """id, n_words, n_removed and text (the words that are left, joined by one space) of every row."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = max(1, -(-int(size) // BUCKET_BYTES))
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).select(
        bucket_column("__id", n).alias("__bucket"), "__id", "__text")
    reply = "__bucket int, __blob binary"

    def fresh() -> DataFrame:  # columns of its own for each use; Spark shuffles the texts once
        return texts.toDF(*texts.columns)

    probes = fresh().groupBy("__bucket").applyInArrow(lambda t: probe(t, n, width // 2), BLOB)
    near = probes.groupBy("__dest").applyInArrow(lambda t: hits(t, n), reply)
    passages = fresh().groupBy("__bucket").cogroup(near.groupBy("__bucket")).applyInArrow(lambda a, b: extend(a, b, n, width), BLOB)
    repeats = passages.groupBy("__dest").applyInArrow(lambda t: later(t, n), reply)
    return fresh().groupBy("__bucket").cogroup(repeats.groupBy("__bucket")).applyInArrow(
        lambda a, b: trim(a, b, width, id_col), f"`{id_col}` long, n_words long, n_removed long, text string")
