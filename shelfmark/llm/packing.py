"""Harmonic packing of token sequences.

A document is cut greedily at reciprocals of the capacity: the largest floor(capacity / k) that fits goes off as a piece,
until nothing is left. Pieces of one length are a class, which holds floor(capacity / length) of them in each of its
sequences, so that a piece's place follows from its number in the class alone. Every task numbers the pieces of its own
documents; one small table of (task, class, count) turns these into numbers of the whole class, and no worker waits for
another. What is left of a class is less than one sequence. It is cut at powers of two, and those pieces fill sequences in
the same way; their last sequences hold a power of two of ids each, which is not padded.

Padding comes only from capacities that a class's length does not divide: below length of a class in 2048.

Defined results: a null text is an empty one; every document ends with one id more, so an empty one has that id alone; a
piece lies in one sequence and has at least one id; repeated rows are documents of their own; ids of documents may be null
or repeat; long texts are cut like others; an empty table gives an empty one. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.grams import Words, chunks, word_column, words_of
from shelfmark.llm.tables import written

CAPACITY = 2048
END_ID = 1
#: Words, and ids, kept from one batch to the next; the tables start anew beyond that.
KEPT_WORDS, KEPT_IDS = 400_000, 4_000_000
#: Stands between words that are encoded together; words that hold it are encoded by themselves.
SEPARATOR = "\x01"
#: Bytes of ASCII letters and figures, and of stops.
PLAIN, STOP = (np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)]), np.isin(np.arange(256), list(b".,;:!?")))


class Encoder:
    """Ids by the tokenizers library, each distinct word once.

    The vocabulary's pattern never takes white space into a word and its rules for case and composition do not reach
    across it, so the ids of a text are those of its runs between white space.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        mark = self.one(SEPARATOR)
        self.mark = mark[0] if len(mark) == 1 else None
        self.forget()

    def forget(self) -> None:
        """Known words by slot, with where their ids begin and end."""
        self.slots: dict[bytes, int] = {}
        self.ids, self.edges = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def one(self, text: str) -> list[int]:
        return self.own.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def learn(self, words: list[bytes]) -> None:
        """The ids of new words."""
        texts = [w.decode("utf-8") for w in words]
        alone = [SEPARATOR in t or self.mark is None for t in texts]
        together = [t for t, own in zip(texts, alone) if not own]
        found = np.array(self.one(f" {SEPARATOR} ".join(together)), dtype=np.uint32)
        marks = found == self.mark
        counts = np.diff(np.flatnonzero(marks), prepend=-1, append=len(found)) - 1 if together else np.zeros(0, np.int64)
        rest = [self.one(t) for t, own in zip(texts, alone) if own]
        order = [w for w, own in zip(words, alone) if not own] + [w for w, own in zip(words, alone) if own]
        self.slots.update(zip(order, range(len(self.slots), len(self.slots) + len(order))))
        counts = np.concatenate((counts, np.array([len(i) for i in rest], dtype=np.int64)))
        self.edges = np.concatenate((self.edges, self.edges[-1] + np.cumsum(counts)))
        self.ids = np.concatenate((self.ids, found[~marks], *(np.array(i, dtype=np.uint32) for i in rest)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        words = pattern_parts(words_of(texts, hashed=False))
        if not len(words.starts):
            return np.zeros(0, np.uint32), np.zeros(len(words.counts), np.int64)
        if len(self.slots) > KEPT_WORDS or len(self.ids) > KEPT_IDS:
            self.forget()
        coded = word_column(words)
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.slots]
        if new:
            self.learn(new)
        slot = np.fromiter(map(self.slots.__getitem__, distinct), dtype=np.int64, count=len(distinct))[coded.indices.to_numpy()]
        starts, sizes = self.edges[slot], self.edges[slot + 1] - self.edges[slot]
        ahead = np.concatenate(([0], np.cumsum(sizes)))
        take = np.repeat(starts - ahead[:-1], sizes) + np.arange(ahead[-1])
        return self.ids[take], np.diff(ahead[words.first])


def pattern_parts(words: Words) -> Words:
    """Words with fewer distinct ones: ASCII capitals made small, and a stop cut off from the letters and figures beside it.

    The vocabulary makes letters small itself, and its pattern always ends a part there. Where a special token may stand,
    which counts as it is written, words stay as they are.
    """
    data = words.data
    if not len(words.starts) or (data[:-1] == ord("<"))[data[1:] == ord("|")].any():
        return words
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    plain, stop = PLAIN[data], STOP[data]
    cut = np.flatnonzero((plain[:-1] & stop[1:]) | (stop[:-1] & plain[1:])) + 1
    mark = np.zeros((2, len(data) + 1), dtype=bool)
    mark[0, words.starts] = mark[1, words.ends] = mark[:, cut] = True
    starts, ends = np.flatnonzero(mark[0]), np.flatnonzero(mark[1])
    moved = np.append(np.searchsorted(starts, words.starts), len(starts))
    return Words(data, starts, ends, words.hashes, moved[words.first])


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def first_cut(length: np.ndarray, capacity: int) -> np.ndarray:
    """The largest floor(capacity / k) that each length reaches."""
    return np.minimum(capacity // -(-capacity // np.maximum(length, 1)), length)


def cuts(totals: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and length of the pieces of documents of these lengths, in order."""
    whole = totals // capacity
    doc, start = np.repeat(np.arange(len(totals)), whole), (np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity
    found = [(doc, start, np.full(len(doc), capacity, dtype=np.int64))]
    doc, at = np.arange(len(totals)), whole * capacity
    while True:
        left = totals[doc] - at
        doc, at, left = doc[left > 0], at[left > 0], left[left > 0]
        if not len(doc):
            break
        size = first_cut(left, capacity)
        found.append((doc, at, size))
        at = at + size
    doc, start, size = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, doc))
    return doc[order], start[order], size[order]


def pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of every document with their ids (little-endian unsigned 32-bit integers), numbered in their task."""
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    id_type = narrow.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, had = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for part in chunks(batch, 1):
                flat, counts = encoder(path).encode(part.column(1))
                flat = np.insert(flat, np.cumsum(counts), np.uint32(end_id))
                totals = counts + 1
                begins = np.cumsum(totals) - totals
                doc, start, size = cuts(totals, capacity)
                order = np.argsort(size, kind="stable")
                fresh = np.flatnonzero(np.diff(size[order], prepend=0))
                number = np.empty(len(size), dtype=np.int64)
                runs = np.diff(np.append(fresh, len(size)))
                number[order] = np.arange(len(size)) - np.repeat(fresh, runs) + np.repeat(had[size[order][fresh]], runs)
                had[size[order][fresh]] += runs
                # pieces stand in the order of the ids, without gaps
                edges = np.append(begins[doc] + start, len(flat)).astype(np.int64) * 4
                ids = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(edges), pa.py_buffer(flat.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(doc)), pa.array(start), pa.array(size), pa.array(totals[doc]), ids.cast(pa.binary()),
                    pa.array(np.full(len(doc), task, dtype=np.int32)), pa.array(number)],
                    ["__id", "start", "length", "doc_tokens", "ids", "__task", "__number"])

    return narrow.mapInArrow(run, f"__id {id_type}, start long, length long, doc_tokens long, ids binary, __task int, __number long")


def in_order(lengths: DataFrame, count: Column) -> DataFrame:
    """Classes with the number of their first sequence; there are no more of them than lengths."""
    return lengths.withColumn("__base", F.coalesce(F.sum(count).over(Window.orderBy("length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens) with their sequence_id and the offset there. Sequence ids have no gaps."""
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("the capacity must be a power of two")
    cut = written(pieces(docs, path, id_col, text_col, capacity, end_id))
    # numbers of a class: those of a task follow those of the tasks before it
    by_task = cut.groupBy("length", "__task").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    shift = by_task.select("length", "__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    each = F.expr(f"CAST({capacity} AS BIGINT) DIV length")
    sizes = by_task.groupBy("length").agg(F.sum("__n").alias("__n"))
    full = in_order(sizes.withColumn("__full", F.expr(f"__n DIV ({capacity} DIV length)")), F.col("__full")).select("length", "__full", "__base")
    steps = written(shift.join(F.broadcast(full), "length"))  # at most `capacity` rows
    numbered = cut.join(steps, ["length", "__task"]).withColumn("__at", F.col("__number") + F.col("__shift"))
    packed = F.col("__at") < F.col("__full") * each
    output = ["__id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    whole = numbered.where(packed).withColumn("sequence_id", F.col("__base") + F.expr(f"__at DIV ({capacity} DIV length)")).withColumn(
        "offset", F.col("__at") % each * F.col("length")).select(*output)
    # fewer pieces of each class than one sequence holds
    rest = numbered.where(~packed)
    used = F.expr(f"""transform(filter(sequence({capacity.bit_length() - 1}, 0), b -> (length & shiftleft(CAST(1 AS BIGINT), b)) > 0),
        b -> named_struct('b', b, 'above', shiftright(length, b + 1)))""")
    small = rest.withColumn("__cut", F.explode(used)).select(
        "__id", "__task", "__number", F.col("length").alias("__class"), F.col("ids").alias("__ids"), "doc_tokens",
        F.expr("shiftleft(CAST(1 AS BIGINT), __cut.b)").alias("length"), F.expr("shiftleft(__cut.above, __cut.b + 1)").alias("__from"), F.col("start").alias("__start"))
    small = small.select("__id", "__class", "__task", "__number", (F.col("__start") + F.col("__from")).alias("start"), "length",
                         F.expr("substring(__ids, CAST(__from * 4 + 1 AS INT), CAST(length * 4 AS INT))").alias("ids"), "doc_tokens")
    small = written(small.withColumn("__at", F.row_number().over(Window.partitionBy("length").orderBy("__class", "__task", "__number", "start")).cast("long") - 1))
    # full sequences, then one for each power of two in the number of pieces left
    held = small.groupBy("length").agg(F.count(F.lit(1)).alias("__n")).withColumn("__full", F.expr(f"__n DIV ({capacity} DIV length)")).withColumn("__left", F.col("__n") % each)
    own = in_order(held, F.col("__full") + F.bit_count("__left"))
    first = full.agg(F.coalesce(F.sum("__full"), F.lit(0)).alias("__first"))
    placed = small.join(F.broadcast(own), "length").join(F.broadcast(first)).withColumn("__t", F.col("__at") - F.col("__full") * each)
    # of two numbers the highest bit in which they differ is set in the larger one: the power of two whose sequence holds the piece
    placed = placed.withColumn("__bit", F.expr("CAST(length(bin(__t ^ __left)) AS INT)"))
    late = F.expr("shiftleft(shiftright(__left, __bit), __bit)")
    packed = F.col("__t") < 0
    tail = placed.withColumn("sequence_id", F.col("__first") + F.col("__base") + F.when(packed, F.expr(f"__at DIV ({capacity} DIV length)")).otherwise(
        F.col("__full") + F.expr("bit_count(shiftright(__left, __bit))"))).withColumn(
        "offset", F.when(packed, F.col("__at") % each).otherwise(F.col("__t") - late) * F.col("length")).select(*output)
    return whole.union(tail).withColumnRenamed("__id", id_col)
