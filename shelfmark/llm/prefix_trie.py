"""The trie of conversations that begin alike, from adaptive radix trees.

A turn is a digest of its role and text, 16 bytes, big-endian; a conversation is the run of its turns' digests, its key. Keys
are sorted over the whole table and cut into ranges of bounded size. Each range is put into an adaptive radix tree in its
task: nodes grow from 4 over 16 and 48 to 256 places, and bytes without a branch are kept as one path. Only depths that
are whole turns give nodes of the trie.

In sorted order the conversations below a node lie side by side, so only nodes on the paths to a range's ends can be in two
tasks. A task is told the last key before its range and the first key after it; thus each node is counted in one task, and
the figures of a node in several tasks are sums of theirs, whatever the number of conversations that share it. Conversations
with one key are spread over ranges by their ids. The digest of the ids that end at a node is taken in their order, by one
task where they come from several, a range's text at a time: SHA-256 cannot be split.

Defined results: turns without a conv_id belong to no conversation; a null role or text is an empty one; a null turn number
comes first, equal ones go by the turn's digest, and repeated rows are turns of their own; a conversation without turns is a
member of the root; a conversation is held whole by one task, whatever its length and that of its texts; an empty table has no
root and gives an empty one. Turns are told apart by 128 bits of SHA-256. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.tables import written

TURN_BYTES = 16
#: Bytes of keys of a range, about; a key counts at least one turn.
RANGE_BYTES = 512 << 10
#: Ids whose text travels as one row.
CHUNK_IDS = 1 << 10
# Fixed value: the words of the query's contract.
WORD = r"[^\x20\x09-\x0D]+"

FIGURES = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
NODE = pa.schema([
    ("__task", pa.int32()), ("__node", pa.binary()), ("__parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("parent_conv_id", pa.int64()), *((c, pa.int64()) for c in FIGURES), ("__ends", pa.binary()), ("__texts", pa.list_(pa.string()))])
NODE_DDL = ("__task int, __node binary, __parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
            "n_leaves long, saved_tokens long, __ends binary, __texts array<string>")


def common(a: bytes, b: bytes) -> int:
    """How many first bytes two keys share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class Node:
    """A node of the radix tree: the path that leads into it, its children by byte, and the entry that ends here.

    Up to 4 or 16 children are two parallel rows in order of the byte; up to 48 have an index of 256 bytes; more have a
    place for each byte.
    """

    __slots__ = ("path", "size", "bytes", "kids", "entry")

    def __init__(self, path: bytes, entry: int = -1):
        self.path, self.size, self.bytes, self.kids, self.entry = path, 4, bytearray(), [], entry

    def child(self, byte: int) -> Node | None:
        if self.size <= 16:
            at = self.bytes.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.size == 48:
            at = self.bytes[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def add(self, byte: int, kid: Node) -> None:
        """A new child; a full node takes the next larger layout first."""
        if self.size <= 16:
            if len(self.kids) < self.size or self.size == 4:
                if len(self.kids) == self.size:
                    self.size = 16
                at = sum(b < byte for b in self.bytes)
                self.bytes.insert(at, byte)
                self.kids.insert(at, kid)
                return
            index = bytearray(256)
            for place, b in enumerate(self.bytes, 1):
                index[b] = place
            self.size, self.bytes = 48, index
        if self.size == 48:
            if len(self.kids) < 48:
                self.kids.append(kid)
                self.bytes[byte] = len(self.kids)
                return
            every: list[Node | None] = [self.kids[p - 1] if p else None for p in self.bytes]
            self.size, self.bytes, self.kids = 256, bytearray(), every
        self.kids[byte] = kid

    def children(self) -> list[Node]:
        return [k for k in self.kids if k is not None]

    def split(self, at: int) -> None:
        """The path is cut at a byte: what follows becomes the only child."""
        low = Node(self.path[at + 1:], self.entry)
        low.size, low.bytes, low.kids = self.size, self.bytes, self.kids
        byte = self.path[at]
        self.path, self.size, self.bytes, self.kids, self.entry = self.path[:at], 4, bytearray([byte]), [low], -1


class RadixTree:
    """An adaptive radix tree over byte keys; the value of a key is the number of its entry."""

    def __init__(self):
        self.root: Node | None = None

    def insert(self, key: bytes, entry: int) -> None:
        if self.root is None:
            self.root = Node(key, entry)
            return
        node, at = self.root, 0
        while True:
            path = node.path
            if not key.startswith(path, at):
                node.split(common(path, key[at:at + len(path)]))
            at += len(node.path)
            if at == len(key):
                node.entry = entry
                return
            kid = node.child(key[at])
            if kid is None:
                node.add(key[at], Node(key[at + 1:], entry))
                return
            node, at = kid, at + 1


def path_ids(key: bytes | None, turns: int) -> list[bytes]:
    """An identifier of each of a key's first prefixes, from none to `turns` turns."""
    running, out = hashlib.sha256(), []
    for d in range(turns + 1):
        if d:
            running.update(key[(d - 1) * TURN_BYTES:d * TURN_BYTES])
        out.append(running.digest()[:TURN_BYTES])
    return out


class Range:
    """The conversations of one range as a radix tree, and the nodes of the trie in it."""

    def __init__(self, task: int, keys: list[bytes], ids: list[int], words: list[list[int]], before: bytes | None, after: bytes | None):
        self.task, self.before, self.after = task, before, after
        fresh = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]]
        self.keys, self.words = [keys[i] for i in fresh], [words[i] for i in fresh]
        self.ends = [ids[a:b] for a, b in zip(fresh, [*fresh[1:], len(keys)])]
        self.tree = RadixTree()
        for entry, key in enumerate(self.keys):
            self.tree.insert(key, entry)
        # so many turns of the neighbours' keys are shared with this range
        self.shared_before = -1 if before is None else common(before, keys[0]) // TURN_BYTES
        self.shared_after = -1 if after is None else common(after, keys[-1]) // TURN_BYTES
        self.ids_before, self.ids_after = path_ids(before, self.shared_before), path_ids(after, self.shared_after)
        self.columns: dict[str, list] = {f.name: [] for f in NODE}

    def node(self, entry: int, turns: int, low: int, n: int, leaves: int, saved: int, tops: list[tuple[int, bool]], ends: list[int] | None):
        """Writes a node of the trie down; tops are the rows of its children. Returns its row, whether it is counted here,
        and the sums of its subtree."""
        key, size = self.keys[entry], turns * TURN_BYTES
        known_before = turns <= self.shared_before and key[:size] == self.before[:size]
        known_after = turns <= self.shared_after and key[:size] == self.after[:size]
        if not tops and not known_after:
            leaves += 1
        if turns:
            saved += (n - (not known_before)) * self.words[entry][turns - 1]
        own = self.ids_before[turns] if known_before else self.ids_after[turns] if known_after else None
        columns = self.columns
        row = len(columns["depth"])
        text = [",".join(map(str, ends[i:i + CHUNK_IDS])) for i in range(0, len(ends), CHUNK_IDS)] if ends else None
        values = (self.task, own, None, low, turns, None, n, sum(counted for _, counted in tops), leaves, saved,
                  hashlib.sha256(",".join(text).encode()).digest() if text and own is None else None, text if own is not None else None)
        for name, value in zip(columns, values):
            columns[name].append(value)
        for child, _ in tops:
            columns["parent_conv_id"][child] = low
            columns["__parent"][child] = own
        return row, not known_before, leaves, saved

    def nodes(self) -> pa.Table:
        """All nodes of the trie, children before their parents."""
        found: dict[int, tuple] = {}
        stack: list[tuple[Node, int, bool]] = [(self.tree.root, -1, False)]
        while stack:
            node, top, seen = stack.pop()
            bottom = top + 1 + len(node.path) if top >= 0 else len(node.path)
            if not seen:
                stack.append((node, top, True))
                stack.extend((kid, bottom, False) for kid in node.children())
                continue
            n, low, leaves, saved, entry, tops = 0, None, 0, 0, node.entry, []
            for kid in node.children():
                a, b, c, d, e, f = found.pop(id(kid))
                n, leaves, saved, tops = n + a, leaves + c, saved + d, tops + f
                low, entry = b if low is None else min(low, b), e if entry < 0 else entry
            ends = self.ends[node.entry] if node.entry >= 0 else None
            if ends:
                n, low = n + len(ends), ends[0] if low is None else min(low, ends[0])
            # whole turns on the way up to the branch above
            for turns in range(bottom // TURN_BYTES, top // TURN_BYTES, -1):
                at_end = ends if turns * TURN_BYTES == bottom else None
                row, counted, leaves, saved = self.node(entry, turns, low, n, leaves, saved, tops, at_end)
                tops = [(row, counted)]
            found[id(node)] = n, low, leaves, saved, entry, tops
        return pa.table([pa.array(v, f.type) for f, v in zip(NODE, self.columns.values())], schema=NODE)


def nodes_of(table: pa.Table) -> pa.Table:
    """The nodes of one range; rows with a side are the keys next to it."""
    side = table.column("__side").to_numpy()
    near = {s: k for s, k in zip(side.tolist(), table.column("__key").to_pylist()) if s}
    own = table.filter(pa.array(side == 0)).sort_by([("__key", "ascending"), ("__id", "ascending")])
    return Range(table.column("__task")[0].as_py(), own.column("__key").to_pylist(), own.column("__id").to_pylist(), own.column("__words").to_pylist(),
                 near.get(-1), near.get(1)).nodes()


def end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the texts of each node, which come in order; one text is held at a time."""
    own, running = None, None
    for batch in batches:
        for node, text in zip(batch.column(0), batch.column(1)):
            if node.as_py() != own:
                if own is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([running.digest()], pa.binary())], ["__node", "__ends"])
                own, running = node.as_py(), hashlib.sha256()
            else:
                running.update(b",")
            running.update(text.as_py().encode())
    if own is not None:
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([running.digest()], pa.binary())], ["__node", "__ends"])


def turn_digest(role: Column, text: Column) -> Column:
    """32 hex digits of a turn; the length of the role tells where the text begins."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * TURN_BYTES)


def sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """__id and __turns (digest and number of words, in order) of every conversation."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("__id"),
        F.struct(F.col(turn_col).alias("turn"), turn_digest(F.col(role_col), F.col(text_col)).alias("d"), F.regexp_count(text, F.lit(WORD)).alias("w")).alias("__turn"))
    ordered = F.sort_array(F.collect_list("__turn"))  # nulls first
    return turns.groupBy("__id").agg(ordered.alias("__turns")).select("__id", F.transform("__turns", lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("__turns"))


def rebuilt(own: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their family.

    Conversation c takes the first h turns of conversation c - c % family, h being crc32 of its decimal id modulo `most`,
    and goes on with its own turns after its first h.
    """
    heads = own.where(F.col("__id") % family == 0).select(F.col("__id").alias("__head"), F.slice("__turns", 1, most - 1).alias("__first"))
    joined = own.withColumn("__head", F.col("__id") - F.col("__id") % family).join(heads, "__head", "left")
    h = (F.crc32(F.col("__id").cast("string")) % most).cast("int")
    first = F.coalesce(F.slice("__first", F.lit(1), h), F.slice("__turns", 1, 0))
    rest = F.slice("__turns", h + 1, F.greatest(F.size("__turns") - h, F.lit(0)))
    return joined.select("__id", F.concat(first, rest).alias("__turns"))


def nodes(own: DataFrame) -> DataFrame:
    """conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every
    node of the trie of sequences (__id, __turns)."""
    keyed = written(own.select("__id", F.unhex(F.array_join(F.transform("__turns", lambda t: t["d"]), "")).alias("__key"), F.transform("__turns", lambda t: t["w"]).alias("__words")))
    size = keyed.agg(F.sum(F.octet_length("__key").cast("long") + TURN_BYTES)).first()[0] or 0
    ranges = max(1, -(-int(size) // RANGE_BYTES))
    cut = written(keyed.repartitionByRange(ranges, "__key", "__id").withColumn("__task", F.spark_partition_id()))
    # one row for each range
    edges = cut.groupBy("__task").agg(F.min("__key").alias("__first"), F.max("__key").alias("__last"))
    in_turn = Window.orderBy("__task")
    near = edges.select("__task", F.lag("__last").over(in_turn).alias("__before"), F.lead("__first").over(in_turn).alias("__after")).select(
        "__task", F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.col(k).alias("k")) for s, k in ((-1, "__before"), (1, "__after"))))).alias("__near"))
    neighbours = near.where("__near.k IS NOT NULL").select(
        "__task", F.col("__near.s").alias("__side"), F.col("__near.k").alias("__key"), F.lit(None).cast("long").alias("__id"), F.lit(None).cast("array<int>").alias("__words"))
    both = cut.select("__task", F.lit(0).alias("__side"), "__key", "__id", "__words").unionByName(neighbours)
    found = written(both.groupBy("__task").applyInArrow(nodes_of, NODE_DDL))

    # nodes that several ranges share: their figures add up
    border = found.where("__node IS NOT NULL")
    merged = border.groupBy("__node").agg(
        F.first("__parent").alias("__parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *(F.sum(c).alias(c) for c in FIGURES))
    texts = border.select("__node", "__task", F.posexplode("__texts").alias("__chunk", "__text")).repartition("__node").sortWithinPartitions("__node", "__task", "__chunk")
    digests = texts.select("__node", "__text").mapInArrow(end_digests, "__node binary, __ends binary")
    merged = written(merged.join(digests, "__node", "left"))
    parents = merged.select(F.col("__node").alias("__parent"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", *FIGURES, "__ends"]
    shared = merged.join(parents, "__parent", "left").select(*columns)
    # children of shared nodes learn the parent's name through their own range, so a node with very many children is no hot key
    of_range = border.select("__task", F.col("__node").alias("__parent")).join(parents, "__parent")
    inner = found.where("__node IS NULL")
    below = inner.where("__parent IS NOT NULL").drop("parent_conv_id").join(of_range, ["__task", "__parent"]).select(*columns)
    answer = inner.where("__parent IS NULL").select(*columns).union(below).union(shared)
    return answer.select(*columns[:-1], F.lower(F.hex(F.coalesce("__ends", F.unhex(F.sha2(F.lit(""), 256))))).alias("ends_sha256"))
