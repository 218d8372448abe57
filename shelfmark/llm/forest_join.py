"""N-gram Jaccard join with a MinHash LSH forest.

Texts are sets of word shingles. Each of several trees has a signature of its own, a sequence of minhashes. Spark sorts
the signatures of every tree by ranges, which lays each tree out as a prefix trie: what a text shares with its
neighbours in that order is the deepest branch on which it has company. A text is looked up at the full depth first; its
matched prefix is then shortened level by level, in all trees at once, until its own recall estimate reaches the target.
The estimate (`recalls`) follows from the text's size, which bounds the similarities that are possible at or above the
threshold, and from its own minhashes: a low minimum is more likely to be a partner's too. So texts end at different
depths. Two texts are candidates if in some tree they share the shorter one's prefix. Candidates are verified exactly.

Texts with equal words are one class and stand for each other. Only branches with company, at a level at which one of
their texts looks, are gathered. Texts of a branch are dealt into blocks, and pairs of blocks are cells of bounded size,
so that a prefix shared by very many texts is neither one task nor a list of pairs: a cell compares its texts in memory
and returns, for each text, how many links it has and the smallest text that it hangs together with. A pair that meets
in several trees counts in the first alone. First the cells compare signatures only; texts without a partner that could
reach the threshold drop out, and whole texts go only to the cells that need them. Components follow from the cells'
edges.

Defined results: words are runs of bytes other than space and 09 to 0D, compared as they are; a text of fewer words
than a shingle is one shingle; a text without words, or a null one, has no links and is a class of its own; a null id
comes back with a null class; rows that repeat an id with equal words are copies; an empty table gives an empty one.
Whole texts are compared, whatever their length. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import components
from shelfmark.llm.grams import chunks, mixed, whole, whole_groups, window_sums, windows, words_of
from shelfmark.session import checkpointed

WIDTH = 5
THRESHOLD = 0.8
TREES = 24
#: Minhashes of a tree's signature, two bytes each; prefixes are no longer.
DEPTH = 6
TARGET_RECALL = 0.9999
#: Ways in which a partner at the threshold may differ from a text, from a part of it to more than it, that an estimate weighs.
SHAPES = 5
#: Texts with so few shingles have fewer possible similarities.
FEW_SHINGLES = 16
#: Texts of a block; a cell holds two.
BLOCK_TEXTS = 512
#: A pair is dropped before verification if its minhashes agree so much less than the threshold (in deviations).
DEVIATIONS = 4.5
#: Pairs, and shingles, that are compared at once.
STEP = 1 << 16
#: Bytes of text that a task verifies at once, in whole groups.
GROUP_BYTES = 1 << 22


def least_similarity(n: int, threshold: float) -> float:
    """The lowest similarity at or above the threshold that a set of n shingles can have to another set."""
    found = [1.0]
    for union in range(n, int(n / threshold) + 1):
        both = int(np.ceil(union * threshold - 1e-9))
        if both <= n:
            found.append(both / union)
    return min(found)


def recalls(minima: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """For each text and depth 1, 2, ...: the chance to meet its least likely partner in one of the trees.

    minima (texts, trees, depth): the text's minhashes as parts of the hash space. sizes: its distinct shingles. A partner that
    holds a share c of the text's shingles and has e others agrees with a minimum m if it holds that shingle and none of
    the others is lower: c * (1 - m) ** e. Shapes go from e = 0 (a part of the text; the chance is the similarity
    itself, whatever the minima) to c = 1 (the text and more).
    """
    few = np.array([least_similarity(n, threshold) for n in range(1, FEW_SHINGLES + 1)])
    least = np.where(sizes <= FEW_SHINGLES, few[np.minimum(sizes, FEW_SHINGLES) - 1], threshold)
    free, worst = np.log1p(-np.minimum(minima, 1 - 1e-12)), None
    for step in np.linspace(0, 1, SHAPES):
        share = least + step * (1 - least)
        others = sizes * (share / least - 1)
        agree = share[:, None, None] * np.exp(free * others[:, None, None])
        found = 1 - np.prod(1 - np.cumprod(agree, axis=2), axis=1)
        worst = found if worst is None else np.minimum(worst, found)
    return worst


def depths(minima: np.ndarray, sizes: np.ndarray, threshold: float, recall: float) -> np.ndarray:
    """The depth at which each text looks for partners: the full one, shortened level by level until the target recall."""
    reached = recalls(minima, sizes, threshold) >= recall
    depth = np.full(len(sizes), minima.shape[2])
    while True:
        short = (depth > 1) & ~reached[np.arange(len(depth)), depth - 1]
        if not short.any():
            return depth
        depth[short] -= 1


def least_agreement(threshold: float, n: int) -> int:
    """So many of n minhashes agree at least, but for a chance of a few in a million, at the threshold."""
    return max(0, int(n * threshold - DEVIATIONS * (n * threshold * (1 - threshold)) ** 0.5))


def shingles(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, object]:
    """The hashes of all shingles of texts, the first of each text, and the words."""
    words = words_of(column)
    at, hashes = windows(words, width)
    counts = np.maximum(words.counts - width + 1, 0)
    few = (words.counts > 0) & (words.counts < width)
    if few.any():
        sums, inverse = window_sums(words)
        a, b = words.first[:-1][few], words.first[1:][few]
        place = np.concatenate(([0], np.cumsum(counts)))[:-1][few]
        hashes = np.insert(hashes, place, mixed((sums[b] - sums[a]) * inverse[a]))
        counts = counts + few
    return hashes, np.concatenate(([0], np.cumsum(counts))), words


def sign(batches: Iterator[pa.RecordBatch], width: int, trees: int, depth: int, threshold: float, recall: float) -> Iterator[pa.RecordBatch]:
    """For each text with words: id, two halves of the digest of its words, the depth at which it looks for partners, and
    the signatures of all trees, one after the other, two bytes of each minhash."""
    factors = np.random.default_rng(7).integers(1, 1 << 63, trees * depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        for piece in chunks(batch, 1):
            hashes, first, words = shingles(piece.column(1), width)
            sizes = np.diff(first)
            has = np.flatnonzero(sizes > 0)
            if not len(has):
                continue
            low = np.empty((len(has), trees * depth), dtype=np.uint64)
            at, sizes = first[:-1][has], sizes[has]
            for m, factor in enumerate(factors):
                low[:, m] = np.minimum.reduceat(hashes * factor, at)
            sizes = np.array([len(np.unique(hashes[a:a + n])) for a, n in zip(at.tolist(), sizes.tolist())])
            own = depths((low / 2.0**64).reshape(len(has), trees, depth), sizes, threshold, recall)
            rows = [r.tobytes() for r in mixed(low).astype(">u2")]
            yield pa.RecordBatch.from_arrays([
                piece.column(0).take(pa.array(has)), *(pa.array(half[has].view(np.int64)) for half in whole(words)),
                pa.array(own.astype(np.int32)), pa.array(rows, pa.binary())],
                ["__id", "__node", "__d2", "__depth", "__sig"])


def signatures(column: pa.Array, n: int) -> np.ndarray:
    """Minhashes (two bytes) of n rows."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u2").reshape(n, -1).astype(np.uint16)


def shared_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minhashes two signatures share from the front, along the last axis."""
    return np.logical_and.accumulate(a == b, axis=-1).sum(axis=-1)


def branches(batches: Iterator[pa.RecordBatch], top: int) -> Iterator[pa.RecordBatch]:
    """The branches on which a text has company, of texts sorted by tree and signature: __trie (tree and level), __prefix, __node,
    __looks (whether this level is the text's own).

    In sorted order the neighbours share the most. What lies beyond either end of a partition is not known; there company
    is assumed, and a text that turns out to be alone is dropped when branches are counted. Levels above `top` are nobody's.
    """
    held, before = None, None

    def found(tree: np.ndarray, own: np.ndarray, sig: np.ndarray, node: np.ndarray, company: np.ndarray) -> Iterator[pa.RecordBatch]:
        prefix = np.zeros(len(tree), dtype=np.uint64)
        for level in range(1, sig.shape[1] + 1):
            prefix = mixed(prefix * np.uint64(31) + sig[:, level - 1].astype(np.uint64) + np.uint64(1))
            here = np.flatnonzero((company >= level) & (own >= level)) if level >= top else []
            if len(here):
                yield pa.RecordBatch.from_arrays([
                    pa.array((tree[here] * 16 + level).astype(np.int32)), pa.array(prefix[here].view(np.int64)), pa.array(node[here]),
                    pa.array(own[here] == level)], ["__trie", "__prefix", "__node", "__looks"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), signatures(batch.column(2), batch.num_rows), batch.column(3).to_numpy())
        if held is not None:
            rows = tuple(np.concatenate((h, r)) for h, r in zip(held, rows))
        tree, _, sig, _ = rows
        common = np.where(tree[1:] == tree[:-1], shared_length(sig[1:], sig[:-1]), 0)
        ahead = np.concatenate(([sig.shape[1] if before is None else before], common))
        yield from found(*(r[:-1] for r in rows), np.maximum(ahead[:-1], common))
        held, before = tuple(r[-1:] for r in rows), ahead[-1]
    if held is not None:
        yield from found(*held, np.array([held[2].shape[1]]))


def pairs_in(table: pa.Table, threshold: float, trees: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (i, j) of candidates in the groups of a table sorted by group.

    A pair in a cell of two blocks has a row of each; it is left to the first tree that it meets in, at the level of the
    shorter prefix; its minhashes leave it a chance to reach the threshold.
    """
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    keys = [table.column(i).to_numpy() for i in range(4)]
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    group = np.cumsum(change) - 1
    ends = np.append(np.flatnonzero(change)[1:], table.num_rows)[group]
    (tree, level), low, high = np.divmod(keys[0], 16), keys[2], keys[3]
    part, depth = table.column("__part").to_numpy(), table.column("__depth").to_numpy()
    sig = signatures(table.column("__sig"), table.num_rows)
    enough = least_agreement(threshold, sig.shape[1])
    others = ends - np.arange(table.num_rows) - 1
    total = np.concatenate(([0], np.cumsum(others)))
    row = 0
    while row < table.num_rows:
        stop = max(row + 1, int(np.searchsorted(total, total[row] + STEP, "right")) - 1)
        i = np.repeat(np.arange(row, stop), others[row:stop])
        j = i + 1 + np.arange(len(i)) - (total[i] - total[row])
        row = stop
        keep = ((part[i] != part[j]) | (low[i] == high[i])) & (np.minimum(depth[i], depth[j]) == level[i])
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        agree = sig[i] == sig[j]
        keep = agree.sum(axis=1) >= enough
        i, j, agree = i[keep], j[keep], agree[keep].reshape(-1, trees, sig.shape[1] // trees)
        met = np.logical_and.accumulate(agree, axis=2).sum(axis=2) >= level[i][:, None]
        keep = met.any(axis=1) & (met.argmax(axis=1) == tree[i])
        yield i[keep], j[keep]


def promising(batches: Iterator[pa.RecordBatch], threshold: float, trees: int) -> Iterator[pa.RecordBatch]:
    """The rows of each cell that have a candidate there."""
    for table in whole_groups(batches, 4):
        chosen = np.zeros(table.num_rows, dtype=bool)
        for i, j in pairs_in(table, threshold, trees):
            chosen[i] = chosen[j] = True
        if chosen.any():
            yield from table.filter(pa.array(chosen)).combine_chunks().to_batches()


def overlaps(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, marks: np.ndarray, mine: int, partners: np.ndarray) -> np.ndarray:
    """How many of the shingles of one text each partner has. marks is scratch, all False."""
    own = ids[starts[mine]:starts[mine] + sizes[mine]]
    marks[own] = True
    out = []
    for start in range(0, len(partners), 64):
        some = partners[start:start + 64]
        edges = np.concatenate(([0], np.cumsum(sizes[some])))
        at = np.repeat(starts[some] - edges[:-1], sizes[some]) + np.arange(edges[-1])
        out.append(np.add.reduceat(marks[ids[at]].astype(np.int32), edges[:-1]))
    marks[own] = False
    return np.concatenate(out)


def bounded(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    """Whole groups with about GROUP_BYTES of text together; more only if one group has more."""
    for table in tables:
        change = np.zeros(table.num_rows, dtype=bool)
        change[0] = True
        for k in range(4):
            key = table.column(k).to_numpy()
            change[1:] |= key[1:] != key[:-1]
        edges = np.append(np.flatnonzero(change), table.num_rows)
        sizes = np.concatenate(([0], np.cumsum(pc.binary_length(table.column("__text")).to_numpy())))[edges]
        start = 0
        while start < len(edges) - 1:
            stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + GROUP_BYTES, "right")) - 1)
            yield from table.slice(edges[start], edges[stop] - edges[start]).combine_chunks().to_batches()
            start = stop


def distinct_shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, the first of each text, and the hash of its words."""
    hashes, at, words = shingles(column, width)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[fresh], np.bincount(owner[fresh], minlength=len(at) - 1), whole(words)[0].view(np.int64)


def verify(batches: Iterator[pa.RecordBatch], threshold: float, width: int, trees: int) -> Iterator[pa.RecordBatch]:
    """For each text of a cell that has links there: node, how many rows it links to (copies counted), and the smallest
    node that it hangs together with in the cell."""
    for batch in bounded(whole_groups(batches, 4)):
        nodes = batch.column("__node").to_numpy()
        found = [distinct_shingles(p.column(1), width) for p in chunks(batch.select(["__node", "__text"]), 1)]
        # an id that repeats brings all its texts; each text counts once in a cell
        own = np.concatenate([f[2] for f in found]) == nodes
        same = np.ones(batch.num_rows, dtype=bool)
        for k in ("__trie", "__prefix", "__low", "__high", "__node"):
            key = batch.column(k).to_numpy()
            same[1:] &= key[1:] == key[:-1]
        same[0] = False
        same[1:] &= own[:-1]
        kept = np.flatnonzero(own & ~same)
        sizes_all = np.concatenate([f[1] for f in found])
        at = np.concatenate(([0], np.cumsum(sizes_all)))
        known, of = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        sizes, starts = sizes_all[kept], at[:-1][kept]
        table = pa.Table.from_batches([batch]).take(pa.array(kept)).drop_columns("__text").combine_chunks()
        if not table.num_rows:
            continue
        nodes, copies = table.column("__node").to_numpy(), table.column("__copies").to_numpy()
        marks, links, root = np.zeros(len(known), dtype=bool), np.zeros(table.num_rows, dtype=np.int64), np.arange(table.num_rows)

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i, j in pairs_in(table, threshold, trees):
            edges = np.flatnonzero(np.diff(i, prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(i))):
                mine, partners = int(i[a]), j[a:b]
                both = overlaps(of, starts, sizes, marks, mine, partners)
                linked = partners[both >= threshold * (sizes[mine] + sizes[partners] - both) - 1e-9]
                links[mine] += copies[linked].sum()
                links[linked] += copies[mine]
                for x in linked.tolist():
                    p, q = top(mine), top(x)
                    if p != q:
                        p, q = (p, q) if nodes[p] < nodes[q] else (q, p)
                        root[q] = p
        has = np.flatnonzero(links > 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes[has]), pa.array(links[has]), pa.array(np.array([nodes[top(x)] for x in has.tolist()], dtype=np.int64))],
            ["__node", "__links", "__root"])


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD,
            trees: int = TREES, depth: int = DEPTH, recall: float = TARGET_RECALL) -> DataFrame:
    """id, class_id (the smallest id of the texts that hang together by links) and n_links (other rows with a Jaccard
    similarity of at least the threshold, copies included) of every row."""
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    signed = checkpointed(texts.mapInArrow(
        lambda b: sign(b, width, trees, depth, threshold, recall), "__id long, __node long, __d2 long, __depth int, __sig binary"))
    classes = checkpointed(signed.groupBy("__node", "__d2").agg(
        F.min("__id").alias("__id"), F.count(F.lit(1)).alias("__copies"), F.first("__depth").alias("__depth"), F.first("__sig").alias("__sig")))
    top = classes.agg(F.min("__depth")).first()[0] or 1
    # the trees: a row for each text and tree, sorted; the node splits ranges of equal signatures
    trie = classes.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("__tree"), "__depth", "__sig", "__node").withColumn(
        "__sig", F.substring("__sig", F.col("__tree") * (2 * depth) + 1, F.lit(2 * depth)))
    order = ["__tree", "__sig", "__node"]
    under = checkpointed(trie.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        lambda b: branches(b, top), "__trie int, __prefix long, __node long, __looks boolean"))
    shared = under.groupBy("__trie", "__prefix").agg(F.count(F.lit(1)).alias("c"), F.bool_or("__looks").alias("looks")).where("c > 1 and looks").select(
        "__trie", "__prefix", F.ceil(F.col("c") / BLOCK_TEXTS).cast("int").alias("__blocks"))
    dealt = under.join(shared, ["__trie", "__prefix"]).withColumn("__part", F.pmod(F.xxhash64("__node"), F.col("__blocks")).cast("int")).withColumn(
        "x", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1))).select(
        "__trie", "__prefix", F.least("__part", "x").alias("__low"), F.greatest("__part", "x").alias("__high"), "__part", "__node")
    cell = ["__trie", "__prefix", "__low", "__high"]
    kept = [*cell, "__part", "__node", "__id", "__copies", "__depth", "__sig"]

    def in_cells(df: DataFrame) -> DataFrame:
        return df.repartition(*cell).sortWithinPartitions(*cell, "__node")

    narrow = dealt.join(classes, "__node").select(*kept)
    chosen = checkpointed(in_cells(narrow).mapInArrow(lambda b: promising(b, threshold, trees), narrow.schema))
    wanted = chosen.join(texts, "__id").select(*kept, "__text")
    linked = checkpointed(in_cells(wanted).mapInArrow(lambda b: verify(b, threshold, width, trees), "__node long, __links long, __root long"))
    labels = components(linked.select(F.col("__node").alias("__a"), F.col("__root").alias("__b")))
    counts = linked.groupBy("__node").agg(F.sum("__links").alias("__links"))
    known = classes.select("__node", "__d2", "__id", "__copies").join(counts, "__node", "left").join(labels, "__node", "left").withColumn(
        "__label", F.coalesce("__label", "__node"))
    smallest = known.groupBy("__label").agg(F.min("__id").alias("class_id"))
    answer = known.join(smallest, "__label").select("__node", "__d2", "class_id", (F.coalesce("__links", F.lit(0)) + F.col("__copies") - 1).alias("n_links"))
    found = signed.select("__id", "__node", "__d2").join(answer, ["__node", "__d2"]).select(F.col("__id").alias(id_col), "class_id", "n_links")
    wordless = F.col(id_col).isNull() | ~F.coalesce(F.col(text_col).rlike(r"[^ \t-\r]"), F.lit(False))
    own = F.col(id_col).cast("long")
    rest = docs.where(wordless).select(own.alias(id_col), own.alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return found.union(rest)
