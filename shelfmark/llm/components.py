"""Connected components of a graph given by edges, with labels that spread in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """__node, __label (the smallest node of its component) of every node of the edges (__a, __b).

    Each round hangs a node's label, and that of its root, below the smallest label next to it, and then halves the
    paths, so that a component of n nodes takes about log n rounds. Minima are taken in part before each shuffle, so
    a node with many edges is no burden. Every round is written to the checkpoint folder.
    """
    pairs = edges.where("__a <> __b").select("__a", "__b").distinct()
    both = checkpointed(pairs.union(pairs.select("__b", "__a")).distinct())
    label = checkpointed(both.groupBy("__a").agg(F.min("__b").alias("m")).select(F.col("__a").alias("__node"), F.least("__a", "m").alias("__label")))
    while True:
        of_a, of_b = label.toDF("__a", "la"), label.toDF("__b", "lb")
        seen = both.join(of_a, "__a").join(of_b, "__b").where("lb < la")
        hung = seen.select(F.explode(F.array("__a", "la")).alias("__node"), F.col("lb").alias("__label"))
        low = label.union(hung).groupBy("__node").agg(F.min("__label").alias("__label"))
        up = low.toDF("__label", "upper")
        short = low.join(up, "__label").select("__node", F.least("__label", "upper").alias("__label"))
        new = checkpointed(short)
        changed = new.join(label.toDF("__node", "old"), "__node").where("old <> __label").limit(1).count()
        label = new
        if not changed:
            return label
