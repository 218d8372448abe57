"""Pairs that can match, without comparing everything with everything.

Each left row states what a partner must contain (a set of keys: all of them). Any one of these keys would do to
find all partners, so the one that is rarest among the right rows is used. Nothing is capped or sampled: a left row
whose rarest key is frequent simply has many true partners to be checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import checkpointed

_WORDS = 4


def _signature(keys) -> tuple[list, list]:
    """A fixed-size bit set of the keys: four 64-bit words."""
    places = F.transform(keys, lambda k: F.pmod(F.xxhash64(k), F.lit(64 * _WORDS)).cast("int"))

    def word(w: int):
        def add(bits, place):
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place % 64)
            return F.when((place >= 64 * w) & (place < 64 * (w + 1)), bits.bitwiseOR(bit)).otherwise(bits)

        return F.aggregate("_places", F.lit(0).cast("bigint"), add)

    return [places.alias("_places")], [word(w) for w in range(_WORDS)]


def _with_signature(df: DataFrame, prefix: str) -> DataFrame:
    first, words = _signature(F.col("keys"))
    return df.select("*", *first).withColumns({f"{prefix}{w}": c for w, c in enumerate(words)}).drop("_places")


def _chosen(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, scope, need, key: the rarest key of each requirement that can be met, how many right rows offer it (n), and
    the bit set of all its keys."""
    mine = [f"_l{w}" for w in range(_WORDS)]
    signed = _with_signature(left, "_l")
    wanted = signed.select("left_id", "scope", "need", F.explode("keys").alias("key"), *mine)
    # how often each wanted key is offered: keys alone are counted, rows follow for the chosen ones
    named = wanted.select("scope", "key").distinct()
    frequency = right.select("scope", F.explode("keys").alias("key")).groupBy("scope", "key").agg(F.count(F.lit(1)).alias("n")).join(named, ["scope", "key"], "left_semi")
    choice = F.min_by(F.struct("n", "key"), F.struct("n", "key"))
    chosen = (
        wanted.join(frequency, ["scope", "key"], "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .groupBy("left_id", "scope", "need", *mine)
        .agg(choice.alias("_c"))
        .where(F.col("_c.n") > 0)
        .select("left_id", "scope", "need", "_c.key", "_c.n", *mine)
    )
    return checkpointed(chosen)


def _fits(mine, theirs):
    """Are all bits of one set in the other?"""
    fits = F.lit(True)
    for l, r in zip(mine, theirs):
        fits = fits & (l.bitwiseAND(r) == l)
    return fits


def rarest_key_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (left_id, right_id) where some requirement of the left row may be met.

    left: left_id, scope, need (a label; a left row may have several alternative requirements), keys (array).
    right: right_id, scope, keys (array).

    Rows meet on the rarest key. Bit sets of all keys travel along, so most pairs that share this key but not the
    others are dropped in the join itself; the few false hits are left to the caller's exact test.
    """
    mine, theirs = [F.col(f"_l{w}") for w in range(_WORDS)], [F.col(f"_r{w}") for w in range(_WORDS)]
    chosen = _chosen(left, right)
    offered = _with_signature(right, "_r").select("right_id", "scope", F.explode("keys").alias("key"), *theirs)
    useful = offered.join(chosen.select("scope", "key").distinct(), ["scope", "key"], "left_semi")
    pairs = chosen.drop("n", "need").join(useful, ["scope", "key"]).where(_fits(mine, theirs)).select("left_id", "right_id")
    return spread(pairs, "left_id", "right_id").distinct()


#: Right rows with one key that are met in one place; the left rows go to all places of their key.
CELL = 1024


def met_on_rarest_key(left: DataFrame, right: DataFrame, mine: DataFrame, theirs: DataFrame, test: Column) -> DataFrame:
    """Each pair once, with scope and the facts of both sides, where some requirement may be met and the test holds.

    left and right: as for rarest_key_pairs. mine: left_id and facts; theirs: right_id and facts. The facts go to the keys, a
    few times a row, and the pairs are tested where they meet: no pair is shuffled, neither for its facts nor to find it
    twice. A pair that meets several requirements counts at the first of them.
    """
    bits, offers = [f"_l{w}" for w in range(_WORDS)], [F.col(f"_r{w}") for w in range(_WORDS)]
    chosen = _chosen(left, right).withColumn("_cells", F.ceil(F.col("n") / CELL).cast("int"))
    needs = F.array_sort(F.collect_list(F.struct("need", "key", "_cells", *bits)))
    asked = chosen.groupBy("left_id", "scope").agg(needs.alias("_needs")).select("left_id", "scope", "_needs", F.posexplode("_needs").alias("_at", "_need"))
    asked = asked.select("left_id", "scope", "_need.*", F.slice("_needs", F.lit(1), F.col("_at")).alias("_before")).join(mine, "left_id").drop("need")
    asked = asked.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1))).drop("_cells")
    offered = _with_signature(right, "_r").select("right_id", "scope", F.explode("keys").alias("key"), *offers)
    useful = offered.join(chosen.select("scope", "key", "_cells").distinct(), ["scope", "key"])
    held = useful.groupBy("right_id", *offers).agg(F.collect_list(F.struct("scope", "key", "_cells")).alias("_held")).join(theirs, "right_id")
    held = held.withColumn("_keys", F.transform("_held", lambda h: h["key"])).withColumn("_h", F.explode("_held")).select(
        *[c for c in held.columns if c != "_held"], "_keys", "_h.scope", "_h.key", F.pmod("right_id", F.col("_h._cells").cast("bigint")).cast("int").alias("_cell"))
    own = _fits([F.col(b) for b in bits], offers)
    earlier = F.exists("_before", lambda n: F.array_contains(F.col("_keys"), n["key"]) & _fits([n[b] for b in bits], offers))
    met = spread(asked, "scope", "key", "_cell").join(spread(held, "scope", "key", "_cell"), ["scope", "key", "_cell"])
    return met.where(own & test & ~earlier).drop("key", "_cell", "_before", "_keys", *bits, *[f"_r{w}" for w in range(_WORDS)])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Keep small rows that are much work each on all partitions; adaptive execution goes by bytes and would merge them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def grams(text, size: int = 3):
    """All substrings of the given length, or the text itself when it is shorter; none for an empty text."""
    n = F.length(text)
    positions = F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)))
    parts = F.transform(positions, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n > 0, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def all_grams(text, size: int = 3):
    """Substrings of every length up to the given one."""
    def of_width(width: int):
        positions = F.sequence(F.lit(1), F.greatest(F.length(text) - width + 1, F.lit(1)))
        return F.transform(positions, lambda i: F.substring(text, i, F.lit(width)))

    parts = F.flatten(F.array(*[of_width(w) for w in range(1, size + 1)]))
    return F.when(F.length(text) > 0, F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def prefixed(prefix: str, keys):
    return F.transform(keys, lambda k: F.concat(F.lit(prefix), k))
