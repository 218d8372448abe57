"""The corpus pipeline: documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. Stages before the last return the columns of documents.

1. language_id: a byte convolutional network, learned from the labelled rows and from characters drawn at random, names
   each text's language, or none. Texts without a letter are rejected, and those of which more than half is in no
   language; the limit rises where held-out labelled texts would go. Documents without a lang get the one that is named.
   Where nothing could be learned every text with a letter stays.
2. line_dedup: lines on too many of a source's pages leave the texts; n_chars follows the text that is left.
3. jaccard_join: of texts that hang together by a Jaccard similarity of 0.8 or more over five-word shingles, the one with
   the smallest id stays.
4. mixing: the rows in the order of a Pfair schedule of their sources; none is dropped or repeated.
5. bpe: token ids of every text, and whether they decode to the same text.

Defined results: a document is an id and a text: of rows that repeat both one stays, and rows that share only an id are
documents of their own; a null id is an id like another; documents are told apart by 64 bits; a null text is rejected by
the first stage; empty tables go through every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, forest_join, language_id, line_dedup, mixing
from shelfmark.session import checkpointed, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
VOCABULARY = "byte_bpe_50k.json"


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language, as far as one can tell; those without a lang get the network's."""
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs, background=True)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = language_id.predict(docs, model, carry=("text", "lang", "source", "n_chars"))
    known, score = F.col("lang_pred") != language_id.UNKNOWN, F.col("score")
    # a score of 0 is that of texts without a letter
    kept = named.where(known | (score > 0) & (score <= language_id.no_language_limit(docs, model)))
    return kept.withColumn("lang", F.coalesce("lang", F.when(known, F.col("lang_pred")))).select(*COLUMNS)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats."""
    found = line_dedup.dedup_lines(docs.select(*COLUMNS))
    changed = F.when(F.col("__removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", changed).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, one without an id last."""
    docs = docs.select(*COLUMNS).withColumn("__key", F.xxhash64("doc_id", "text"))
    found = forest_join.similar(docs, "__key").select("__key", "class_id").distinct()
    named = checkpointed(docs.select("__key", "doc_id").distinct().join(found, "__key"))
    first = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__key")).alias("k"))
    dropped = named.join(first.select("k.__key"), "__key", "left_anti").select("__key")
    return docs.join(dropped, "__key", "left_anti").dropDuplicates(["doc_id", "text"]).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mix."""
    return mixing.in_mixed_order(docs.select(*COLUMNS), COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and whether they decode to the text."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), check=True)


STAGES = [
    ("language_id", by_language), ("line_dedup", without_boilerplate), ("jaccard_join", without_near_copies),
    ("mixing", mixed), ("bpe", tokens),
]

#: A trained network is not SQL's; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
