"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is
written as Parquet and reread. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import bpe_trie, jaccard_join, mixing, quality_classifier, substring_dedup
from rankflow.llm.common import cut, shared_folder, table

#: Hashes of rows up to which a list of them is broadcast; a longer one is joined by shuffle.
MOST_SENT = 1 << 18


def _unused(docs: DataFrame, name: str) -> str:
    """A name like ``name`` that no column has."""
    while name in docs.columns:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Rows are judged each, repeated ones and those without an id or a text as well (a null text as an empty one). Columns
    stay as they are, also those named like the classifier's. An empty table gives an empty result.
    """
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    aside = {c: _unused(docs, f"{c}_") for c in docs.columns if c in ("text_score", "meta_score", "score", "kept")}
    judged = quality_classifier.score(docs.withColumnsRenamed(aside), model)
    return judged.where("kept").select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows (five words, four fifths) the one with the least id stays.

    Rows are told apart by a 64-bit hash of all their columns, not by their id: of repeated rows one
    stays, rows that share an id but not their text are judged each, and rows without an id come
    after all others. Of equal ids the least hash stays. Wordless texts have no duplicates.
    """
    key = _unused(docs, "_row")
    marked = docs.withColumn(key, F.xxhash64(*[x for c in docs.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]))
    found = jaccard_join.near_duplicates(marked, ngram=5, percent=80, id_col=key)
    group = found.where("n_shingles > 0").groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias("group"), F.count("*").alias("copies"))
    members = cut(marked.groupBy(key).agg(F.min("doc_id").alias("id")).join(group, key))
    stays = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", key, "copies")).alias("first"))
    stays = cut(stays.select(f"first.{key}", "first.copies"))
    gone = cut(members.select(key).join(stays, key, "left_anti"))
    gone = F.broadcast(gone) if gone.count() <= MOST_SENT else gone  # texts are not shuffled for a short list
    rows = marked.join(gone, key, "left_anti")
    repeated = stays.where("copies > 1").select(key)
    if repeated.isEmpty():
        return rows.select(*docs.columns)
    return rows.join(repeated, key, "left_anti").unionByName(rows.join(repeated, key, "left_semi").dropDuplicates([key])).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 35 words that the corpus holds more than once are cut out of the texts.

    All rows stay, those without a text as they are; equal rows lose all windows. ``n_chars``, where there is one, counts what is left.
    """
    cut = substring_dedup.remove_repeats(docs, window=35)
    return cut.selectExpr(*[f"cast(length(text) as {docs.schema['n_chars'].dataType.simpleString()}) as n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One and a half times all words, sources weighing 3, 1, 2; taken documents repeat.

    Rows come shard by shard, each in its shuffled order. Rows without a word are never taken, rows without a source are a
    source of their own, repeated rows are taken each. An empty table gives an empty result.
    """
    return mixing.mix_in_order(docs, weights=(3, 1, 2), budget=1.5, max_repeats=2, with_shard=False)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every row and of what they decode to; a null text has no ids."""
    return bpe_trie.digest(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: A learned classifier and BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; every stage but the last is written to the shared folder and reread."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
