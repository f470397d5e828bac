"""Proportional stratified interleaving.

Rows of each source are put in a seeded random order, every row gets the fractional
rank (2 * rank - 1) / (2 * rows of its source), and the rows of all sources are laid
out by that fraction. Any run of consecutive rows then holds each source in its
proportion, so cutting the line into equal runs makes shards that all match the mixture.

Both rankings are distributed: a key is cut into 4,096 slices, slices are counted, and a
row's rank is the number of rows in earlier slices plus its row number within the slice.
No window runs over a whole source or over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.common import hex_cell, seeded_md5

#: Slices of a source's random order (three hex digits), and of the line of all rows.
SLICES = 4096


def interleave_shards(docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Assign every row to one of ``shards`` shards whose row counts differ by one at most.

    Returns ``doc_id, source, size, text_crc32, shard, slot``; size is the UTF-8 length
    of the text plus 8, slots count from 0 in each shard without gaps.

    Null texts count as empty (size 8, checksum 0). Rows without a source form a source of
    their own. Rows that share an id (or have none) follow each other by checksum and size;
    rows equal in all of these are interchangeable. An empty table gives an empty
    result; with fewer rows than shards some shards stay empty. Other columns are ignored.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.col(source_col).isNull().alias("_none"),
        F.coalesce(F.col(source_col), F.lit("")).alias("_source"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        seeded_md5(seed, F.col(id_col)).alias("_key"),
    ).withColumn("_slice", hex_cell(F.col("_key")))

    within = Window.partitionBy("_none", "_source")
    slices = (
        rows.groupBy("_none", "_source", "_slice").agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(within.orderBy("_slice")) - F.col("_n"))
        .withColumn("_of", F.sum("_n").over(within))
        .drop("_n")
    )
    number = F.row_number().over(Window.partitionBy("_none", "_source", "_slice").orderBy("_key", "doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("_number", number).join(slices, ["_none", "_source", "_slice"])
    fraction = (F.lit(2) * (F.col("_before") + F.col("_number")) - F.lit(1)).cast("double") / (F.lit(2) * F.col("_of")).cast("double")
    ranked = ranked.withColumn("_fraction", fraction).withColumn("_cell", F.floor(F.col("_fraction") * SLICES).cast("int"))

    # At most SLICES rows, whatever the input: small enough for one task and for a broadcast.
    cells = ranked.groupBy("_cell").agg(F.count("*").alias("_n"))
    cells = cells.withColumn("_ahead", F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n")).withColumn("_all", F.sum("_n").over(Window.partitionBy(F.lit(1)))).drop("_n")
    order = Window.partitionBy("_cell").orderBy("_fraction", "_none", "_source", "_key", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("_place", F.row_number().over(order)).join(F.broadcast(cells), "_cell")
    at = F.col("_ahead") + F.col("_place") - F.lit(1)
    shard = F.expr(f"cast((_at * {shards}) div _all as int)")
    first = F.expr(f"(shard * _all + {shards - 1}) div {shards}")
    return (
        placed.withColumn("_at", at).withColumn("shard", shard).withColumn("slot", (F.col("_at") - first).cast("long"))
        .select("doc_id", "source", "size", "text_crc32", "shard", "slot")
    )
