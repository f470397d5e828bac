"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Plan of a mix:

1. *Targets.* Each source asks for its share of the budget by weight; no source gets more
   than ``max_repeats`` times its own size, and the excess is shared again by weight.
2. *Blocks.* A source's documents are put in a seeded random order which is cut into
   ``BLOCKS`` blocks. Epoch after epoch, blocks are drawn in order until the target is met:
   this is the exact block quota of the source. In the last drawn block the documents stop
   where the target is reached.
3. *Splitting tree.* The quotas of all sources are the root of a binary tree. Of a node's
   n blocks the left half gets m: the m first in a random order of the node's quota units,
   so that its source counts are a multivariate-hypergeometric draw of the node's; the
   right half gets the rest. The leaves, the output shards, hold equally many blocks (one
   more or less) and together exactly the quotas.
4. *Draws.* A source's drawn blocks are permuted and dealt to the shards as disjoint runs
   of the leaf quotas' lengths; rows are then shuffled within their shard only.

The tables of step 3 hold block counts, not documents: ``UNITS * max_repeats`` rows at
most, or ``max_repeats`` for each source where there are more than UNITS sources. Documents
move once, to the slice of their source's order that holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.llm.common import hex_cell, n_words_of, seeded_md5

#: Slices of a source's random order; most blocks of a source; most blocks of all sources together.
SLICES, BLOCKS, UNITS = 4096, 128, 65536


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """Targets of sources given as ``_none, _source, source_size``.

    Weights go to the sources in code point order (no source comes last) and repeat.
    A target is min(cap, weight * level): the level at which the targets add up to
    ``budget`` times all sizes is found by going through the sources by cap / weight.
    """
    order = Window.orderBy("_none", "_source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    caps = sizes.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * max_repeats)
    everything = Window.partitionBy(F.lit(1))
    ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_none", "_source")
    caps = (
        caps.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("_cap_before", F.sum("_cap").over(ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cap"))
        .withColumn("_weight_left", F.sum("_weight").over(everything) - F.sum("_weight").over(ratio.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_weight"))
        .withColumn("_level", (F.col("_budget") - F.col("_cap_before")) / F.col("_weight_left"))
        .withColumn("_full", F.col("_cap") <= F.col("_level") * F.col("_weight"))
    )
    # the first source that is not full sets the level of all that are not
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_none"), F.col("_source"), F.col("_level").alias("_level")))).over(everything)["_level"]
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_weight") * level)
    return caps.withColumn("target", target).select("_none", "_source", "source_size", "target")


def _split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deal the quota units of all sources to shards: ``_none, _source, _unit, shard``."""
    units = quotas.select("_none", "_source", F.explode(F.sequence(F.lit(1), F.col("_quota").cast("int"))).alias("_unit"), F.lit(0).alias("_a"), F.lit(shards).alias("_b"))
    for level in range(max(0, (shards - 1).bit_length())):
        node = Window.partitionBy("_a", "_b")
        draw = seeded_md5(seed, F.lit(f"tree{level}"), F.col("_a"), F.col("_none"), F.col("_source"), F.col("_unit"))
        units = (
            units.withColumn("_at", F.row_number().over(node.orderBy(draw, "_none", "_source", "_unit")))
            .withColumn("_n", F.count("*").over(node))
            .withColumn("_mid", F.expr("(_a + _b) div 2"))
            .withColumn("_left", F.expr("_at <= (_n * (_mid - _a)) div (_b - _a)"))
            .select("_none", "_source", "_unit", F.expr("if(_left, _a, cast(_mid as int))").alias("_a"), F.expr("if(_left, cast(_mid as int), _b)").alias("_b"))
        )
    return units.select("_none", "_source", "_unit", F.col("_a").alias("shard"))


def plan_mix(docs: DataFrame, shards: int = 16, seed: int = 42, weights: tuple[float, ...] = (3, 1, 2), budget: float = 1.5, max_repeats: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Every document with what the mix takes of it.

    Returns ``doc_id, source, size, source_size, target, taken, draws`` and the columns of
    ``keep``. size is the number of words; draws is an array of (epoch, shard), one for each
    time the document is taken; taken is size times their number.

    Null texts and texts without words have size 0 and are never taken. Rows without a source form a source of
    their own, last in order. Repeated rows are documents of their own; their order among
    each other does not matter. A document is taken ``max_repeats`` times at most. An empty table gives an
    empty result. Columns not named are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.col(source_col).isNull().alias("_none"),
        F.coalesce(F.col(source_col), F.lit("")).alias("_source"),
        n_words_of(F.col(text_col)).alias("size"),
        seeded_md5(seed, F.col(id_col)).alias("_key"),
        *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep or [])],
    ).withColumn("_slice", hex_cell(F.col("_key")))

    sliced = rows.groupBy("_none", "_source", "_slice").agg(F.sum("size").alias("_words"))
    within = Window.partitionBy("_none", "_source")
    targets = source_targets(sliced.groupBy("_none", "_source").agg(F.sum("_words").alias("source_size")), weights, budget, max_repeats)
    slices = (
        sliced.withColumn("_before", F.sum("_words").over(within.orderBy("_slice")) - F.col("_words"))
        .join(targets, ["_none", "_source"])
        .withColumn("_sources", F.lit(1))
    )
    sources = targets.agg(F.count("*").alias("_sources"))  # one row
    slices = slices.drop("_sources").join(F.broadcast(sources)).withColumn("_block", F.expr(f"cast(_slice * greatest(1, least({BLOCKS}, {UNITS} div _sources)) div {SLICES} as int)"))

    # a block is drawn in an epoch if the target is not reached where the block starts
    blocks = slices.groupBy("_none", "_source", "_block").agg(F.min("_before").alias("_start"), F.sum("_words").alias("_words"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    drawn = (
        blocks.where("_words > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("_epoch"))
        .where("_epoch * source_size + _start < target")
        .withColumn("_unit", F.row_number().over(within.orderBy(seeded_md5(seed, F.lit("block"), F.col("_block"), F.col("_epoch")))))
        .select("_none", "_source", "_unit", "_block", "_epoch")
    )
    dealt = _split_tree(drawn.groupBy("_none", "_source").agg(F.max("_unit").alias("_quota")), shards, seed)
    dealt = dealt.select("_none", "_source", "shard", F.row_number().over(within.orderBy("shard", "_unit")).alias("_unit"))
    draws = (
        drawn.join(dealt, ["_none", "_source", "_unit"]).groupBy("_none", "_source", "_block")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_epoch").alias("epoch"), "shard"))).alias("_draws"))  # max_repeats entries at most
    )
    slices = slices.join(draws, ["_none", "_source", "_block"], "left").select("_none", "_source", "_slice", "_before", "source_size", "target", "_draws")

    order = Window.partitionBy("_none", "_source", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_here", F.sum("size").over(order) - F.col("size")).join(slices, ["_none", "_source", "_slice"])
    # a document is taken in an epoch if its middle lies before the target
    draws = F.expr("if(size = 0 or _draws is null, cast(array() as array<struct<epoch: int, shard: int>>), filter(_draws, d -> 2 * (d.epoch * source_size + _before + _here) + size < 2 * target))")
    return placed.withColumn("draws", draws).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), "draws",
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep or [])],
    )


def _drawn(docs: DataFrame, replaced: tuple[str, ...], shards: int, seed: int, id_col: str, text_col: str, source_col: str, options: dict) -> DataFrame:
    """``_row, shard, _key``: each taken row once for each draw, without the replaced columns, and its place in the shard's random order.

    Rows that are equal in all columns have equal keys, and their copies may change places.
    """
    columns = [f"`{c}`" for c in docs.columns if c not in replaced]
    own = F.struct(*columns)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), own.alias("_row"))
    planned = plan_mix(rows, shards, seed, keep=["_row"], **options)
    rows = planned.select("doc_id", "_row", F.explode("draws").alias("_draw")).select("doc_id", "_row", F.col("_draw.epoch").alias("_epoch"), F.col("_draw.shard").alias("shard"))
    key = seeded_md5(seed, F.lit("row"), F.col("shard"), F.col("doc_id"), F.col("_epoch"), F.xxhash64("_row"))
    return rows.select("_row", "shard", key.alias("_key"))


def mix(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed rows: each taken document once for each draw, with ``shard`` and ``slot``.

    All columns of ``docs`` stay; a column named ``shard`` or ``slot`` is replaced. Rows are
    shuffled within their shard by a seeded key; slots count from 0. Shards are numbered in slices of their key, so
    a shard does not meet in one task. Nulls, repeated rows and empty tables: see :func:`plan_mix`.
    """
    rows = _drawn(docs, ("shard", "slot"), shards, seed, id_col, text_col, source_col, options).withColumn("_slice", hex_cell(F.col("_key")))
    slices = rows.groupBy("shard", "_slice").agg(F.count("*").alias("_n"))  # SLICES rows at most for a shard
    slices = slices.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_slice")) - F.col("_n")).drop("_n")
    number = F.row_number().over(Window.partitionBy("shard", "_slice").orderBy("_key"))
    rows = rows.withColumn("_number", number).join(slices, ["shard", "_slice"])
    return rows.select("_row.*", "shard", (F.col("_before") + F.col("_number") - 1).cast("long").alias("slot"))


def mix_in_order(docs: DataFrame, shards: int = 16, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_shard: bool = True, **options) -> DataFrame:
    """The rows of :func:`mix`, laid out for writing: partitions by shard and key, each sorted.

    ``shard`` replaces a column of that name, or, without ``with_shard``, the columns are those of ``docs``.

    Files written from it and read by name hold shard after shard, each in its shuffled order. Keys are
    uniform hashes, so equal slices of them make even partitions and no sample is needed.
    """
    rows = _drawn(docs, ("shard",) if with_shard else (), shards, seed, id_col, text_col, source_col, options)
    slices = -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    place = F.expr(f"cast(shard * {slices} + cast(conv(substring(_key, 1, 7), 16, 10) as bigint) * {slices} div {16**7} as int)")
    return rows.repartitionById(shards * slices, place).sortWithinPartitions("shard", "_key").select("_row.*", *["shard"] * with_shard)
