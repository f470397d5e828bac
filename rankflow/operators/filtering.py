"""Stable partition by a predicate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.plans.policy import PAR, Policy
from rankflow.plans.positions import sums_before
from rankflow.seq import Seq


def partition_point(seq: Seq, pred: Callable[..., Column]) -> DataFrame:
    """One row: the number of elements that meet the predicate, as ``point``."""
    return seq.df.agg(F.count_if(pred(*[F.col(c) for c in seq.columns])).alias("point"))


def stable_partition(seq: Seq, pred: Callable[..., Column], policy: Policy = PAR) -> Seq:
    """Elements that meet the predicate first, both groups in their old order.

    Blocks of positions are counted, and an element goes to the count of its group
    in earlier blocks (after all hits, for the others) plus its number in its own block.
    """
    met = F.coalesce(pred(*[F.col(c) for c in seq.columns]), F.lit(False))
    rows = seq.df.withColumn("_met", met).withColumn("_block", F.floor(F.col("pos") / policy.cutoff))
    blocks = rows.groupBy("_block").agg(F.count_if("_met").alias("_hits"), F.count_if(~F.col("_met")).alias("_others"))
    blocks = sums_before(blocks, "_block", ["_hits", "_others"])
    number = F.row_number().over(Window.partitionBy("_block", "_met").orderBy("pos")) - 1
    placed = rows.withColumn("_number", number).join(blocks, "_block")
    pos = F.col("_number") + F.when(F.col("_met"), F.col("_hits_before")).otherwise(F.col("_hits_all") + F.col("_others_before"))
    return Seq(placed.withColumn("pos", pos.cast("long")).select("pos", *seq.columns), length=seq._length)


partition = stable_partition
