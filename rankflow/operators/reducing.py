"""Reductions with any monoid, histograms, and vectors of elements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions.reducers import Reducer, histogram_bin, plus, slots_of
from rankflow.plans.policy import Policy
from rankflow.seq import Seq

#: Elements that one task folds in order at a time.
FOLD_BLOCK = 4096


def _mapped(seq: Seq, f: Callable[..., Column] | None) -> DataFrame:
    return seq.df.select("pos", (f(*[F.col(c) for c in seq.columns]) if f else F.col(seq.columns[0])).alias("_x"))


def reduce(seq: Seq, reducer: Reducer = plus, f: Callable[..., Column] | None = None, out: str = "result", policy: Policy | None = None) -> DataFrame:
    """One row: the reduction of f of all elements (of the first column by default); the identity for none.

    Commutative reducers are one aggregate with partial results. Others are folded in order:
    blocks of positions first (the policy's cutoff, FOLD_BLOCK at most), then blocks of their results, until one is left, so that
    no task ever holds more than a block.
    """
    rows = _mapped(seq, f)
    kind = dict(rows.dtypes)["_x"]
    zero, result = reducer.zero(kind), reducer.result(kind)
    if reducer.plan is not None:
        return reducer.plan(rows, "_x").select(reducer.finish(F.col("_x").cast(result)).alias(out))
    rows = rows.withColumn("_x", reducer.lifted(kind, F.col("_x")))
    if reducer.aggregate is not None:
        total = rows.agg(reducer.aggregate(F.col("_x"), lambda c: c).alias("_x"))
        return total.select(reducer.finish(reducer.combine(zero, F.coalesce("_x", zero)).cast(result)).alias(out))
    block = min(FOLD_BLOCK, policy.cutoff if policy else FOLD_BLOCK)
    for _ in range(_levels(seq, max(2, block))):
        folded = F.aggregate(F.array_sort(F.collect_list(F.struct("pos", "_x"))), zero, lambda a, e: reducer.combine(a, e["_x"]).cast(result))
        rows = rows.groupBy(F.floor(F.col("pos") / max(2, block)).alias("pos")).agg(folded.alias("_x"))
    return rows.agg(F.coalesce(F.first("_x"), zero).alias("_x")).select(reducer.finish(F.col("_x")).alias(out))


def _levels(seq: Seq, block: int) -> int:
    levels, n = 1, max(1, seq.length())
    while n > block:
        n = -(-n // block)
        levels += 1
    return levels


def dot(a: Seq, b: Seq | None = None, out: str = "result") -> DataFrame:
    """Sum of products of two columns, or of two sequences' elements."""
    zipped = a if b is None else a.select(F.col(a.columns[0]).alias("_a")).zip(b.select(F.col(b.columns[0]).alias("_b")))
    x, y = zipped.columns[:2]
    return reduce(zipped.select(x, y), plus, lambda u, v: u * v, out)


def nested_reduce(seq: Seq, array: str, out: str = "result") -> DataFrame:
    """The sum over all elements of an array column: arrays in place, then across rows."""
    kind = dict(seq.df.dtypes)[array][6:-1]
    wide = plus.result(kind)
    inner = F.aggregate(F.col(array), F.lit(0).cast(wide), lambda a, x: a + x.cast(wide))
    return seq.df.agg(F.coalesce(F.sum(inner), F.lit(0).cast(wide)).alias(out))


def histogram(seq: Seq, column: str, bins: int, low: float, high: float) -> DataFrame:
    """``bin, count`` of all bins; values outside the bounds are ignored."""
    spark = seq.df.sparkSession
    counted = seq.df.select(histogram_bin(F.col(column), bins, low, high).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("_n"))
    every = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select("bin", F.coalesce("_n", F.lit(0)).cast("long").alias("count"))


def vec_element_wise(seq: Seq, array: str, aggregate: Callable[[Column], Column] = F.sum) -> DataFrame:
    """``slot, value``: an aggregate of each slot of an array column over all rows.

    Stays distributed by slot; ``vec_as_array`` makes it one array. Empty arrays count as the identity; other arrays
    must be of one size, or running the plan raises.
    """
    return slots_of(seq.df.select(F.col(array).alias("_x")), aggregate)


def vec_as_array(slots: DataFrame, out: str = "result") -> DataFrame:
    """One row with the values in the order of their slots."""
    return slots.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda e: e["value"]).alias(out))


def vec_concat(seq: Seq, array: str) -> Seq:
    """All elements of the arrays, in order, as one sequence; nothing is gathered."""
    from rankflow.operators.scanning import scan

    sizes = scan(Seq(seq.df.select("pos", F.size(array).cast("long").alias("n"))), plus, out="end")
    rows = seq.df.select("pos", array).join(sizes.df, "pos").select((F.col("end") - F.size(array)).alias("_start"), F.posexplode(array).alias("_i", "value"))
    return Seq(rows.select((F.col("_start") + F.col("_i")).cast("long").alias("pos"), "value"))
