"""Comparison, sortedness and extreme elements with the first match of ties."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.functions.reducers import make_reducer
from rankflow.operators.reducing import reduce
from rankflow.plans.policy import PAR, Policy
from rankflow.seq import Seq


def equal(a: Seq, b: Seq, pred: Callable[[Column, Column], Column] | None = None, lengths: bool = True, out: str = "equal") -> DataFrame:
    """One row: whether all pairs of elements are equal (or meet the predicate).

    With ``lengths`` both must be as long; else b is read as far as a reaches. NaN equals nothing.
    """
    kind = dict(a.df.dtypes)[a.columns[0]]
    x, y = a.df.select("pos", F.col(a.columns[0]).alias("_a"), F.lit(True).alias("_in_a")), b.df.select("pos", F.col(b.columns[0]).alias("_b"), F.lit(True).alias("_in_b"))
    rows = x.join(y, "pos", "full" if lengths else "left")
    met = pred(F.col("_a"), F.col("_b")) if pred else F.col("_a") == F.col("_b")
    if pred is None and kind in ("float", "double"):
        met = met & ~F.isnan("_a")
    return rows.agg(F.coalesce(F.bool_and(F.coalesce(F.col("_in_a") & F.col("_in_b") & met, F.lit(False))), F.lit(True)).alias(out))


Before = Callable[[Column, Column], Column]


def is_sorted(seq: Seq, key: Callable[..., Column] | None = None, descending: bool = False, out: str = "sorted", policy: Policy = PAR, before: Before | None = None) -> DataFrame:
    """One row: whether no element comes before (after, if descending) its left neighbour.

    ``before`` says whether one element comes before another where no key does; by default that is less, which NaN
    never is in either direction.

    Neighbours within a block of positions are compared by a window; the last element of each
    block is added to the next one, so no window is global.
    """
    x = (key(*[F.col(c) for c in seq.columns]) if key else F.col(seq.columns[0])).alias("_x")
    rows = seq.df.select("pos", x).withColumn("_block", F.floor(F.col("pos") / policy.cutoff))
    edges = rows.where(F.pmod(F.col("pos") + 1, F.lit(policy.cutoff)) == 0).withColumn("_block", F.col("_block") + 1)
    left = F.lag("_x").over(Window.partitionBy("_block").orderBy("pos"))
    here = F.col("_x")
    if before is not None:
        wrong = before(left, here) if descending else before(here, left)
    else:
        wrong = (left < here) if descending else (left > here)
        if dict(rows.dtypes)["_x"] in ("float", "double"):
            wrong = wrong & ~F.isnan(left) & ~F.isnan(here)
    wrong = left.isNotNull() & wrong
    checked = rows.unionByName(edges).withColumn("_wrong", F.coalesce(wrong, F.lit(False)))
    return checked.agg(F.coalesce(F.bool_and(~F.col("_wrong")), F.lit(True)).alias(out))


def extremes(seq: Seq, key: Callable[..., Column] | None = None, before: Before | None = None, policy: Policy | None = None) -> DataFrame:
    """One row: positions and values of the first least and the first largest element.

    ``min_pos, min_value, max_pos, max_value``; the positions are the length and the values null
    for an empty sequence. NaN is never an extreme unless there is nothing else. ``before`` orders elements where no key
    does: elements are then folded in blocks, of which each gives its two extremes.
    """
    value = (key(*[F.col(c) for c in seq.columns]) if key else F.col(seq.columns[0])).alias("_x")
    rows = seq.df.select("pos", value)
    if before is not None:
        return _extremes_by(rows, seq, before, policy)
    real = (~F.isnan("_x")) if dict(rows.dtypes)["_x"] in ("float", "double") else F.lit(True)
    found = rows.agg(
        F.count("*").alias("_n"),
        F.min(F.when(real, F.struct(F.col("_x").alias("v"), F.col("pos").alias("p")))).alias("_lo"),
        F.max(F.when(real, F.struct(F.col("_x").alias("v"), (-F.col("pos")).alias("p")))).alias("_hi"),
        F.min(F.struct(F.col("pos").alias("p"), F.col("_x").alias("v"))).alias("_any"),
    )
    first = F.when(F.col("_n") > 0, F.col("_any.p")).otherwise(F.col("_n"))
    return found.select(
        F.coalesce("_lo.p", first).alias("min_pos"), F.coalesce("_lo.v", "_any.v").alias("min_value"),
        F.coalesce(-F.col("_hi.p"), first).alias("max_pos"), F.coalesce("_hi.v", "_any.v").alias("max_value"),
    )


def _extremes_by(rows: DataFrame, seq: Seq, before: Before, policy: Policy | None) -> DataFrame:
    kind = dict(rows.dtypes)["_x"]
    element = f"struct<p:bigint,v:{kind}>"

    def combine(left: Column, right: Column) -> Column:
        lo = F.when(before(right["lo"]["v"], left["lo"]["v"]), right["lo"]).otherwise(left["lo"])
        hi = F.when(before(left["hi"]["v"], right["hi"]["v"]), right["hi"]).otherwise(left["hi"])
        both = F.struct(lo.alias("lo"), hi.alias("hi"))
        return F.when(left["lo"].isNull(), right).when(right["lo"].isNull(), left).otherwise(both)

    one = F.struct(F.col("pos").alias("p"), F.col("_x").alias("v"))
    none = F.struct(F.lit(None).cast(element).alias("lo"), F.lit(None).cast(element).alias("hi"))
    folded = reduce(Seq(rows.select("pos", F.struct(one.alias("lo"), one.alias("hi")).alias("_e")), length=seq._length), make_reducer(none, combine, "extremes"), out="_m", policy=policy)
    length = seq.length()
    return folded.select(
        F.coalesce("_m.lo.p", F.lit(length)).alias("min_pos"), F.col("_m.lo.v").alias("min_value"),
        F.coalesce("_m.hi.p", F.lit(length)).alias("max_pos"), F.col("_m.hi.v").alias("max_value"),
    )


def min_element(seq: Seq, key: Callable[..., Column] | None = None, before: Before | None = None) -> DataFrame:
    return extremes(seq, key, before).select("min_pos", "min_value")


def max_element(seq: Seq, key: Callable[..., Column] | None = None, before: Before | None = None) -> DataFrame:
    return extremes(seq, key, before).select("max_pos", "max_value")


minmax_element = extremes


def lower_bound(seq: Seq, value: object, out: str = "point") -> DataFrame:
    """One row: the first position of a sorted sequence whose element is not less than ``value``.

    The comparison reaches the scan as a filter, so files and row groups without such elements are skipped; if there are
    none, the length is asked of the whole sequence.
    """
    found = seq.df.where(F.col(seq.columns[0]) >= F.lit(value)).agg(F.min("pos").alias("_at"))
    return found.crossJoin(seq.length_column()).select(F.coalesce("_at", "n").alias(out))  # one row each
