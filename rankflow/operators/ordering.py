"""Stable sorting, merging and seeded shuffling; results have dense positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from rankflow.plans.policy import PAR, Policy
from rankflow.plans.positions import dense_positions, exchanged
from rankflow.seq import Seq

#: Elements that a comparator sorts as one array, and sampled elements for each such range.
RANGE, OVERSAMPLE = 8192, 16


def stable_sort(seq: Seq, key: Callable[..., Column] | None = None, descending: bool = False, policy: Policy = PAR) -> Seq:
    """Elements by key (the first column by default); equal ones in their old order."""
    k = key(*[F.col(c) for c in seq.columns]) if key else F.col(seq.columns[0])
    rows = seq.df.withColumnRenamed("pos", "_old").withColumn("_k", k)
    placed = dense_positions(rows, ["_k", "_old"], descending=[descending, False], ranges=policy.ranges)
    return Seq(placed.select("pos", *seq.columns), length=seq._length)


sort = stable_sort


def sort_by_comparator(seq: Seq, comparator: Callable[[Column, Column], Column]) -> Seq:
    """Elements by a comparator (negative, zero or positive) of their first column; equal ones in their old order.

    Splitters are taken from a sample that the comparator sorts. An element finds its range among them by bisection, ranges
    of about RANGE elements are gathered once and sorted as arrays, and
    ranges are numbered by their sizes. Positions break ties, so many equal elements fall into many ranges.
    """
    first, n = seq.columns[0], seq.length()
    ranges = max(1, -(-n // RANGE))

    def compare(a: Column | dict[str, Column], b: Column | dict[str, Column]) -> Column:
        c = comparator(a[first], b[first])
        return F.when(c != 0, c).when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)

    rows = seq.df.select("pos", *seq.columns)
    if ranges > 1:
        rows = exchanged(rows)  # a leaf: where values are still to be computed Spark would put them and the splitters into one row
        drawn = F.pmod(F.xxhash64("pos"), F.lit(n)) < min(n, OVERSAMPLE * ranges)  # about OVERSAMPLE for each range
        ordered = rows.select("pos", first).where(drawn).agg(F.array_sort(F.collect_list(F.struct("pos", first)), compare).alias("_s"))
        places = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(ranges - 1).cast("long")), lambda i: F.get("_s", (i * F.size("_s") / F.lit(ranges)).cast("int")))
        found = _found(F.col("_splitters"), ranges - 1, compare, {c: F.col(c) for c in ("pos", first)})
        rows = rows.withColumn("_splitters", ordered.select(places).scalar()).select("pos", *seq.columns, found.alias("_range"))
    else:
        rows = rows.withColumn("_range", F.lit(0))
    groups = exchanged(rows.repartition("_range").groupBy("_range").agg(F.collect_list(F.struct("pos", *seq.columns)).alias("_all")))
    sizes = groups.select("_range", F.size("_all").cast("long").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    inner = groups.join(F.broadcast(before), "_range").select("_before", F.posexplode(F.array_sort("_all", compare)).alias("_i", "_e"))
    return Seq(inner.select((F.col("_before") + F.col("_i")).alias("pos"), *[F.col(f"_e.{c}").alias(c) for c in seq.columns]), length=n)


def _found(splitters: Column, most: int, compare: Callable[..., Column], here: dict[str, Column]) -> Column:
    """How many of the sorted splitters, ``most`` at most, do not come after ``here``.

    Splitters are a scalar that is read where it is. Joined rows, or steps that hand it on, would copy all splitters for each element.
    """
    widths = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])

    def bisected(s: Column) -> Column:
        def step(at: Column, width: Column) -> Column:
            met = (at + width <= F.size(s)) & (compare(F.get(s, at + width - 1), here) <= 0)
            return F.when(met, at + width).otherwise(at)

        return F.aggregate(widths, F.lit(0), step)

    return F.get(F.transform(F.array(splitters), bisected), 0)


def merge(a: Seq, b: Seq, key: Callable[..., Column] | None = None, comparator: Callable[[Column, Column], Column] | None = None, policy: Policy = PAR) -> Seq:
    """Two sorted sequences as one, by key or comparator; of equal elements those of a come first."""
    if comparator is not None:
        return sort_by_comparator(a.concat(b.select(*a.columns)), comparator)
    sides = [s.df.select(F.lit(i).alias("_side"), F.col("pos").alias("_old"), *a.columns) for i, s in enumerate((a, b))]
    rows = sides[0].unionByName(sides[1])
    rows = rows.withColumn("_k", key(*[F.col(c) for c in a.columns]) if key else F.col(a.columns[0]))
    return Seq(dense_positions(rows, ["_k", "_side", "_old"], ranges=policy.ranges).select("pos", *a.columns))


def inplace_merge(seq: Seq, middle: int, key: Callable[..., Column] | None = None, comparator: Callable[[Column, Column], Column] | None = None, policy: Policy = PAR) -> Seq:
    """The two sorted runs before and from ``middle`` on, merged: a stable sort, as their elements are in that order."""
    if not 0 <= middle <= seq.length():
        raise ValueError(f"{middle} is no place in {seq.length()} elements")
    return sort_by_comparator(seq, comparator) if comparator is not None else stable_sort(seq, key, policy=policy)


def shuffle(seq: Seq, seed: int, policy: Policy = PAR) -> Seq:
    """A random permutation that depends on the seed and the positions only."""
    rows = seq.df.withColumnRenamed("pos", "_old").withColumn("_k", F.md5(F.concat(F.lit(f"{seed}-"), F.col("_old").cast("string"))))
    return Seq(dense_positions(rows, ["_k", "_old"], ranges=policy.ranges).select("pos", *seq.columns), length=seq._length)
