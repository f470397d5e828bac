"""Ordered collections: a DataFrame with dense positions 0 ... n - 1."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.plans.positions import dense_positions

Fn = Callable[..., Column]


class Seq:
    """A sequence: rows of ``df`` in the order of column ``pos``, values in the other columns.

    Positions are dense and unique. Sequences are immutable; every operation returns a new
    one. Values must not be null (the engine's operators have no meaning for it).
    """

    def __init__(self, df: DataFrame, pos: str = "pos", length: int | None = None):
        self.df = df if pos == "pos" else df.withColumnRenamed(pos, "pos")
        self._length = length

    # sources -----------------------------------------------------------------------------

    @classmethod
    def from_df(cls, df: DataFrame, order_by: str | list[str], dense: bool = False) -> Seq:
        """Rows of a table in the order of a unique key; ``dense`` says that it counts from 0."""
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        if dense:
            return cls(df.withColumn("pos", F.col(keys[0]).cast("long")))
        return cls(dense_positions(df, keys))

    @classmethod
    def range(cls, spark: SparkSession, start: int, end: int) -> Seq:
        """The counting sequence start, ..., end - 1."""
        n = max(0, end - start)
        return cls(spark.range(n).select(F.col("id").alias("pos"), (F.col("id") + start).alias("value")), length=n)

    @classmethod
    def fill(cls, spark: SparkSession, n: int, value: Any) -> Seq:
        """n times the same value."""
        return cls(spark.range(n).select(F.col("id").alias("pos"), F.lit(value).alias("value")), length=n)

    @classmethod
    def values(cls, spark: SparkSession, items: list, kind: str | None = None) -> Seq:
        """A literal list; ``kind`` is the SQL type of its elements."""
        array = F.array(*map(F.lit, items)) if items else F.array().cast(f"array<{kind or 'int'}>")
        array = array.cast(f"array<{kind}>") if kind else array
        rows = spark.range(1).select(F.posexplode(array).alias("pos", "value"))
        return cls(rows.select(F.col("pos").cast("long"), "value"), length=len(items))

    # shape -------------------------------------------------------------------------------

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != "pos"]

    def length(self) -> int:
        """The number of elements; counted once."""
        if self._length is None:
            self._length = self.df.count()
        return self._length

    def empty(self) -> bool:
        return self._length == 0 if self._length is not None else self.df.isEmpty()

    def length_column(self) -> DataFrame:
        """One row with the number of elements as ``n``, to be joined in without an action."""
        return self.df.agg(F.count("*").alias("n"))

    def select(self, *columns: str | Column) -> Seq:
        return Seq(self.df.select("pos", *columns), length=self._length)

    @contextmanager
    def kept(self, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[Seq]:
        """The sequence, kept on the executors while the block runs: for data that several reads share."""
        self.df.persist(level)
        try:
            yield self
        finally:
            self.df.unpersist()

    def small(self, most: int = 1 << 16) -> Seq:
        """The sequence marked to be sent whole to every task that joins it; ValueError beyond ``most`` elements."""
        if self.length() > most:
            raise ValueError(f"{self.length()} elements are too many to send to every task, {most} are allowed")
        return Seq(F.broadcast(self.df), length=self._length)

    # reads and writes --------------------------------------------------------------------

    def at(self, i: int) -> tuple:
        """The element at i; IndexError outside 0 <= i < length."""
        rows = self.df.where(F.col("pos") == i).select(*self.columns).take(1)
        if i < 0 or not rows:
            raise IndexError(i)
        return tuple(rows[0])

    def front(self) -> tuple:
        return self.at(0)

    def back(self) -> tuple:
        return self.at(self.length() - 1)

    def slice(self, offset: int, count: int) -> Seq:
        """Elements offset, ..., offset + count - 1, from position 0 on; IndexError beyond a known length."""
        if offset < 0 or count < 0:
            raise ValueError("offset and count must not be negative")
        self._reaches(offset + count)
        rows = self.df.where(F.col("pos").between(offset, offset + count - 1))
        return Seq(rows.withColumn("pos", F.col("pos") - offset), length=count if self._length is not None else None)

    def _reaches(self, end: int) -> None:
        if self._length is not None and end > self._length:
            raise IndexError(f"{end} is beyond the {self._length} elements")

    def slices(self, spans: list[tuple[int, int]]) -> DataFrame:
        """Rows of several (offset, count) ranges in one scan, with the range's number as ``span``.

        Ranges may overlap; a row comes once for each range that holds it.
        """
        hits = F.filter(F.array(*[F.when(F.col("pos").between(a, a + n - 1), F.lit(i)) for i, (a, n) in enumerate(spans)]), lambda x: x.isNotNull())
        rows = self.df
        if spans:
            wanted = F.lit(False)
            for a, n in spans:
                wanted = wanted | F.col("pos").between(a, a + n - 1)
            rows = rows.where(wanted)
        return rows.select("*", F.explode(hits).alias("span"))

    def put(self, i: int, **values: Any) -> Seq:
        """The element at i with some columns replaced; values may be Columns of the old ones."""
        if i < 0:
            raise IndexError(i)
        self._reaches(i + 1)
        new = [F.when(F.col("pos") == i, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).alias(c) if (v := values.get(c)) is not None else F.col(c) for c in self.columns]
        return Seq(self.df.select("pos", *new), length=self._length)

    def overlay(self, offset: int, other: Seq) -> Seq:
        """Elements from offset on replaced by those of ``other``; IndexError beyond known lengths."""
        if offset < 0:
            raise IndexError(offset)
        if other._length is not None:
            self._reaches(offset + other._length)
        new = other.df.select((F.col("pos") + offset).alias("pos"), F.struct(*self.columns).alias("_new"))
        rows = self.df.join(new, "pos", "left")
        return Seq(rows.select("pos", *[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in self.columns]), length=self._length)

    # growing and shrinking ---------------------------------------------------------------

    def clear(self) -> Seq:
        return Seq(self.df.where(F.lit(False)), length=0)

    def resize(self, n: int, **value: Any) -> Seq:
        """Cut to n elements, or grown to n with ``value`` (by column)."""
        old = self.length()
        if n <= old:
            return Seq(self.df.where(F.col("pos") < n), length=n)
        types = dict(self.df.dtypes)
        more = self.df.sparkSession.range(old, n).select(F.col("id").alias("pos"), *[F.lit(value.get(c)).cast(types[c]).alias(c) for c in self.columns])
        return Seq(self.df.unionByName(more), length=n)

    def push(self, **value: Any) -> Seq:
        return self.resize(self.length() + 1, **value)

    def pop(self) -> Seq:
        return self.resize(max(0, self.length() - 1))

    def insert(self, i: int, other: Seq) -> Seq:
        """All elements of ``other`` before position i, which may be the end; IndexError beyond."""
        if not 0 <= i <= self.length():
            raise IndexError(f"{i} is no place in {self.length()} elements")
        n = other.length()
        moved = self.df.withColumn("pos", F.when(F.col("pos") >= i, F.col("pos") + n).otherwise(F.col("pos")))
        more = other.df.select((F.col("pos") + i).alias("pos"), *self.columns)
        return Seq(moved.unionByName(more), length=None if self._length is None else self._length + n)

    def concat(self, other: Seq) -> Seq:
        return self.insert(self.length(), other)

    # zipping -----------------------------------------------------------------------------

    def zip(self, *others: Seq, check: bool = True) -> Seq:
        """Columns of several sequences side by side, as long as this one.

        Where ``check`` is set, a shorter partner is an error instead of giving nulls: ValueError at once where the
        lengths are known, else an error of the plan at the first element without a partner. Column
        names must differ.
        """
        rows = self.df
        for i, o in enumerate(others):
            known = self._length is not None and o._length is not None
            if check and known and o._length < self._length:
                raise ValueError(f"a zipped sequence has {o._length} elements, {self._length} are needed")
            if not check or known:
                rows = rows.join(o.df, "pos", "left")
                continue
            there, first = f"_there{i}", o.columns[0]
            rows = rows.join(o.df.withColumn(there, F.lit(True)), "pos", "left")
            rows = rows.withColumn(first, F.when(F.col(there), F.col(first)).otherwise(F.raise_error(F.lit("a zipped sequence has too few elements")))).drop(there)
        return Seq(rows, length=self._length)
