"""The engine's operators on the given tables, each with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.functions import reducers as R
from rankflow.operators import compose, filtering, mapping, ordering, reducing, scanning, searching
from rankflow.plans.policy import SEQ, Policy
from rankflow.seq import Seq
from rankflow.sources import binary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _seq(spark: SparkSession, sf_dir: str, table: str, key: str, *columns: str) -> Seq:
    """A table whose key counts from 0, as a sequence of some of its columns."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*dict.fromkeys([*columns, key]))
    return Seq(df.withColumnRenamed(key, "pos") if key not in columns else df.withColumn("pos", F.col(key)))


def _events(spark, sf_dir, *columns) -> Seq:
    return _seq(spark, sf_dir, "events", "event_id", *(columns or ("value",)))


def _cents(spark, sf_dir) -> Seq:
    return mapping.transform(_events(spark, sf_dir), lambda v: F.round(v * 100).cast("long"), "cents")


CENTS = "CAST(round(value * 100) AS BIGINT)"


# maps ------------------------------------------------------------------------------------


@query("SELECT event_id AS pos, value * 2 AS value FROM events")
def transform_unary(spark, sf_dir):
    return mapping.transform(_events(spark, sf_dir), lambda v: v * 2).df


@query("SELECT event_id AS pos, value + o_totalprice AS value FROM events JOIN orders ON event_id = o_orderkey")
def transform_zip(spark, sf_dir):
    return mapping.for_each(lambda a, b: a + b, _events(spark, sf_dir), _seq(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")).df


@query("SELECT event_id AS pos, 2.5 * value + user_id AS value FROM events")
def for_each_axpy(spark, sf_dir):
    return mapping.for_each(lambda x, y: F.lit(2.5) * x + y, _events(spark, sf_dir), _events(spark, sf_dir, "user_id"), check=False).df


@query("SELECT event_id AS pos, value + user_id + event_id AS value FROM events")
def for_each_zip3(spark, sf_dir):
    seqs = [_events(spark, sf_dir, c) for c in ("value", "user_id", "event_id")]
    return mapping.for_each(lambda a, b, c: a + b + c, *seqs, check=False).df


@query("SELECT event_id AS pos, 8 * user_id + 28 AS value FROM events")
def for_each_zip8(spark, sf_dir):
    one = _events(spark, sf_dir, "user_id")
    seqs = [mapping.transform(one, lambda v, i=i: v + i) for i in range(8)]
    return mapping.for_each(lambda *v: sum(v[1:], v[0]), *seqs, check=False).df


@query("SELECT event_id AS pos, CAST(33 AS DOUBLE) AS value FROM events")
def fill(spark, sf_dir):
    return mapping.fill(_events(spark, sf_dir), "value", 33).df


@query("SELECT event_id AS pos, CASE WHEN event_id >= 100 AND event_id < 900 THEN 33 ELSE value END AS value FROM events")
def fill_range(spark, sf_dir):
    return mapping.fill(_events(spark, sf_dir), "value", 33, 100, 900).df


@query("SELECT event_id AS pos, value FROM events")
def copy(spark, sf_dir):
    return mapping.copy(_events(spark, sf_dir)).df


@query("SELECT event_id AS pos, value FROM events")
def move(spark, sf_dir):
    return mapping.move(_events(spark, sf_dir)).df


@query("SELECT event_id + 1000 AS pos, value FROM events")
def move_backward(spark, sf_dir):
    return mapping.shift(_events(spark, sf_dir), 1000).df


@query("SELECT (SELECT count(*) FROM events) - 1 - event_id AS pos, value FROM events")
def reverse(spark, sf_dir):
    return mapping.reverse(_events(spark, sf_dir)).df


@query("WITH n AS (SELECT count(*) AS n FROM events) SELECT event_id - (n - 600) AS pos, value FROM events, n WHERE event_id >= n - 600 AND event_id < n - 100")
def reverse_copy_twice(spark, sf_dir):
    return mapping.reverse(mapping.reverse(_events(spark, sf_dir)).slice(100, 500)).df


@query("SELECT CASE WHEN event_id >= 333 THEN event_id - 333 ELSE event_id - 333 + (SELECT count(*) FROM events) END AS pos, value FROM events")
def rotate(spark, sf_dir):
    return mapping.rotate(_events(spark, sf_dir), 333).df


@query("SELECT (event_id + 250) % (SELECT count(*) FROM events) AS pos, value FROM events")
def rotate_copy(spark, sf_dir):
    seq = _events(spark, sf_dir)
    return mapping.rotate(seq, seq.length() - 250).df


# partition -------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY value >= 100, event_id) - 1 AS pos, event_type, value FROM events")
def stable_partition(spark, sf_dir):
    return filtering.stable_partition(_events(spark, sf_dir, "event_type", "value"), lambda t, v: v < 100).df


@query("SELECT row_number() OVER (ORDER BY event_type <> 'click', event_id) - 1 AS pos, event_type FROM events")
def partition(spark, sf_dir):
    return filtering.partition(_events(spark, sf_dir, "event_type"), lambda t: t == "click").df


@query("SELECT count(*) FILTER (WHERE value < 100) AS point FROM events")
def partition_point(spark, sf_dir):
    return filtering.partition_point(_events(spark, sf_dir), lambda v: v < 100)


# reductions ------------------------------------------------------------------------------


@query(f"SELECT CAST(coalesce(sum({CENTS}), 0) AS BIGINT) AS result FROM events")
def reduce_sum(spark, sf_dir):
    return reducing.reduce(_cents(spark, sf_dir))


@query("SELECT CAST(coalesce(sum(user_id), 0) AS BIGINT) AS result FROM events")
def reduce_default(spark, sf_dir):
    return reducing.reduce(_events(spark, sf_dir, "user_id"))


@query("SELECT CAST(product(CASE WHEN event_id < 17 THEN user_id % 7 + 1 ELSE 1 END) AS BIGINT) AS result FROM events")
def reduce_multiplies(spark, sf_dir):
    return reducing.reduce(_events(spark, sf_dir, "event_id", "user_id"), R.multiplies, lambda i, u: F.when(i < 17, u % 7 + 1).otherwise(F.lit(1)))


@query("SELECT round(product(1 + value / 1e9), 6) AS result FROM events")
def reduce_product(spark, sf_dir):
    return reducing.reduce(_events(spark, sf_dir), R.product, lambda v: 1 + v / 1e9).select(F.round("result", 6).alias("result"))


@query("SELECT min(value) AS result FROM events")
def reduce_min(spark, sf_dir):
    return reducing.reduce(_events(spark, sf_dir), R.min_)


@query("SELECT max(value) AS result FROM events")
def reduce_max(spark, sf_dir):
    return reducing.reduce(_events(spark, sf_dir), R.max_)


@query("SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
def reduce_minmax(spark, sf_dir):
    rows = reducing.reduce(_seq(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"), R.minmax)
    return rows.select(F.col("result.min").alias("lo"), F.col("result.max").alias("hi"))


@query(f"SELECT round(CAST(sum({CENTS}) AS DOUBLE) / count(*), 6) AS result FROM events")
def reduce_custom_mean(spark, sf_dir):
    """A reducer whose accumulator is not of the elements' type."""
    mean = R.make_reducer(
        F.struct(F.lit(0).alias("total"), F.lit(0).alias("n")), lambda a, b: F.struct((a["total"] + b["total"]).alias("total"), (a["n"] + b["n"]).alias("n")),
        "mean", "struct<total:bigint,n:bigint>", lambda v: F.struct(v.alias("total"), F.lit(1).alias("n")), lambda a: F.round(a["total"] / a["n"], 6),
        lambda a, over: F.struct(over(F.sum(a["total"])).alias("total"), over(F.sum(a["n"])).alias("n")),
    )
    return reducing.reduce(_cents(spark, sf_dir), mean)


@query("SELECT CAST(sum(CASE WHEN event_id % 3 <> 0 THEN user_id END) AS BIGINT) AS a, CAST(sum(CASE WHEN event_id % 3 <> 0 THEN event_id END) AS BIGINT) AS b FROM events")
def vec_sizes(spark, sf_dir):
    """Element-wise sums of vectors, a third of which are empty."""
    pairs = mapping.transform(_events(spark, sf_dir, "event_id", "user_id"), lambda i, u: F.when(i % 3 != 0, F.array(u, i)).otherwise(F.array().cast("array<bigint>")))
    return reducing.reduce(pairs, R.vec_plus).select(F.col("result")[0].alias("a"), F.col("result")[1].alias("b"))


@query("SELECT coalesce(bool_and(value > 0), true) AS result FROM events")
def reduce_all(spark, sf_dir):
    return reducing.reduce(_events(spark, sf_dir), R.logical_and, lambda v: v > 0)


@query("SELECT coalesce(bool_or(value > 1000), false) AS result FROM events")
def reduce_any(spark, sf_dir):
    return reducing.reduce(_events(spark, sf_dir), R.logical_or, lambda v: v > 1000)


@query("SELECT CAST(0 AS BIGINT) AS total, 1.7976931348623157e308 AS least, true AS every, false AS some")
def reduce_empty(spark, sf_dir):
    none = _events(spark, sf_dir).clear()
    parts = [(R.plus, lambda v: v.cast("long"), "total"), (R.min_, None, "least"), (R.logical_and, lambda v: v > 0, "every"), (R.logical_or, lambda v: v > 0, "some")]
    return compose.one_row(*[reducing.reduce(none, r, f, out) for r, f, out in parts])


@query("SELECT string_agg(substr(event_type, 1, 1), '' ORDER BY event_id) AS result FROM events")
def reduce_ordered(spark, sf_dir):
    return reducing.reduce(_events(spark, sf_dir, "event_type"), R.concat, lambda t: F.substring(t, 1, 1))


@query(f"SELECT CAST(sum(user_id * {CENTS}) AS BIGINT) AS result FROM events")
def dot_product(spark, sf_dir):
    return reducing.dot(_events(spark, sf_dir, "user_id"), _cents(spark, sf_dir))


@query("SELECT CAST(sum(user_id * user_id) AS BIGINT) AS result FROM events")
def transform_reduce_sq(spark, sf_dir):
    return reducing.reduce(_events(spark, sf_dir, "user_id"), R.plus, lambda u: u * u)


@query(f"SELECT CAST(sum({CENTS} * o_custkey) AS BIGINT) AS result FROM events JOIN orders ON event_id = o_orderkey")
def transform_reduce_zip(spark, sf_dir):
    zipped = _cents(spark, sf_dir).zip(_seq(spark, sf_dir, "orders", "o_orderkey", "o_custkey"))
    return reducing.reduce(zipped, R.plus, lambda a, b: a * b)


@query("SELECT round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 4) AS result FROM embeddings")
def nested_reduce(spark, sf_dir):
    seq = _seq(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return reducing.nested_reduce(seq, "embedding").select(F.round("result", 4).alias("result"))


@query("""WITH b AS (SELECT least(CAST(floor((value - 0.0) / ((500.0 - 0.0) / 50.0)) AS INTEGER), 49) AS bin FROM events WHERE value BETWEEN 0 AND 500)
SELECT CAST(r.range AS INTEGER) AS bin, count(b.bin) AS count FROM range(50) r LEFT JOIN b ON b.bin = r.range GROUP BY r.range""")
def histogram(spark, sf_dir):
    return reducing.histogram(_events(spark, sf_dir), "value", 50, 0.0, 500.0)


@query("""WITH b AS (SELECT least(CAST(floor((value - 0.0) / ((500.0 - 0.0) / 20.0)) AS INTEGER), 19) AS bin FROM events WHERE value BETWEEN 0 AND 500)
SELECT CAST(r.range AS INTEGER) AS bin, count(b.bin) AS count FROM range(20) r LEFT JOIN b ON b.bin = r.range GROUP BY r.range""")
def reduce_histogram(spark, sf_dir):
    return reducing.reduce(_events(spark, sf_dir), R.histogram(20, 0.0, 500.0)).select(F.posexplode("result").alias("bin", "count"))


def _vec(spark, sf_dir, aggregate):
    return reducing.vec_element_wise(_seq(spark, sf_dir, "embeddings", "vec_id", "embedding"), "embedding", aggregate)


def _vec_sql(value: str) -> str:
    return f"SELECT CAST(slot AS INTEGER) AS slot, {value} AS value FROM (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS slot FROM embeddings) GROUP BY slot"


@query(_vec_sql("round(sum(CAST(x AS DOUBLE)), 4)"))
def vec_plus(spark, sf_dir):
    return _vec(spark, sf_dir, lambda x: F.round(F.sum(x.cast("double")), 4))


@query(_vec_sql("max(x)"))
def vec_max(spark, sf_dir):
    return _vec(spark, sf_dir, F.max)


@query(_vec_sql("min(x)"))
def vec_min(spark, sf_dir):
    return _vec(spark, sf_dir, F.min)


@query(_vec_sql("round(product(1 + CAST(x AS DOUBLE) / 1000), 6)"))
def vec_multiplies(spark, sf_dir):
    return _vec(spark, sf_dir, lambda x: F.round(F.product(1 + x.cast("double") / 1000), 6))


@query("""WITH p AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS p, string_split(text, ' ') AS w FROM conversations),
u AS (SELECT p, unnest(w) AS value, unnest(range(len(w))) AS i FROM p)
SELECT row_number() OVER (ORDER BY p, i) - 1 AS pos, value FROM u""")
def vec_concat(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.split("text", " ", -1).alias("words"))
    return reducing.vec_concat(Seq.from_df(rows, ["conv_id", "turn"]), "words").df


# scans -----------------------------------------------------------------------------------


@query(f"SELECT event_id AS pos, CAST(sum({CENTS}) OVER (ORDER BY event_id) AS BIGINT) AS value FROM events")
def scan_sum(spark, sf_dir):
    return scanning.scan(_cents(spark, sf_dir)).df


@query(f"SELECT event_id AS pos, CAST(1000 + sum({CENTS}) OVER (ORDER BY event_id) AS BIGINT) AS value FROM events")
def scan_sum_init(spark, sf_dir):
    return scanning.scan(_cents(spark, sf_dir), R.plus, init=1000).df


@query("SELECT event_id AS pos, max(value) OVER (ORDER BY event_id) AS value FROM events")
def scan_max(spark, sf_dir):
    return scanning.scan(_events(spark, sf_dir), R.max_).df


@query("SELECT event_id AS pos, least(50, min(value) OVER (ORDER BY event_id)) AS value FROM events")
def scan_min_init(spark, sf_dir):
    return scanning.scan(_events(spark, sf_dir), R.min_, init=50.0).df


@query(f"SELECT event_id AS pos, CAST(10 + sum({CENTS} + 1) OVER (ORDER BY event_id) AS BIGINT) AS value FROM events")
def scan_transform(spark, sf_dir):
    return scanning.scan(_cents(spark, sf_dir), R.plus, lambda c: c + 1, init=10).df


@query("SELECT event_id AS pos, coalesce(bool_and(value < 400) OVER (ORDER BY event_id), true) AS value FROM events")
def scan_all(spark, sf_dir):
    return scanning.scan(_events(spark, sf_dir), R.logical_and, lambda v: v < 400).df


@query("SELECT event_id AS pos, min(value) OVER (ORDER BY event_id) AS lo, max(value) OVER (ORDER BY event_id) AS hi FROM events")
def scan_minmax(spark, sf_dir):
    return scanning.scan(_events(spark, sf_dir), R.minmax).df.select("pos", F.col("value.min").alias("lo"), F.col("value.max").alias("hi"))


@query(f"SELECT event_id AS pos, CAST(sum({CENTS}) OVER (ORDER BY event_id) AS BIGINT) AS value FROM events")
def scan_policy(spark, sf_dir):
    """A policy changes blocks, not results."""
    return scanning.scan(_cents(spark, sf_dir), policy=Policy(cutoff=700, checkout=70)).df


@query("SELECT event_id AS pos, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id) AS value FROM (SELECT * FROM events UNION ALL SELECT * REPLACE (-1 AS event_id, 'purchase' AS event_type) FROM events WHERE event_id = 0) QUALIFY event_id >= 0")
def scan_ordered(spark, sf_dir):
    """The last purchase so far: an operation that keeps its right operand unless it is -1."""
    last = R.make_reducer(-1, lambda a, b: F.when(b >= 0, b).otherwise(a), "last", "bigint")
    return scanning.scan(_events(spark, sf_dir, "event_type", "event_id"), last, lambda t, i: F.when(t == "purchase", i).otherwise(F.lit(-1)).cast("long")).df


# comparison and search -------------------------------------------------------------------


@query("SELECT true AS equal")
def equal_true(spark, sf_dir):
    return searching.equal(_events(spark, sf_dir), _events(spark, sf_dir))


@query("SELECT false AS equal")
def equal_changed(spark, sf_dir):
    return searching.equal(_events(spark, sf_dir), mapping.fill(_events(spark, sf_dir), "value", -1, 500, 501))


@query("SELECT false AS equal")
def equal_lengths(spark, sf_dir):
    seq = _events(spark, sf_dir)
    return searching.equal(seq, seq.slice(0, 999))


@query("SELECT true AS equal")
def equal_prefix(spark, sf_dir):
    seq = _events(spark, sf_dir)
    return searching.equal(seq.slice(0, max(0, seq.length() - 1)), seq, lengths=False)  # all but the last element


@query("SELECT true AS equal")
def equal_predicate(spark, sf_dir):
    seq = _events(spark, sf_dir)
    return searching.equal(seq, mapping.transform(seq, lambda v: v + 1), lambda a, b: b > a)


@query("SELECT coalesce(bool_and(NOT coalesce(ts < p, false)), true) AS sorted FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events)")
def is_sorted(spark, sf_dir):
    return searching.is_sorted(_events(spark, sf_dir, "ts"))


@query("SELECT coalesce(bool_and(NOT coalesce(value < p, false)), true) AS sorted FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS p FROM events)")
def is_sorted_values(spark, sf_dir):
    return searching.is_sorted(_events(spark, sf_dir))


@query("SELECT true AS sorted")
def is_sorted_descending(spark, sf_dir):
    return searching.is_sorted(mapping.reverse(_events(spark, sf_dir, "event_id")), descending=True)


@query("SELECT coalesce(bool_and(NOT coalesce(v < p, false)), true) AS sorted FROM (SELECT v, lag(v) OVER (ORDER BY event_id) AS p FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id END AS v FROM events))")
def is_sorted_nan(spark, sf_dir):
    """NaN is before nothing and nothing is before NaN."""
    return searching.is_sorted(mapping.transform(_events(spark, sf_dir, "event_id"), lambda i: F.when(i % 10 == 0, F.lit(float("nan"))).otherwise(i.cast("double"))))


@query("SELECT coalesce(bool_and(event_type >= p), true) AS sorted FROM (SELECT event_type, lag(event_type) OVER (ORDER BY event_id) AS p FROM events)")
def is_sorted_comp(spark, sf_dir):
    return searching.is_sorted(_events(spark, sf_dir, "event_type"), before=lambda a, b: a < b)


@query("""WITH k AS (SELECT o_orderkey AS p, o_custkey AS v, o_custkey % 13 AS k FROM orders), lo AS (SELECT * FROM k ORDER BY k DESC, p LIMIT 1), hi AS (SELECT * FROM k ORDER BY k, p LIMIT 1)
SELECT lo.p AS min_pos, lo.v AS min_value, hi.p AS max_pos, hi.v AS max_value FROM lo, hi""")
def min_element_comp(spark, sf_dir):
    """First extremes by a comparator: larger remainders come first."""
    return searching.minmax_element(_seq(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), before=lambda a, b: a % 13 > b % 13)


@query("SELECT o_orderkey AS min_pos, o_totalprice AS min_value FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def min_element(spark, sf_dir):
    return searching.min_element(_seq(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"))


@query("SELECT o_orderkey AS max_pos, o_totalprice AS max_value FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def max_element(spark, sf_dir):
    return searching.max_element(_seq(spark, sf_dir, "orders", "o_orderkey", "o_totalprice"))


@query("""WITH k AS (SELECT o_orderkey, o_custkey % 13 AS k FROM orders)
SELECT (SELECT min(o_orderkey) FROM k WHERE k = (SELECT min(k) FROM k)) AS min_pos, (SELECT min(k) FROM k) AS min_value,
(SELECT min(o_orderkey) FROM k WHERE k = (SELECT max(k) FROM k)) AS max_pos, (SELECT max(k) FROM k) AS max_value""")
def minmax_element(spark, sf_dir):
    return searching.minmax_element(_seq(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), lambda c: c % 13)


@query("SELECT count(*) FILTER (WHERE value < 100) AS point FROM events")
def lower_bound(spark, sf_dir):
    return searching.lower_bound(ordering.sort(_events(spark, sf_dir)), 100.0)


# ordering --------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY event_type, event_id) - 1 AS pos, event_type, value FROM events")
def stable_sort(spark, sf_dir):
    return ordering.stable_sort(_events(spark, sf_dir, "event_type", "value"), lambda t, v: t).df


@query("SELECT row_number() OVER (ORDER BY value DESC, event_id) - 1 AS pos, value FROM events")
def sort_desc(spark, sf_dir):
    return ordering.sort(_events(spark, sf_dir), descending=True).df


@query("SELECT row_number() OVER (ORDER BY o_custkey % 10, o_custkey DESC, o_orderkey) - 1 AS pos, o_custkey FROM orders")
def sort_comparator(spark, sf_dir):
    seq = _seq(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    return ordering.sort_by_comparator(seq, lambda a, b: F.when(a % 10 != b % 10, a % 10 - b % 10).otherwise(b - a).cast("int")).df


@query("SELECT row_number() OVER (ORDER BY k, event_id) - 1 AS pos, k AS value FROM (SELECT event_id, CAST(CASE WHEN event_id < 300 THEN event_id // 7 ELSE (event_id - 300) // 7 END AS BIGINT) AS k FROM events)")
def inplace_merge(spark, sf_dir):
    runs = mapping.transform(_events(spark, sf_dir, "event_id"), lambda i: F.floor(F.when(i < 300, i).otherwise(i - 300) / 7))
    return ordering.inplace_merge(runs, 300).df


@query("SELECT row_number() OVER (ORDER BY k DESC, side, p) - 1 AS pos, k AS value FROM (SELECT 0 AS side, event_id AS p, CAST((100000 - event_id) // 7 AS BIGINT) AS k FROM events UNION ALL SELECT 1, n_nationkey, CAST((50 - n_nationkey) * 200 AS BIGINT) FROM nation)")
def merge_comp(spark, sf_dir):
    """Two descending sequences, merged by a comparator. Quotients are cut towards zero, as SQL's ``//`` does below it."""
    a = mapping.transform(_events(spark, sf_dir, "event_id"), lambda i: ((100000 - i) / 7).cast("long"))
    b = mapping.transform(_seq(spark, sf_dir, "nation", "n_nationkey", "n_nationkey"), lambda i: ((50 - i) * 200).cast("long"))
    return ordering.merge(a, b, comparator=lambda x, y: F.signum(y - x).cast("int")).df


@query("SELECT row_number() OVER (ORDER BY k, side, p) - 1 AS pos, k AS value FROM (SELECT 0 AS side, event_id AS p, CAST(event_id // 7 AS BIGINT) AS k FROM events UNION ALL SELECT 1, o_orderkey, CAST(o_orderkey // 5 AS BIGINT) FROM orders)")
def merge(spark, sf_dir):
    a = mapping.transform(_events(spark, sf_dir, "event_id"), lambda i: F.floor(i / 7))
    b = mapping.transform(_seq(spark, sf_dir, "orders", "o_orderkey", "o_orderkey"), lambda i: F.floor(i / 5))
    return ordering.merge(a, b).df


@query("SELECT row_number() OVER (ORDER BY md5(concat('42-', CAST(event_id AS VARCHAR))), event_id) - 1 AS pos, value FROM events")
def shuffle_seeded(spark, sf_dir):
    return ordering.shuffle(_events(spark, sf_dir), 42).df


@query("SELECT row_number() OVER (ORDER BY value, event_id) - 1 AS pos, value FROM events")
def sort_seq(spark, sf_dir):
    """The sequential policy: one range."""
    return ordering.stable_sort(_events(spark, sf_dir), policy=SEQ).df


# composition -----------------------------------------------------------------------------


@query(f"SELECT (SELECT count(*) FROM orders) AS orders, (SELECT max(o_totalprice) FROM orders) AS dearest, (SELECT CAST(sum({CENTS}) AS BIGINT) FROM events) AS cents")
def fork_join_tuple(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return compose.one_row(orders.agg(F.count("*").alias("orders")), orders.agg(F.max("o_totalprice").alias("dearest")), reducing.reduce(_cents(spark, sf_dir), out="cents"))


@query(f"SELECT (SELECT count(*) FROM orders) AS orders, (SELECT CAST(sum({CENTS}) AS BIGINT) FROM events) AS cents, true AS nothing")
def parallel_invoke(spark, sf_dir):
    """Independent jobs at once, one of them without a result."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    with compose.task_group(spark, "parallel_invoke"):
        n, cents, none = compose.parallel_invoke(orders.count, (lambda seq: reducing.reduce(seq).first()[0], _cents(spark, sf_dir)), lambda: None)
    return spark.range(1).select(F.lit(n).cast("long").alias("orders"), F.lit(cents).cast("long").alias("cents"), F.lit(none is None).alias("nothing"))


@query("SELECT 0 AS rank, 2 AS size, 10 AS result UNION ALL SELECT 1, 2, 11")
def coll_exec(spark, sf_dir):
    """The same function on two tasks at once, which wait for each other."""

    def ten_more(rank, size, barrier, first):
        barrier()
        return rank, size, first + rank

    return spark.createDataFrame(compose.coll_exec(spark, ten_more, 2, 10), "rank int, size int, result int")


@query("WITH w AS (SELECT event_id AS pos, sum(event_id % 5) OVER (ORDER BY event_id) AS e, (SELECT sum(event_id % 5) FROM events) AS t FROM events) SELECT pos, CAST(least(floor((e - 1) * 4 / greatest(t, 1)), 3) AS INTEGER) AS part FROM w")
def split_by_weight(spark, sf_dir):
    return compose.split_by_weight(_events(spark, sf_dir, "event_id"), lambda i: i % 5, 4).select("pos", "part")


@query("SELECT event_id AS pos, value * 3 + 1 AS value FROM events")
def transform_batches(spark, sf_dir):
    """An opaque Python function over Arrow batches of 500 elements."""

    def three_times(batch):
        return pa.RecordBatch.from_arrays([pc.add(pc.multiply(batch.column("value"), 3.0), 1.0)], ["value"])

    return mapping.transform_batches(_events(spark, sf_dir), three_times, "value double", Policy(checkout=500)).df


@query("SELECT count(*) AS visited FROM events")
def for_each_effect(spark, sf_dir):
    """Elements visited by a function without a result."""
    with _events(spark, sf_dir).kept() as seq:
        n = mapping.for_each_effect(seq, lambda batch: None)
    return spark.range(1).select(F.lit(n).cast("long").alias("visited"))


@query("SELECT event_id AS pos, value, n_name AS name FROM events JOIN nation ON n_nationkey = event_id")
def zip_small(spark, sf_dir):
    """A short sequence sent whole to the tasks that read a long one."""
    names = _seq(spark, sf_dir, "nation", "n_nationkey", "n_name")
    n = names.length()
    return Seq(_events(spark, sf_dir).df.where(F.col("pos") < n), length=n).zip(names.select(F.col("n_name").alias("name")).small()).df


@query("SELECT 20 AS n, CAST(10946 AS BIGINT) AS fib")
def fib_recursive(spark, sf_dir):
    return compose.fib(spark, 20)


@query("SELECT 8 AS n, CAST(92 AS BIGINT) AS solutions")
def nqueens(spark, sf_dir):
    return compose.nqueens(spark, 8)


@query("""WITH n AS (SELECT count(*) AS n FROM events), t AS (
  SELECT 1 AS node, 0 AS a, n AS b FROM n UNION ALL
  SELECT 2, 0, n // 2 FROM n UNION ALL SELECT 3, n // 2, n FROM n)
SELECT CAST(node AS BIGINT) AS node, CAST(sum(CASE WHEN event_id < a + (b - a) // 2 THEN event_id ELSE 0 END) AS BIGINT) AS left_work,
  CAST(sum(CASE WHEN event_id >= a + (b - a) // 2 THEN event_id ELSE 0 END) AS BIGINT) AS right_work
FROM t JOIN events ON event_id >= a AND event_id < b GROUP BY node""")
def workhint_tree(spark, sf_dir):
    return compose.weight_tree(_events(spark, sf_dir, "event_id"), lambda i: i, leaves=4)


# sources and containers ------------------------------------------------------------------


@query("SELECT range AS pos, range + 5 AS value FROM range(1000)")
def count_source(spark, sf_dir):
    return Seq.range(spark, 5, 1005).df


@query("SELECT CAST(i AS BIGINT) AS pos, v AS value FROM (VALUES (0, 3), (1, 1), (2, 4), (3, 1), (4, 5)) t(i, v)")
def literal_source(spark, sf_dir):
    return Seq.values(spark, [3, 1, 4, 1, 5], "int").df


@query("SELECT range AS pos, 3 AS value FROM range(500)")
def uniform_source(spark, sf_dir):
    return Seq.fill(spark, 500, 3).df


def _shared(spark) -> str:
    """A new folder that driver and executors share; in local mode a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.gettempdir()}"
    return f"{named.rstrip('/')}/rankflow-{uuid.uuid4().hex}"


@query("SELECT range AS pos, range * 3 - 100 AS value FROM range(1000)")
def binary_file_scan(spark, sf_dir):
    """A file of 64-bit integers, written by the driver to the folder that executors share."""
    path = f"{_shared(spark)}/values.bin"
    binary.write_fixed([i * 3 - 100 for i in range(1000)], path, spark=spark)
    return binary.read_fixed(spark, path).df


@query("SELECT range AS pos, CAST(range % 100 AS TINYINT) AS b, CAST(range AS INTEGER) AS i, CAST(range / 4.0 AS FLOAT) AS f, range / 8.0 AS d FROM range(1000)")
def binary_records(spark, sf_dir):
    """Records of mixed types in big-endian order."""
    path = f"{_shared(spark)}/records.bin"
    binary.write_fixed([(i % 100, i, i / 4, i / 8) for i in range(1000)], path, ">bifd", spark=spark)
    return binary.read_fixed(spark, path, ">bifd", ("b", "i", "f", "d")).df


@query("SELECT value FROM events WHERE event_id = 77")
def point_read(spark, sf_dir):
    return _events(spark, sf_dir).slice(77, 1).df.select("value")


@query("SELECT event_id AS pos, CASE WHEN event_id = 77 THEN value + 1 ELSE value END AS value FROM events")
def point_write(spark, sf_dir):
    return _events(spark, sf_dir).put(77, value=F.col("value") + 1).df


@query("SELECT event_id - 100 AS pos, value FROM events WHERE event_id >= 100 AND event_id < 150")
def subspan(spark, sf_dir):
    return _events(spark, sf_dir).slice(100, 50).df


@query("SELECT event_id AS pos, CASE WHEN event_id >= 10 AND event_id < 20 THEN 7 ELSE value END AS value FROM events")
def range_write(spark, sf_dir):
    return _events(spark, sf_dir).overlay(10, mapping.transform(Seq.fill(spark, 10, 7), lambda v: v.cast("double"))).df


@query("SELECT event_id AS pos, value, 0 AS span FROM events WHERE event_id < 10 UNION ALL SELECT event_id, value, 1 FROM events WHERE event_id >= 5 AND event_id < 25")
def multi_range_read(spark, sf_dir):
    return _events(spark, sf_dir).slices([(0, 10), (5, 20)])


@query("SELECT CASE WHEN n_nationkey >= 3 THEN n_nationkey + 5 ELSE n_nationkey END AS pos, n_name AS name FROM nation UNION ALL SELECT r_regionkey + 3, r_name FROM region")
def insert(spark, sf_dir):
    a, b = (_seq(spark, sf_dir, t, k, n) for t, k, n in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")))
    a, b = (s.select(F.col(s.columns[0]).alias("name")) for s in (a, b))
    return a.insert(3, b).df.select(F.col("pos").cast("int").alias("pos"), "name")


@query("SELECT range AS pos, CASE WHEN range < 1000 THEN range ELSE 3 END AS value FROM range(5000)")
def resize(spark, sf_dir):
    return Seq.range(spark, 0, 1000).resize(10_000, value=3).resize(5000).df


@query("SELECT range AS pos, CASE WHEN range < 99 THEN range ELSE 7 END AS value FROM range(100)")
def push_pop(spark, sf_dir):
    return Seq.range(spark, 0, 100).pop().push(value=7).df


@query("SELECT row_number() OVER (ORDER BY c_name) - 1 AS pos, c_name FROM customer")
def dense_positions(spark, sf_dir):
    return Seq.from_df(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_name"), "c_name").df
