"""Closed-form cases; results must not depend on partitions or block sizes."""

import os

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from rankflow import queries
from rankflow.functions import reducers as R
from rankflow.operators import compose, filtering, mapping, ordering, reducing, scanning, searching
from rankflow.plans import positions
from rankflow.plans.policy import SEQ, Policy
from rankflow.plans.profiling import Profiler, plan_nodes, work_and_span
from rankflow.seq import Seq
from rankflow.session import DEFAULTS, options
from rankflow.sources import binary

N = 2000
PARTS = [1, 2, 4, 7]


def iota(spark, parts=4, n=N):
    return Seq(Seq.range(spark, 0, n).df.repartition(parts), length=n)


def values(seq, column="value"):
    rows = seq.df.select("pos", column).collect()
    assert sorted(r[0] for r in rows) == list(range(len(rows)))
    return [r[1] for r in sorted(rows)]


def one(df):
    return df.collect()[0][0]


@pytest.mark.parametrize("parts", PARTS)
def test_maps(spark, parts):
    s = iota(spark, parts)
    assert values(mapping.transform(s, lambda v: v * 2)) == [2 * i for i in range(N)]
    assert values(mapping.for_each(lambda a, b: a * b, mapping.transform(s, lambda v: v * 2), s)) == [2 * i * i for i in range(N)]
    assert values(mapping.reverse(s)) == list(range(N))[::-1]
    assert values(mapping.reverse(mapping.reverse(s))) == list(range(N))
    k = N // 3
    assert values(mapping.rotate(s, k)) == [(i + k) % N for i in range(N)]
    assert values(mapping.rotate(mapping.rotate(s, k), N - k)) == list(range(N))
    assert values(mapping.fill(s, "value", 33, 5, 8))[4:9] == [4, 33, 33, 33, 8]


def test_zip_needs_enough_elements(spark):
    with pytest.raises(ValueError):
        mapping.for_each(lambda a, b: a + b, iota(spark), iota(spark, n=10))
    unknown = Seq(iota(spark, n=10).df)  # then the plan checks, without a job of its own
    with pytest.raises(Exception, match="too few elements"):
        mapping.for_each(lambda a, b: a + b, iota(spark), unknown).df.collect()
    assert values(mapping.for_each(lambda a, b: a + b, iota(spark, n=10), unknown)) == [2 * i for i in range(10)]


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("cutoff, levels", [(7, 1), (7, 2), (100_000, 1)])
def test_partition_and_scan(spark, parts, cutoff, levels, monkeypatch):
    s, p = iota(spark, parts), Policy(cutoff)
    if levels == 2:
        s = Seq(s.df)  # of unknown length
        monkeypatch.setattr(positions, "ONE_LEVEL", 0)
        monkeypatch.setattr(positions, "SPAN", 16)
    for k in (2, 3):
        hit = [i for i in range(N) if i % k == 0]
        assert values(filtering.stable_partition(s, lambda v, k=k: v % k == 0, p)) == hit + [i for i in range(N) if i % k]
        assert one(filtering.partition_point(s, lambda v, k=k: v % k == 0)) == len(hit)
    assert values(filtering.stable_partition(s, lambda v: v >= 0, p)) == values(filtering.stable_partition(s, lambda v: v < 0, p)) == list(range(N))
    ones = mapping.fill(s, "value", 1)
    assert values(scanning.scan(ones, policy=p)) == list(range(1, N + 1))
    assert values(scanning.scan(ones, R.multiplies, init=10, policy=p)) == [10] * N
    assert values(scanning.scan(ones, R.plus, lambda v: v + 1, init=10, policy=p)) == [10 + 2 * i for i in range(1, N + 1)]


@pytest.mark.parametrize("block", [3, 64, 4096])
def test_ordered_folds(spark, block):
    s = mapping.transform(iota(spark), lambda v: F.concat(v.cast("string"), F.lit(",")))
    block = Policy(block)
    assert one(reducing.reduce(s, R.concat, policy=block)) == "".join(f"{i}," for i in range(N))
    affine = R.make_reducer(F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), lambda l, r: F.struct(((l["a"] * r["a"]) % 1009).alias("a"), ((r["a"] * l["b"] + r["b"]) % 1009).alias("b")))
    t = mapping.transform(iota(spark), lambda v: F.struct((v % 7 + 2).alias("a"), v.alias("b")))
    a, b = 1, 0
    for i in range(N):
        a, b = a * (i % 7 + 2) % 1009, ((i % 7 + 2) * b + i) % 1009
    assert tuple(one(reducing.reduce(t, affine, policy=block))) == (a, b)


def test_ordered_scan_of_strings(spark):
    s = mapping.transform(iota(spark, n=50), lambda v: v.cast("string"))
    assert values(scanning.scan(s, R.concat, policy=Policy(4)))[-1] == "".join(map(str, range(50)))


@pytest.mark.parametrize("parts", PARTS)
def test_reductions(spark, parts):
    s = iota(spark, parts)
    assert one(reducing.reduce(s)) == N * (N - 1) // 2
    assert one(reducing.reduce(s, R.plus, lambda v: v * v)) == (N - 1) * N * (2 * N - 1) // 6
    assert one(reducing.dot(s, s)) == (N - 1) * N * (2 * N - 1) // 6
    assert one(reducing.reduce(s.clear())) == 0
    assert one(reducing.reduce(s.clear(), R.concat, lambda v: v.cast("string"))) == ""
    assert one(reducing.reduce(s.clear(), R.max_)) == -(2**63)
    assert one(reducing.reduce(Seq.range(spark, 1, 21), R.multiplies)) == 2432902008176640000


def test_nan_is_no_extreme(spark):
    s = Seq.values(spark, [3.0, float("nan"), 1.0, 1.0, 3.0], "double")
    assert one(reducing.reduce(s, R.min_)) == 1.0 and one(reducing.reduce(s, R.max_)) == 3.0
    assert tuple(searching.extremes(s).collect()[0]) == (2, 1.0, 0, 3.0)
    assert one(searching.equal(s, s)) is False


def test_histogram_and_vectors(spark):
    s = mapping.transform(iota(spark), lambda v: F.pmod((v + 0.5) / 100, F.lit(1.0)))
    assert [r[1] for r in reducing.histogram(s, "value", 100, 0, 1).orderBy("bin").collect()] == [N // 100] * 100
    edges = Seq.values(spark, [0.0, 1.0, -0.1, 1.1, 0.3], "double")
    assert [r[1] for r in reducing.histogram(edges, "value", 10, 0, 1).orderBy("bin").collect()] == [1, 0, 1, 0, 0, 0, 0, 0, 0, 1]
    a = mapping.transform(iota(spark), lambda v: F.array_repeat(v, 5))
    assert one(reducing.vec_as_array(reducing.vec_element_wise(a, "value"))) == [N * (N - 1) // 2] * 5
    assert one(reducing.nested_reduce(a, "value")) == 5 * N * (N - 1) // 2
    ragged = mapping.transform(iota(spark, n=100), lambda v: F.when(v % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(v, -v)))
    assert values(reducing.vec_concat(ragged, "value")) == [x for i in range(100) if i % 3 for x in (i, -i)]


@pytest.mark.parametrize("parts", PARTS)
def test_search(spark, parts):
    s = iota(spark, parts)
    x = mapping.transform(s, lambda v: F.when(v.isin(N // 3, 2 * N // 3), 14).when(v.isin(N // 4, N - 1), -1).otherwise((3 * v + 5) % 13))
    assert tuple(searching.extremes(x).collect()[0]) == (N // 4, -1, N // 3, 14)
    assert tuple(searching.extremes(x.clear()).collect()[0]) == (0, None, 0, None)
    steps = mapping.transform(s, lambda v: F.floor(v / 3))
    for cutoff in (5, 100_000):
        p = Policy(cutoff)
        assert one(searching.is_sorted(steps, policy=p)) is True
        assert one(searching.is_sorted(steps, descending=True, policy=p)) is False
        assert one(searching.is_sorted(mapping.reverse(steps), descending=True, policy=p)) is True
        assert one(searching.is_sorted(mapping.fill(steps, "value", 0, N // 4, N // 4 + 1), policy=p)) is False
        assert one(searching.is_sorted(steps.clear(), policy=p)) is True
    assert one(searching.equal(s, s)) is True
    assert one(searching.equal(s, s.slice(0, N - 1))) is False
    assert one(searching.equal(s, mapping.fill(s, "value", 0, N // 2, N // 2 + 1))) is False
    assert one(searching.lower_bound(steps, 10)) == 30


@pytest.mark.parametrize("parts", PARTS)
def test_ordering(spark, parts):
    s = iota(spark, parts)
    x = mapping.transform(s, lambda v: (3 * v + 5) % 13, "v", keep=True)
    got = [(r.v, r.value) for r in ordering.stable_sort(x, lambda value, v: v).df.orderBy("pos").collect()]
    assert got == sorted((((3 * i + 5) % 13, i) for i in range(N)), key=lambda t: t[0])
    assert values(ordering.stable_sort(s, lambda v: F.lit(0))) == list(range(N))
    assert values(ordering.sort(s, descending=True)) == list(range(N))[::-1]
    runs = Seq.range(spark, 0, N // 3).concat(Seq.range(spark, 0, N - N // 3))
    assert values(ordering.inplace_merge(runs, N // 3)) == sorted([*range(N // 3), *range(N - N // 3)])
    a, b, c = (values(ordering.shuffle(s, seed)) for seed in (42, 42, 417))
    assert a == b != c and sorted(a) == sorted(c) == list(range(N))


def test_containers(spark):
    v = Seq.values(spark, [1, 2, 3, 4, 5], "int")
    w = v.insert(0, Seq.values(spark, [10, 20, 30], "int")).insert(5, Seq.values(spark, [0], "int")).insert(8, Seq.values(spark, [-1, -1, -1], "int"))
    assert values(w) == [10, 20, 30, 1, 2, 0, 3, 4, -1, -1, -1, 5]
    r = Seq.range(spark, 0, 100).resize(1000, value=3)
    assert one(reducing.reduce(r)) == 100 * 99 // 2 + 2700 and one(reducing.reduce(r.resize(500))) == 100 * 99 // 2 + 1200
    assert v.at(2) == (3,) and v.front() == (1,) and v.back() == (5,)
    for i in (5, -1):
        with pytest.raises(IndexError):
            v.at(i)
    assert values(v.put(1, value=9)) == [1, 9, 3, 4, 5] and values(v.push(value=6).pop().slice(1, 3)) == [2, 3, 4]
    assert v.clear().empty() and v.clear().length() == 0
    assert sorted(tuple(r) for r in v.slices([(0, 2), (1, 2)]).select("span", "value").collect()) == [(0, 1), (0, 2), (1, 2), (1, 3)]


def test_composition(spark):
    assert compose.parallel_invoke() == ()
    assert compose.parallel_invoke(lambda: 1, (pow, 2, 5), lambda: None) == (1, 32, None)
    assert compose.fib(spark, 10).collect()[0][1] == 89
    assert compose.nqueens(spark, 6).collect()[0][1] == 4
    tree = {r.node: (r.left_work, r.right_work) for r in compose.weight_tree(iota(spark, n=16), lambda v: v).collect()}
    assert tree[1] == (28, 92) and tree[2] == (6, 22) and tree[15] == (14, 15) and len(tree) == 15
    parts = compose.split_by_weight(iota(spark, n=100), lambda v: F.lit(1), 4).groupBy("part").count().collect()
    assert sorted((r[0], r[1]) for r in parts) == [(i, 25) for i in range(4)]


def test_reducers_with_accumulators(spark):
    s = iota(spark)
    total = R.make_reducer(F.struct(F.lit(0).alias("s"), F.lit(0).alias("n")), lambda a, b: F.struct((a["s"] + b["s"]).alias("s"), (a["n"] + b["n"]).alias("n")), "mean", "struct<s:bigint,n:bigint>", lambda v: F.struct(v.alias("s"), F.lit(1).alias("n")), lambda a: a["s"] / a["n"])
    assert one(reducing.reduce(s, total)) == (N - 1) / 2
    assert values(scanning.scan(s, total, policy=Policy(100)))[:4] == [0.0, 0.5, 1.0, 1.5]
    assert tuple(one(reducing.reduce(s, R.minmax))) == (0, N - 1)
    assert tuple(one(reducing.reduce(s.clear(), R.minmax))) == (2**63 - 1, -(2**63))
    x = Seq.values(spark, [float("nan"), 3.0, float("nan"), 1.0, 5.0], "double")
    biggest = R.LIMITS["double"][1]
    assert [tuple(v) for v in values(scanning.scan(x, R.minmax))] == [(biggest, -biggest), (3.0, 3.0), (3.0, 3.0), (1.0, 3.0), (1.0, 5.0)]
    assert values(scanning.scan(x, R.max_)) == [-biggest, 3.0, 3.0, 3.0, 5.0]
    assert one(reducing.reduce(x, R.histogram(4, 0.0, 4.0))) == [0, 1, 0, 1]
    assert values(scanning.scan(x, R.histogram(4, 0.0, 4.0)))[-2:] == [[0, 1, 0, 1]] * 2
    assert one(reducing.reduce(x.clear(), R.histogram(2, 0.0, 4.0))) == [0, 0]


def test_decimals_and_times(spark):
    prices = mapping.transform(iota(spark, n=100), lambda v: F.lit("9.99").cast("decimal(3,2)"))
    assert str(one(reducing.reduce(prices))) == "999.00" and str(values(scanning.scan(prices))[-1]) == "999.00"
    assert str(one(reducing.reduce(prices, R.max_))) == "9.99" and str(one(reducing.reduce(prices.clear(), R.min_))) == "9.99" and str(one(reducing.reduce(prices.clear(), R.max_))) == "-9.99"
    days = mapping.transform(iota(spark, n=100), lambda v: F.date_add(F.lit("2020-01-01").cast("date"), v.cast("int")).cast("timestamp"))
    assert str(one(reducing.reduce(days, R.max_)))[:10] == "2020-04-09" and str(values(scanning.scan(days, R.min_))[-1])[:10] == "2020-01-01"
    with pytest.raises(ValueError):
        reducing.reduce(mapping.transform(iota(spark), lambda v: F.array(v)), R.min_)


def test_vector_sizes(spark):
    a = mapping.transform(iota(spark, n=9), lambda v: F.when(v % 3 == 0, F.array().cast("array<bigint>")).otherwise(F.array(v, -v)))
    assert one(reducing.reduce(a, R.vec_plus)) == [27, -27] and one(reducing.reduce(a, R.vec_max)) == [8, -1] and one(reducing.reduce(a, R.vec_min)) == [1, -8]
    assert values(scanning.scan(a, R.vec_plus))[-1] == [27, -27] and one(reducing.reduce(a.clear(), R.vec_plus)) == []
    bad = Seq.values(spark, [1, 2], "int")
    bad = mapping.transform(bad, lambda v: F.sequence(F.lit(0), v))
    for run in (lambda: reducing.reduce(bad, R.vec_plus), lambda: reducing.vec_element_wise(bad, "value"), lambda: scanning.scan(bad, R.vec_plus).df):
        with pytest.raises(Exception, match="unequal sizes"):
            run().collect()


@pytest.mark.parametrize("size", [1, 60, 125, 250, 499])
def test_comparator_ranges(spark, size, monkeypatch):
    """Any number of ranges; no row is joined with the splitters, and the rows in order come from one exchange."""
    monkeypatch.setattr(ordering, "RANGE", size)
    plans = []
    monkeypatch.setattr(ordering, "exchanged", lambda df: plans.append(df) or positions.exchanged(df), raising=False)
    s = mapping.transform(iota(spark, n=500), lambda v: (v * 7919) % 83)
    down = ordering.sort_by_comparator(s, lambda a, b: (b - a).cast("int"))
    assert values(down) == sorted(((v * 7919) % 83 for v in range(500)), reverse=True)
    nodes = sum((plan_nodes(p) for p in [*plans, down.df]), plan_nodes(s.df))
    assert not {"BroadcastNestedLoopJoin", "CartesianProduct", "TakeOrderedAndProject"} & set(nodes)
    assert not any("_splitters" in p._jdf.queryExecution().optimizedPlan().toString() for p in plans)  # read where they are, in no row


@pytest.mark.parametrize("size", [7, 100_000])
def test_comparators(spark, size, monkeypatch):
    monkeypatch.setattr(ordering, "RANGE", size)
    s = iota(spark, n=500)
    by = lambda a, b: F.when(a % 7 != b % 7, b % 7 - a % 7).otherwise(0).cast("int")
    want = sorted(range(500), key=lambda v: (-(v % 7), v))
    assert values(ordering.sort_by_comparator(s, by)) == want
    assert values(ordering.sort_by_comparator(s, lambda a, b: F.lit(0))) == list(range(500))
    assert values(ordering.merge(s, iota(spark, n=90), comparator=by)) == sorted([*range(500), *range(90)], key=lambda v: -(v % 7))
    assert values(ordering.inplace_merge(s, 250, comparator=by)) == want
    assert ordering.sort_by_comparator(s.clear(), by).df.count() == 0
    more = lambda a, b: a % 7 > b % 7
    p = Policy(16)
    assert tuple(searching.extremes(s, before=more, policy=p).collect()[0]) == (6, 6, 0, 0)
    assert tuple(searching.extremes(s.clear(), before=more).collect()[0]) == (0, None, 0, None)
    assert one(searching.is_sorted(ordering.sort_by_comparator(s, by), before=more, policy=p)) is True
    assert one(searching.is_sorted(s, before=more, policy=p)) is False
    nan = float("nan")
    for xs, up, down in (([nan, 1.0], True, True), ([1.0, nan, 0.5], True, True), ([1.0, 0.5, nan], False, True), ([1.0, 2.0, nan], True, False)):
        seq = Seq.values(spark, xs, "double")
        assert (one(searching.is_sorted(seq)), one(searching.is_sorted(seq, descending=True))) == (up, down)


def test_python_functions_over_batches(spark, tmp_path):
    s, folder = iota(spark, n=1000), str(tmp_path)

    def square(batch):
        assert len(batch) <= 64
        return pa.RecordBatch.from_arrays([pc.power(batch.column("value"), 2)], ["value"])

    assert values(mapping.transform_batches(s, square, "value long", Policy(checkout=64))) == [i * i for i in range(1000)]
    with pytest.raises(Exception, match="rows for"):
        mapping.transform_batches(s, lambda b: b.select(["value"]).slice(1), "value long").df.collect()

    def touch(batch):
        for v in batch.column("value").to_pylist():
            open(f"{folder}/{v}", "w").close()

    assert mapping.for_each_effect(s, touch, Policy(checkout=100)) == 1000 and len(os.listdir(folder)) == 1000
    assert mapping.for_each_effect(s.clear(), touch) == 0


def test_ranks_groups_and_keeping(spark):
    def work(rank, size, barrier, plus):
        barrier()
        return rank * 10 + plus, size

    assert compose.coll_exec(spark, work, 3, 5) == [(5, 3), (15, 3), (25, 3)]
    with compose.task_group(spark, "mine") as cancel:
        assert spark.range(5).count() == 5 and spark.sparkContext.statusTracker().getJobIdsForGroup("mine")
        cancel()
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") != "mine"
    with iota(spark).kept() as s:
        assert s.df.is_cached and one(reducing.reduce(s)) == N * (N - 1) // 2
    assert not s.df.is_cached
    assert plan_nodes(iota(spark).zip(Seq.range(spark, 0, N).select(F.col("value").alias("b")).small()).df)["BroadcastHashJoin"] == 1
    with pytest.raises(ValueError):
        iota(spark).small(10)
    with pytest.raises(Exception, match="more than one row"):
        compose.one_row(spark.range(1), spark.range(2).toDF("b")).collect()


def test_bounds(spark):
    s = iota(spark, n=10)
    for bad in (lambda: s.insert(11, s), lambda: s.insert(-1, s), lambda: s.put(10, value=1), lambda: s.put(-1, value=1), lambda: s.overlay(5, iota(spark, n=6)), lambda: s.slice(8, 3)):
        with pytest.raises(IndexError):
            bad()
    assert values(s.insert(10, iota(spark, n=2))) == [*range(10), 0, 1] and values(s.slice(8, 2)) == [8, 9]
    with pytest.raises(ValueError):
        ordering.inplace_merge(s, 11)


def test_policies_do_not_change_orders(spark):
    s = mapping.transform(iota(spark), lambda v: v % 10)
    for p in (SEQ, Policy(ranges=3)):
        assert values(ordering.stable_sort(s, policy=p)) == sorted(i % 10 for i in range(N))
        assert values(ordering.shuffle(iota(spark), 5, policy=p)) == values(ordering.shuffle(iota(spark), 5))


def test_binary_file(spark, tmp_path):
    binary.write_fixed([i - 50 for i in range(1000)], str(tmp_path / "x"))
    assert values(binary.read_fixed(spark, str(tmp_path / "x"))) == [i - 50 for i in range(1000)]
    binary.write_fixed([-2, 70000], str(tmp_path / "y"), ">i")
    assert values(binary.read_fixed(spark, str(tmp_path / "y"), ">i")) == [-2, 70000]
    rows = [(i % 128, -i, i / 3, i / 7, 3 * i) for i in range(5000)]
    binary.write_fixed(rows, f"file://{tmp_path}/r", "<bifdq", spark=spark)
    spark.conf.set("mapreduce.input.fileinputformat.split.maxsize", "10000")
    got = binary.read_fixed(spark, f"file://{tmp_path}/r", "<bifdq", tuple("abcde")).df.orderBy("pos").collect()
    assert [(r.a, r.b, r.d, r.e) for r in got] == [(a, b, d, e) for a, b, _, d, e in rows] and got[9].c == pytest.approx(3.0) and [r.pos for r in got] == list(range(5000))
    (tmp_path / "none").write_bytes(b"")
    assert binary.read_fixed(spark, str(tmp_path / "none")).df.count() == 0
    for record, names in (("q", ("value",)), ("<q", ("a", "b")), ("<x", ("a",))):
        with pytest.raises(ValueError):
            binary.read_fixed(spark, str(tmp_path / "x"), record, names)
    (tmp_path / "z").write_bytes(b"123")
    with pytest.raises(ValueError):
        binary.read_fixed(spark, str(tmp_path / "z"))


def test_plans(spark):
    nodes = plan_nodes(ordering.shuffle(iota(spark), 1).df)  # the one exchange of rows has run; what is left counts and sorts its partitions
    assert nodes["Window"] == 1 and nodes["SortMergeJoin"] == 0 and nodes["BroadcastHashJoin"] == 1
    jobs = spark.sparkContext.statusTracker()
    with compose.task_group(spark, "dense"):
        ordering.sort(iota(spark)).df.write.format("noop").mode("overwrite").save()
        ran = [s for j in jobs.getJobIdsForGroup("dense") for s in jobs.getJobInfo(j).stageIds]
    wide = [i for i in map(jobs.getStageInfo, set(ran)) if i and i.numCompletedTasks and "AQEShuffleRead" not in i.name]
    assert wide  # stages that ran; sampling, the exchange, counts, and the result
    assert not any("Python" in n for n in plan_nodes(reducing.reduce(iota(spark))))
    p = Profiler()
    with p.phase("x"):
        pass
    assert p.report()[0]["count"] == 1
    assert work_and_span({"a": [1.0, 2.0], "b": [4.0]}, {"b": ["a"]}) == (7.0, 6.0)
    for bad in ((0, None), (4, 5), (4, 0)):
        with pytest.raises(ValueError):
            Policy(*bad)


def test_vec_concat_query_reads_all_conversations(spark, tmp_path):
    rows = [(c, t, f"c{c} t{t}" + " x" * (c % 3)) for c in range(120) for t in range(1 + c % 2)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    want = [w for _, _, text in sorted(rows) for w in text.split(" ")]
    got = queries.QUERIES["vec_concat"](spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(len(want))) and [r.value for r in got] == want


@pytest.mark.parametrize("odd, want", [(1500, False), (2998, False), (2999, True)])
def test_equal_prefix_query_reads_all_but_the_last(spark, tmp_path, odd, want):
    rows = [(i, float("nan") if i == odd else float(i)) for i in range(3000)]  # NaN equals nothing
    spark.createDataFrame(rows, "event_id long, value double").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    assert one(queries.QUERIES["equal_prefix"](spark, str(tmp_path))) is want


def test_session_options(spark):
    shown = options(spark)
    assert shown["spark.sql.adaptive.enabled"] == "true" and shown["spark.master"] == "local[4]" and set(DEFAULTS) < set(shown)
