"""Positions, neighbours and running sums against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from kinetable.operators import ordering
from kinetable.operators.signals import thin_by_gap


def hot_rows(n=3000, seed=1):
    """Two thirds of the rows share one key; orders are unique with gaps."""
    rng = random.Random(seed)
    orders = rng.sample(range(10 * n), n)
    return [(0 if rng.random() < 0.66 else rng.randint(1, 5), o, rng.randint(0, 3)) for o in orders]


def expected_positions(rows, keep=lambda r: True):
    found, seen = {}, {}
    for row in sorted(r for r in rows if keep(r)):
        found[row[1]] = seen.get(row[0], 0)
        seen[row[0]] = found[row[1]] + 1
    return found, seen


def test_position_over_many_slices(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k long, o long, v int")
    placed = ordering.with_position(
        df, ["k"], ["o"], slice_by=F.floor(F.col("o") / 500), size_out="n", among={"kept": F.col("v") > 0}
    ).collect()
    all_positions, sizes = expected_positions(rows)
    kept_positions, _ = expected_positions(rows, lambda r: r[2] > 0)
    assert len(placed) == len(rows)
    for row in placed:
        assert row["pos"] == all_positions[row["o"]]
        assert row["n"] == sizes[row["k"]]
        assert row["kept"] == kept_positions.get(row["o"])


def test_position_keeps_rows_without_key(spark):
    df = spark.createDataFrame([(None, 1), (1, 1), (1, 2)], "k long, o long")
    rows = {(r["k"], r["o"]): r["pos"] for r in ordering.with_position(df, ["k"], ["o"]).collect()}
    assert rows == {(None, 1): None, (1, 1): 0, (1, 2): 1}


def test_position_of_text_and_time_orders(spark):
    df = spark.createDataFrame(
        [(1, "ab", "2024-01-01 10:00:00"), (1, "abcdef", "2024-01-03 00:00:00"), (1, "b", "2024-01-01 23:00:00")],
        "k long, s string, t string",
    ).withColumn("t", F.col("t").cast("timestamp_ntz"))
    by_text = {r["s"]: r["pos"] for r in ordering.with_position(df, ["k"], ["s"]).collect()}
    assert by_text == {"ab": 0, "abcdef": 1, "b": 2}
    by_time = {r["s"]: r["pos"] for r in ordering.with_position(df, ["k"], ["t"]).collect()}
    assert by_time == {"ab": 0, "b": 1, "abcdef": 2}


def spread_orders():
    rng = random.Random(5)
    return {
        "text": [f"participant_0|{i:06d}" for i in range(4000)],
        "hashed": [rng.getrandbits(63) for _ in range(4000)],
        "dense": list(range(4000)),
        "fraction": [rng.random() for _ in range(3999)] + [float("nan")],
    }


@pytest.mark.parametrize("kind", ["text", "hashed", "dense", "fraction"])
def test_default_slices_are_even(spark, kind):
    orders = spread_orders()[kind]
    df = spark.createDataFrame([(1, o) for o in orders], f"k int, o {'string' if kind == 'text' else 'double' if kind == 'fraction' else 'long'}")
    counts = df.groupBy(ordering.default_slice(df, ["k"], ["o"]).alias("s")).count().collect()
    slices = ordering.SLICES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert slices // 2 <= len(counts) <= slices
    assert max(r["count"] for r in counts) < 6 * len(orders) / slices
    ranked = sorted(orders, key=lambda o: (o != o, o if o == o else 0))
    places = [r["pos"] for r in ordering.with_position(df, ["k"], ["o"]).orderBy("o").collect()]
    assert places == list(range(len(ranked)))


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbour_over_slices(spark, ahead):
    rows = hot_rows(800, seed=2)
    df = spark.createDataFrame(rows, "k long, o long, v int")
    found = ordering.with_neighbour(
        df, ["k"], ["o"], "v", "beside", F.floor(F.col("o") / 300), ahead=ahead
    ).collect()
    expected = {}
    last = {}
    for k, o, v in sorted(rows, reverse=ahead):
        expected[o] = last.get(k)
        last[k] = v
    assert {r["o"]: r["beside"] for r in found} == expected


def test_neighbour_keeps_null_values(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 30, 6)], "k int, o int, v int")
    found = ordering.with_neighbour(df, ["k"], ["o"], "v", "b", F.floor(F.col("o") / 10))
    assert {r["o"]: r["b"] for r in found.collect()} == {1: None, 2: None, 30: 5}


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = random.Random(3)
    values = [(x / 7, rng.randint(0, 4)) for x in rng.sample(range(-5000, 5000), 2000)]
    df = spark.createDataFrame(values, "o double, v long")
    found = ordering.running_totals(df, "o", ["v"], descending=descending, parts=13).collect()
    total, expected = 0, {}
    for o, v in sorted(values, reverse=descending):
        total += v
        expected[o] = total
    assert {r["o"]: r["cum_v"] for r in found} == expected
    assert {r["all_v"] for r in found} == {total}


@pytest.mark.parametrize("slice_seconds", [600, 86400])
def test_thinning_is_exact_in_slices(spark, slice_seconds):
    rng = random.Random(4)
    rows, i = [], 0
    for key in (1, 2, 3):
        t = rng.random() * 50
        for _ in range(700):
            t += rng.choice([0.5, 3, 20, 59.9, 60, 61, 400])
            rows.append((i, key, round(t, 3)))
            i += 1
    df = spark.createDataFrame(rows, "i long, k long, s double").withColumn(
        "ts", F.timestamp_add("MICROSECOND", F.round(F.col("s") * 1e6).cast("long"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    )
    expected, last = set(), {}
    for i, key, s in rows:
        if key not in last or round((s - last[key]) * 1e6) > 60_000_000:
            expected.add(i)
            last[key] = s
    kept = thin_by_gap(df, "k", seconds=60, slice_seconds=slice_seconds)
    assert {r["i"] for r in kept.collect()} == expected


def test_thinning_of_one_long_key_with_holes(spark):
    """One key over hundreds of slices, with holes, slices that a chain passes over, and slices of one row."""
    rng = random.Random(12)
    times, now = [], 0
    for _ in range(2500):
        now += rng.choice([1, 3, 20, 59, 60, 61, 118, 119, 121, 700])
        times.append(now)
    rows = [("hot", t, i) for i, t in enumerate(times)] + [("cold", 5, -1), (None, 5, -2)]
    df = spark.createDataFrame(rows, "k string, s long, i long").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    expected, last = set(), None
    for i, t in enumerate(times):
        if last is None or t - last > 60:
            expected.add(i)
            last = t
    kept = {r["i"] for r in thin_by_gap(df, "k", seconds=60, slice_seconds=120).collect()}
    assert kept == expected | {-1}


def test_thinning_works_slices_off_together(spark):
    """Keys of a few rows cost no Python call each: many slices go to a worker as one batch."""
    rows = spark.range(30_000).select((F.col("id") % 10_000).alias("k"), F.expr("id div 10000 * 40").alias("s"), F.col("id").alias("i"))
    df = rows.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    plan = thin_by_gap(df, "k", seconds=60, slice_seconds=120)
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    # Times 0, 40, 80: 40 is within the gap of 0, 80 is not.
    assert {r["s"]: r["n"] for r in plan.groupBy("s").agg(F.count("*").alias("n")).collect()} == {0: 10_000, 80: 10_000}


def test_default_slices_of_numbers_are_looked_up_by_bisection(spark):
    big = 2**53
    rows = [(1, v) for v in [*range(500), big, big + 1, big + 2, None]]
    df = spark.createDataFrame(rows, "k int, o long")
    placed = ordering.with_position(df, ["k"], ["o"])
    assert "lambda" not in placed._jdf.queryExecution().optimizedPlan().toString()
    got = {r["o"]: r["pos"] for r in placed.collect()}
    assert got == {**{i: i for i in range(500)}, big: 500, big + 1: 501, big + 2: 502, None: None}


def test_weights_count_rows_that_others_stand_for(spark):
    df = spark.createDataFrame([(1, i, 1 + i % 3) for i in range(50)], "k int, o long, n long")
    got = {r["o"]: r["pos"] for r in ordering.with_position(df, ["k"], ["o"], weight="n").collect()}
    assert got == {i: sum(1 + j % 3 for j in range(i)) for i in range(50)}


def exchanges(df):
    """Hash shuffles of a plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")


def test_small_keys_stay_whole_and_are_shuffled_once(spark):
    rows = [(k, o, o % 3) for k in range(500) for o in range(20)] + [(7, None, 1), (None, 3, 1)]
    df = spark.createDataFrame(rows, "k long, o long, v int")
    assert ordering.slice_cuts(df, ["k"], ["o"]) == []
    placed = ordering.with_position(df, ["k"], ["o"], among={"odd": F.col("v") == 1}, size_out="n")
    grouped = placed.groupBy("k", "v").agg(F.count("*").alias("c"))
    assert exchanges(grouped) == 1
    got = {(r["k"], r["o"]): (r["pos"], r["odd"], r["n"]) for r in placed.collect()}
    for k in range(500):
        size = 21 if k == 7 else 20
        assert [got[k, o] for o in range(20)] == [(o, o // 3 if o % 3 == 1 else None, size) for o in range(20)]
    assert got[7, None] == (None, None, 21) and got[None, 3] == (None, None, None)


def test_a_large_key_among_small_ones_is_still_cut(spark):
    rows = [(0, o) for o in range(3000)] + [(k, 5 * k + o) for k in range(1, 600) for o in range(10)]
    df = spark.createDataFrame(rows, "k long, o long")
    slices = ordering.SLICES_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = df.withColumn("s", ordering.default_slice(df, ["k"], ["o"])).groupBy("k", "s").count()
    assert cells.agg(F.max("count")).first()[0] < 4 * len(rows) / slices
    got = {(r["k"], r["o"]): r["pos"] for r in ordering.with_position(df, ["k"], ["o"]).collect()}
    assert got == {(k, o): o if k == 0 else o - 5 * k for k, o in rows}


def test_weights_of_whole_keys_and_rows_without_order(spark):
    rows = [(k, o, 1 + o % 3) for k in range(300) for o in range(10)] + [(1, None, 4)]
    df = spark.createDataFrame(rows, "k int, o long, n long")
    assert ordering.slice_cuts(df, ["k"], ["o"]) == []
    got = {(r["k"], r["o"]): r["pos"] for r in ordering.with_position(df, ["k"], ["o"], weight="n").collect()}
    assert got == {(k, o): None if o is None else sum(1 + j % 3 for j in range(o)) for k, o, _ in rows}
