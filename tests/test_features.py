"""Hand-made windows: ties, constant axes, gaps, alignment, short frames."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from kinetable.functions import stats
from kinetable.operators import clean, overlap, tumble
from kinetable.schema import axis_columns

AXES = axis_columns("LRC")


def samples(spark, rows, label="label int"):
    """Rows of (session, seq, label, nine axis values)."""
    kinds = ", ".join(f"{c} double" for c in AXES)
    df = spark.createDataFrame(rows, f"session_id string, seq long, {label}, {kinds}")
    return clean.with_time_axis(df, period_us=100_000)


def noise(n, seed=0, session="a", label=lambda i: 1):
    rng = np.random.default_rng(seed)
    return [(session, i, label(i), *map(float, rng.normal(size=9))) for i in range(n)]


def test_majority_tie_is_smallest_with_and_without_classes(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (2, 5), (2, 5), (2, 2)], "g int, label int")
    for classes in (None, (2, 3, 5)):
        out = df.groupBy("g").agg(stats.majority(F.col("label"), classes).alias("m")).collect()
        assert {r["g"]: r["m"] for r in out} == {1: 2, 2: 5}


def test_majority_rejects_labels_outside_the_list(spark):
    df = spark.createDataFrame([(1, 3), (1, 9)], "g int, label int")
    with pytest.raises(Exception, match="outside the class list"):
        df.groupBy("g").agg(stats.majority(F.col("label"), (3,)).alias("m")).collect()


def test_constant_axis_and_single_row_have_no_correlation(spark):
    rows = noise(20)
    rows = [(*r[:3], 5.0, *r[4:]) for r in rows] + [("b", 0, 1, *([1.0] * 9))]
    out = {r["session_id"]: r for r in tumble.tumble_features(samples(spark, rows), "2s", keep_incomplete=True).collect()}
    assert out["a"]["xyL"] is None and out["a"]["xL_std_L"] == 0.0 and out["a"]["yzL"] is not None
    assert out["b"]["xL_std_L"] is None and out["b"]["xL_rms_L"] == 1.0
    whole = tumble.tumble_features(samples(spark, rows), "2s").collect()
    assert whole == []


def test_statistics_match_numpy(spark):
    rows = noise(40, seed=5)
    out = tumble.tumble_features(samples(spark, rows), "2s").orderBy("win_start").collect()
    assert len(out) == 2
    block = np.array([r[3:] for r in rows[:20]])
    first = out[0].asDict()
    for i, c in enumerate(AXES):
        s = c[1]
        assert first[f"{c}_mean_{s.lower()}"] == pytest.approx(block[:, i].mean())
        assert first[f"{c}_std_{s}"] == pytest.approx(block[:, i].std(ddof=1))
        assert first[f"{c}_var_{s}"] == pytest.approx(block[:, i].var(ddof=1))
        assert first[f"{c}_rms_{s}"] == pytest.approx(np.sqrt((block[:, i] ** 2).mean()))
    assert first["mean_mag"] == pytest.approx(np.sqrt((block**2).sum(1)).mean())
    assert first["xzR"] == pytest.approx(np.corrcoef(block[:, 3], block[:, 5])[0, 1])


def test_parity_shows_the_right_sensor_and_the_label(spark):
    rows = noise(20, seed=6, label=lambda i: 2)
    out = tumble.tumble_features(samples(spark, rows), "2s", parity=True).collect()[0]
    block = np.array([r[3:] for r in rows])
    assert out["xC_mean_c"] == pytest.approx(block[:, 3].mean())
    assert out["xC_std_C"] == pytest.approx(block[:, 6].std(ddof=1))
    assert out["mean_mag"] == pytest.approx(np.sqrt((block**2).sum(1) + 4).mean())


def test_sizes_that_do_not_divide_a_day_start_at_midnight(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:09",), ("2024-01-02 00:00:01",)], "t string").select(
        F.col("t").cast("timestamp_ntz").alias("ts")
    )
    out = [str(r["win_start"]) for r in tumble.tumble(df, "7s").orderBy("ts").collect()]
    # 86401 seconds after the origin is 12343 windows of 7 seconds: the origin's midnight counts.
    assert out == ["2024-01-01 00:00:07", "2024-01-02 00:00:01"]
    swept = tumble.with_window_sizes(df, ["7s"]).orderBy("ts").collect()
    assert [str(r["win_start"]) for r in swept] == out


def test_cleaning_leaves_gaps_in_time_but_not_in_position(spark):
    rows = noise(30, label=lambda i: 0 if i % 3 == 0 else 1)
    rows[5] = (*rows[5][:4], float("nan"), *rows[5][5:])
    rows[7] = (*rows[7][:4], None, *rows[7][5:])
    raw = samples(spark, rows).drop("ts").withColumnRenamed("seq", "index")
    out = clean.prepare_recordings(raw, order=["index"], period_us=100_000).orderBy("seq").collect()
    kept = [i for i in range(30) if i % 3 and i not in (5, 7)]
    assert [r["seq"] for r in out] == kept
    assert [r["pos"] for r in out] == list(range(len(kept)))
    assert [r["ts"].microsecond // 100_000 + 10 * r["ts"].second for r in out] == kept


def test_frames_equal_the_sliding_window(spark):
    rows = noise(95, seed=8) + noise(7, seed=9, session="short") + noise(11, seed=10, session="edge")
    df = samples(spark, rows)
    found = overlap.overlap_features(df, 2, order="seq").orderBy("session_id", "win_end").collect()
    w = Window.partitionBy("session_id").orderBy("seq").rowsBetween(-19, 0)
    slid = (
        df.select(
            "session_id", "seq", F.avg("xL").over(w).alias("m"), F.stddev_samp("zC").over(w).alias("s"),
            F.count("*").over(w).alias("n"),
        )
        .where("seq > 0 and seq % 10 = 0").orderBy("session_id", "seq").collect()
    )
    assert [(r["session_id"], r["win_end"], r["n_rows"]) for r in found] == [(r[0], r[1], r[4]) for r in slid]
    for a, b in zip(found, slid):
        assert a["xL_mean_l"] == pytest.approx(b["m"]) and a["zC_std_c"] == pytest.approx(b["s"])
    assert [r["n_rows"] for r in found if r["session_id"] == "a"] == [11] + [20] * 8
    assert not [r for r in found if r["session_id"] == "short"]


def test_short_frames_have_no_features(spark):
    df = samples(spark, noise(20, seed=3))
    found = overlap.overlap_features(df, 2, overlap=0.25).orderBy("win_end").collect()
    assert [r["win_end"] for r in found] == [5, 10, 15]
    assert found[0]["xL_mean_l"] is None and found[1]["xL_mean_l"] is not None
    filled = overlap.overlap_features(df, 2, overlap=0.25, fill=0.0).orderBy("win_end").collect()
    assert filled[0]["xL_mean_l"] == 0.0


def test_fourier_bins_match_numpy(spark):
    rows = noise(45, seed=11)
    found = overlap.overlap_features(
        samples(spark, rows), 2, f_list=(), fft=("zero", "positive", "negative"), magnitude=False, correlations=None
    ).orderBy("win_end").collect()
    block = np.array([r[3:] for r in rows])
    for row in found:
        frame = block[max(0, row["win_end"] - 19) : row["win_end"] + 1]
        spectrum = np.abs(np.fft.fft(frame, axis=0))
        for i, c in enumerate(AXES):
            for name, k in overlap.FFT_BINS.items():
                assert row[f"{c}_fft_{c[1].lower()}_{name}"] == pytest.approx(spectrum[k, i], abs=1e-9)


def test_self_correlation_needs_a_full_half_frame(spark):
    rows = [(*r[:3], 1.0, *r[4:]) for r in noise(25, seed=12)]
    found = overlap.overlap_features(
        samples(spark, rows), 2, f_list=(), magnitude=False, correlations="self", label=None
    ).collect()
    assert all(r["xL"] is None and r["yL"] == 1.0 for r in found)


def test_scoring_step_and_batches(spark):
    df = samples(spark, noise(20, seed=13) + noise(15, seed=14, session="b")).withColumns(
        {"batch": F.lit(0), "pos": F.col("seq")}
    )
    found = overlap.scoring_features(df, correlations=None).orderBy("session_id", "win_end").collect()
    assert [r["win_end"] for r in found] == list(range(10, 20)) + list(range(10, 15))
    assert all(v is not None for r in found for v in r)


def test_point_label_is_the_last_rows(spark):
    rows = noise(21, label=lambda i: 7 if i in (10, 20) else 1)
    point = overlap.overlap_features(samples(spark, rows), 2, label_rule="point").collect()
    mode = overlap.overlap_features(samples(spark, rows), 2).collect()
    assert {r["label"] for r in point} == {7} and {r["label"] for r in mode} == {1}


def test_sweep_equals_single_sizes(spark):
    df = samples(spark, noise(200, seed=15))
    swept = tumble.tumble_sweep(df, ["2s", "7s"], keep_incomplete=True)
    for size in (2, 7):
        one = tumble.tumble_features(df, f"{size}s", keep_incomplete=True)
        part = swept.where(F.col("wsize") == float(size)).select(*one.columns)
        a, b = one.orderBy("win_start").collect(), part.orderBy("win_start").collect()
        assert len(a) == len(b) > 0
        for x, y in zip(a, b):
            for p, q in zip(x, y):
                assert p == q or p == pytest.approx(q)


def test_custom_statistic_and_unknown_name(spark):
    def middle(values):
        return values.median()

    df = samples(spark, noise(20, seed=16))
    out = tumble.tumble_features(df, "2s", f_list=("mean", middle), layout="L").collect()[0]
    block = np.array([r[3:] for r in noise(20, seed=16)])
    assert out["xL_middle_L"] == pytest.approx(np.median(block[:, 0]))
    with pytest.raises(ValueError, match="unknown statistics"):
        tumble.tumble_features(df, "2s", f_list=("nope",))
    stats.register_statistic("peak", F.max)
    try:
        out = tumble.tumble_features(df, "2s", f_list=("peak",), layout="L").collect()[0]
        assert out["xL_peak_l"] == block[:, 0].max()
    finally:
        del stats.STATISTICS["peak"]


def test_frames_of_a_message_array_equal_the_general_way(spark):
    """Missing values, missing rows, constant axes, messages of one row and short ones, another step."""
    rng = random.Random(21)
    rows = []
    for batch, n in enumerate((20, 20, 13, 11, 1, 20)):
        for p in range(n):
            if batch != 1 or p % 6:
                x = [None if batch == 5 and rng.random() < 0.4 else rng.uniform(-3, 3) for _ in range(9)]
                x[3] = 2.0 if batch == 0 else x[3]
                rows.append(("a", batch, p, *x))
    axes = axis_columns("LRC")
    df = spark.createDataFrame(rows, f"session_id string, batch long, pos long, {', '.join(f'{c} double' for c in axes)}").repartition(3)
    options = {"f_list": ("rms", "mean", "var", "std"), "fft": ("negative", "zero")}
    for w, step, start in ((20, 1, 10), (8, 3, 2)):
        one = overlap.message_frames(df, w, step, start, ("session_id", "batch"), **options)
        other = overlap.frame_features(df, w, step, start, ("session_id", "batch"), magnitude=False, correlations=None, label=None, **options)
        assert one.columns == other.columns
        a, b = (t.orderBy("batch", "win_end").collect() for t in (one, other))
        assert len(a) == len(b) > 20
        for x, y in zip(a, b):
            assert x[:4] == y[:4]
            assert [v is None for v in x] == [v is None for v in y]
            assert [v for v in x[4:] if v is not None] == pytest.approx([v for v in y[4:] if v is not None], abs=1e-9)
    assert overlap.scoring_features(df.where("batch > 99"), correlations=None).collect() == []


def placed_walk(spark, n):
    """Two recordings of ``n`` placed rows, with a missing value now and then."""
    x = F.when(F.col("id") % 7 != 3, F.pmod(F.col("id") * 37, F.lit(101)).cast("double"))
    rows = spark.range(2 * n).select((F.col("id") % 2).alias("session_id"), F.floor(F.col("id") / 2).alias("pos"), x.alias("xL"))
    return rows.withColumns({"yL": F.col("pos") * 0.5, "zL": F.lit(1.0)})


def exchanges(df):
    return df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_close_frames_are_formed_after_one_shuffle_of_rows(spark):
    n = 300
    full = overlap.frame_features(placed_walk(spark, n), 4, 1, 1, layout="L", f_list=("mean",), magnitude=False, correlations=None, label=None)
    before_shuffle = exchanges(full)[1].split("Exchange hashpartitioning")
    assert len(before_shuffle) == 2 and "Aggregate" not in before_shuffle[1]
    got = {(r["session_id"], r["win_end"]): (r["n_rows"], r["xL_mean_l"]) for r in full.collect()}
    rows = {(r["session_id"], r["pos"]): r["xL"] for r in placed_walk(spark, n).collect()}
    assert len(got) == 2 * (n - 1)
    for (session, end), (size, mean) in got.items():
        inside = [rows[session, p] for p in range(max(0, end - 3), end + 1)]
        known = [v for v in inside if v is not None]
        assert size == len(inside) and mean == pytest.approx(sum(known) / len(known))


def test_python_statistic_takes_many_windows_at_once(spark):
    def known_and_all(values):
        return values.count() * 1000 + len(values)

    options = dict(layout="L", magnitude=False, correlations=None, label=None)
    full = overlap.frame_features(placed_walk(spark, 150), 20, 10, 10, f_list=("mean", known_and_all), **options)
    assert "AggregateInPandas" not in exchanges(full)[0] and "ArrowAggregatePython" not in exchanges(full)[0]
    rows = {(r["session_id"], r["pos"]): r["xL"] for r in placed_walk(spark, 150).collect()}
    for r in full.collect():
        inside = [rows[r["session_id"], p] for p in range(max(0, r["win_end"] - 19), r["win_end"] + 1)]
        assert r["xL_known_and_all_l"] == sum(v is not None for v in inside) * 1000 + len(inside)


def test_window_apply_hands_windows_of_a_batch_to_python_together(spark):
    rows = spark.range(2000).select(
        F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("session_id"), F.timestamp_add(
            "MILLISECOND", F.col("id") * 10, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"), F.col("id").alias("v"))

    def ends(part):
        return pd.DataFrame({"first": [part["v"].iloc[0]], "last": [part["v"].iloc[-1]], "n": [len(part)]})

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")  # windows of 100 / 3 rows and batches cross
    try:
        made = tumble.window_apply(rows.repartition(5), "1s", ends, "first long, last long, n long")
        assert "FlatMapGroups" not in exchanges(made)[0]
        got = sorted((r["session_id"] or 0, r["win_start"].second, r["first"], r["last"], r["n"]) for r in made.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for s in range(3):
        for second in range(20):
            mine = [i for i in range(100 * second, 100 * second + 100) if i % 3 == s]
            want.append((s, second, mine[0], mine[-1], len(mine)))
    assert got == want


def test_columns_made_late_are_cleaned_but_not_moved(spark):
    nan = float("nan")
    rows = [(1, i, v, 1 if i != 3 else 0) for i, v in enumerate([1.0, None, nan, 4.0, 5.0, 0.0])]
    df = spark.createDataFrame(rows, "session_id long, index long, q double, label int")
    made = {"half": F.col("q") / 2.0, "ratio": F.lit(1.0) / F.nullif(F.col("q"), F.lit(0.0))}
    late = clean.prepare_recordings(df, made=made)
    early = clean.prepare_recordings(df.withColumns(made))
    got = [(r["seq"], r["pos"], r["ts"], r["half"], r["ratio"]) for r in late.orderBy("seq").collect()]
    assert got == [(r["seq"], r["pos"], r["ts"], r["half"], r["ratio"]) for r in early.orderBy("seq").collect()]
    assert [g[:2] for g in got] == [(0, 0), (4, 1)]
    plan = late._jdf.queryExecution().executedPlan().toString().split("\n")
    moved = plan[next(i for i, line in enumerate(plan) if "Exchange hashpartitioning(session_id" in line) + 1]
    assert "q#" in moved and "_usable" in moved and moved.split("Project ")[1].count("half#") <= moved.count("isnotnull(half#")
