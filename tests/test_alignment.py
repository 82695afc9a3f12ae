"""Sensor and batch alignment, gating and status."""

import datetime as dt

from pyspark.sql import functions as F

from kinetable.operators import align, signals
from kinetable.operators.ordering import with_whole_position
from kinetable.plans import tables
from kinetable.sources import messages as msg


def long_rows(spark, present):
    """Samples of one session: positions by sensor."""
    rows = [("a", seq, s, float(seq), 0.5, -float(seq), 4) for s, seqs in present.items() for seq in seqs]
    return spark.createDataFrame(rows, "session_id string, seq long, sensor string, x double, y double, z double, label int")


def test_align_is_the_join_of_three(spark):
    df = long_rows(spark, {"L": range(0, 50), "R": range(0, 50, 2), "C": range(0, 50, 3)})
    wide = align.align_sensors(df)
    joined = align.join_sensors(*[df.where(F.col("sensor") == s) for s in "LRC"])
    assert sorted(r["seq"] for r in wide.collect()) == list(range(0, 50, 6))
    assert wide.select(sorted(wide.columns)).exceptAll(joined.select(sorted(joined.columns))).count() == 0
    assert align.align_sensors(df.where("sensor <> 'R'")).count() == 0


def batch(topic, ordinal, indexes):
    rows = [(i, float(i), 0.0, 1.0, topic) for i in indexes]
    return ("a", topic, ordinal, rows)


def test_batches_are_cut_to_the_shortest_and_skip_mismatches(spark):
    rows = [
        batch("Left", 0, [1, 2, 3, 4, 5]), batch("Right", 0, [1, 9, 3, 4]), batch("Chest", 0, [1, 2, 3, 4, 5, 6]),
        batch("Left", 1, []), batch("Right", 1, [1]), batch("Chest", 1, [1]),
        batch("Left", 2, [1]), batch("Right", 2, [1]),
    ]
    schema = "session_id string, topic string, ordinal long, rows array<struct<index:int,x:double,y:double,z:double,sensor:string>>"
    pairs = align.pair_batches(spark.createDataFrame(rows, schema))
    assert sorted(r["ordinal"] for r in pairs.collect()) == [0, 1]
    out = align.align_batches(pairs).orderBy("pos").collect()
    assert [(r["ordinal"], r["pos"], r["index"]) for r in out] == [(0, 0, 1), (0, 2, 3), (0, 3, 4)]


def test_payload_text_and_back(spark):
    df = long_rows(spark, {"L": [0, 1, 20]})
    out = align.to_batches(df).orderBy("batch").collect()
    assert out[0]["payload"] == (
        '[{"index": 1, "x": 0.000000, "y": 0.500000, "z": -0.000000, "sensor": "Left"},'
        '{"index": 2, "x": 1.000000, "y": 0.500000, "z": -1.000000, "sensor": "Left"}]'
    )
    back = msg.explode_batches(align.to_batches(df), keys=("batch",)).orderBy("batch", "index").collect()
    assert [(r["batch"], r["index"], r["x"], r["sensor"]) for r in back] == [
        (0, 1, 0.0, "Left"), (0, 2, 1.0, "Left"), (1, 1, 20.0, "Left"),
    ]


def clock(spark, rows, names):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    df = spark.createDataFrame(rows, names)
    return df.withColumn("ts", F.timestamp_add("SECOND", F.col("s"), base))


def test_gate_over_buckets(spark):
    control = clock(spark, [("a", 10, "start"), ("a", 25, "start"), ("a", 130, "finish"), ("a", 500, "start"), ("b", 5, "finish")],
                    "device string, s int, command string")
    samples = clock(spark, [("a", s) for s in (9, 10, 60, 129, 130, 499, 500, 900)] + [("b", 7), ("c", 1)], "device string, s int")
    out = align.gate_by_control(samples, control, bucket_seconds=40)
    assert sorted(r["s"] for r in out.collect()) == [10, 60, 129, 500, 900]


def test_ready_needs_all_sensors(spark):
    status = clock(spark, [("a", 1, "L", "on"), ("a", 5, "R", "on"), ("a", 7, "C", "on"), ("a", 9, "L", "on"), ("b", 1, "L", "on"), ("b", 2, "R", "off")],
                   "session_id string, s int, sensor string, status string")
    samples = clock(spark, [("a", 6), ("a", 7), ("a", 8), ("b", 50)], "session_id string, s int")
    assert sorted(r["s"] for r in align.gate_by_ready(samples, status).collect()) == [7, 8]


def test_status_and_buttons(spark):
    status = clock(spark, [("L", 1, "off"), ("L", 2, "on"), ("L", 3, "on"), ("L", 100, "off"), ("R", 1, "on")], "sensor string, s int, status string")
    flips = signals.status_changes(status, slice_seconds=10).orderBy("sensor", "s").collect()
    assert [(r["sensor"], r["s"], r["status"]) for r in flips] == [("L", 2, "on"), ("L", 100, "off"), ("R", 1, "on")]
    presses = clock(spark, [("a", 1, 1), ("a", 2, 3), ("a", 30, 2), ("a", 31, 0), ("a", 32, 4)], "device string, s int, value int")
    edges = signals.keypress_edges(presses, slice_seconds=10).orderBy("s").collect()
    assert [(r["down"], r["up"]) for r in edges] == [(1, 0), (2, 0), (0, 1), (0, 2), (0, 0)]


def test_temperature_text(spark):
    df = spark.createDataFrame([("23 -41",), ("x 5",), ("7",)], "t string").select(signals.parse_temp_hum(F.col("t")).alias("v"))
    assert [tuple(r["v"]) for r in df.collect()] == [(23, -41), (None, 5), (7, None)]


def test_label_names(spark):
    df = spark.createDataFrame([(1,), (7,), (9,)], "label int")
    out = {r["label"]: r["name"] for r in signals.with_label_name(df, signals.labels_dim(spark)).collect()}
    assert out == {1: "Working at Computer", 7: "Talking while Standing", 9: None}
    assert signals.labels_dim(spark, "recorded").count() == 3


def test_gate_of_a_busy_device_is_brute_force(spark):
    start = dt.datetime(2024, 1, 1)
    times = [start + dt.timedelta(seconds=80 * i) for i in range(1000)]
    commands = [("a", t, "start" if i % 3 else "finish") for i, t in enumerate(times)] + [("b", start, "start")]
    samples = [(d, start + dt.timedelta(seconds=s), s) for d in "abc" for s in range(0, 200_000, 40)]
    control = spark.createDataFrame(commands, "device string, ts timestamp_ntz, command string")
    rows = spark.createDataFrame(samples, "device string, ts timestamp_ntz, n long")
    found = {(r.device, r.n) for r in align.gate_by_control(rows, control).collect()}
    by_time = {t: c for d, t, c in commands if d == "a"}
    wanted, last = {("b", n) for d, _, n in samples if d == "b"}, None
    for d, t, n in samples:
        if d == "a":
            last = by_time.get(t, last)
            if last == "start":
                wanted.add((d, n))
    assert found == wanted


def test_ordinals_move_no_messages(spark):
    rows = [(1, "Left", b, [1.0] * 5) for b in (2, 2, 5, 9)] + [(1, "Right", 4, [2.0]), (None, "Left", 1, [3.0]), (2, "Left", None, [4.0])]
    messages = spark.createDataFrame(rows, "session_id long, topic string, batch long, rows array<double>")
    grouped = messages.repartition("session_id", "topic", "batch")
    numbered = align.with_ordinal(grouped)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if " rows#" in line]
    assert moved and not any("_slice" in line for line in moved)
    got = sorted((r["session_id"] or 0, r["topic"], r["batch"] or 0, -1 if r["ordinal"] is None else r["ordinal"]) for r in numbered.collect())
    assert got == [(0, "Left", 1, -1), (1, "Left", 2, 0), (1, "Left", 2, 1), (1, "Left", 5, 2), (1, "Left", 9, 3), (1, "Right", 4, 0), (2, "Left", 0, -1)]


def test_who_asks_for_keys_moves_no_readings(spark, folder):
    keys = tables.imu_long(spark, folder).groupBy("session_id", "sensor").count()
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan.replace("PartitionFilters", "")


def test_messages_of_small_sessions_are_paired_after_one_shuffle(spark):
    rows = [(s, i, t, i + 0.25, i + 0.5, i + 0.75) for s in range(200) for i in range(45) for t in "LRC" if (s, i, t) != (3, 1, "R")]
    df = spark.createDataFrame(rows, "session_id long, at long, sensor string, x double, y double, z double")
    whole = align.message_rows(with_whole_position(df, ["session_id", "sensor"], ["at"], out="seq").repartition("session_id"))
    shuffles = [p._jdf.queryExecution().executedPlan().toString().count("hashpartitioning") for p in (whole, align.pair_batches(align.with_ordinal(whole)))]
    assert shuffles[0] == shuffles[1]
    got = {(r["topic"], r["batch"]): r["rows"] for r in whole.where("session_id = 3").collect()}
    assert [r["sensor"] for r in got["Right", 0]] == ["Right"] * 20 and [r["index"] for r in got["Right", 0]] == [*range(1, 21)]
    assert got["Chest", 2][4].asDict() == {"index": 5, "x": 44.25, "y": 44.5, "z": 44.75, "sensor": "Chest"}


def test_ordinals_of_repeated_and_lost_messages(spark):
    rows = [(s, t, b) for s in range(50) for t in ("Left", "Right") for b in (0, 2, 2, 5)] + [(None, "Left", 1), (1, "Left", None)]
    df = spark.createDataFrame(rows, "session_id long, topic string, batch long")
    got = sorted((r["batch"], r["ordinal"]) for r in align.with_ordinal(df).where("session_id = 1 and topic = 'Left' and batch is not null").collect())
    assert got == [(0, 0), (2, 1), (2, 2), (5, 3)]
    assert {r["ordinal"] for r in align.with_ordinal(df).where("session_id is null or batch is null").collect()} == {None}
