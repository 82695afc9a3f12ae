"""Streams over several micro-batches give what one batch gives."""

import datetime
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from kinetable.operators import adverts, align, tumble
from kinetable.plans import tables
from kinetable.session import RELEASE_CONF
from kinetable.streaming import live, stateful


def as_files(df, order, parts, path):
    """Write a table as files in arrival order and read one file per trigger."""
    rows = df.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        piece = df.sparkSession.createDataFrame(rows[i * size : (i + 1) * size], df.schema)
        piece.coalesce(1).write.mode("append").parquet(path)
    return live.read_table_stream(df.sparkSession, path, df.schema, files_per_trigger=1)


BASE = "2024-01-01 00:00:00"


def at(seconds):
    return F.timestamp_add("SECOND", seconds, F.lit(BASE).cast("timestamp_ntz"))


def test_counted_ordinals_continue_over_triggers(spark, scratch):
    rows = [("a", "Left", i * 3) for i in range(7)] + [("a", "Right", i * 2) for i in range(4)]
    df = spark.createDataFrame(rows, "session_id string, topic string, offset long")
    out = live.run_to_table(live.counted_ordinals(as_files(df, "offset", 4, f"{scratch}/in")), f"{scratch}/out").collect()
    assert {(r["topic"], r["offset"]): r["ordinal"] for r in out} == {(t, o): o // (3 if t == "Left" else 2) for _, t, o in rows}


GATED = [("a", 1, None), ("a", 2, "start"), ("a", 3, None), ("a", 9, None), ("a", 10, "finish"), ("a", 11, None), ("b", 4, None),
         ("a", 20, "start"), ("a", 20, None), ("b", 21, "start"), ("b", 22, None), ("a", 25, None), (None, 12, "start"), (None, 13, None),
         ("z", 90, None)]


@pytest.mark.parametrize("parts", [1, 5])
def test_gate_does_not_depend_on_triggers(spark, scratch, parts):
    """Commands come eight seconds late, so with five triggers they come in later files than their samples."""
    stateful.with_state_store(spark)
    rows = [(d, s, c, s + (8 if c else 0), f"{d}{s}", 2**60 + s) for d, s, c in GATED]
    df = spark.createDataFrame(rows, "device string, s long, command string, arrival long, tag string, big long").withColumn("ts", at(F.col("s")))
    stream = as_files(df, "arrival", parts, f"{scratch}/in")
    samples = stream.where("command is null").drop("command", "arrival")
    control = stream.where("command is not null").select("device", "ts", "command")
    out = live.run_to_table(stateful.gate_by_event_time(samples, control, delay="10 seconds"), f"{scratch}/out").collect()
    found = sorted(((r["device"], r["s"], r["tag"], r["big"]) for r in out), key=repr)
    kept = [("a", 3), ("a", 9), ("a", 20), ("a", 25), ("b", 22), (None, 13)]
    assert found == sorted(((d, s, f"{d}{s}", 2**60 + s) for d, s in kept), key=repr)
    assert all((r["ts"] - at_python(r["s"])).total_seconds() == 0 for r in out)


def at_python(seconds):
    return datetime.datetime.fromisoformat(BASE) + datetime.timedelta(seconds=seconds)


@pytest.mark.parametrize("parts", [1, 4])
def test_queues_pair_first_in_first_out(spark, scratch, parts):
    """Queues of different length, gaps in the offsets, two sessions, a topic that is late as a whole."""
    stateful.with_state_store(spark)
    rows = []
    for session, lengths in (("a", (5, 9, 7)), ("b", (3, 2, 4))):
        for topic, n in zip(align.TOPICS, lengths):
            for i in range(n):
                late = 100 if (session, topic) == ("a", "Chest") else 0
                rows.append((session, topic, 3 * i + len(topic), 10 * i + late, f'[{{"index":1,"x":{i}.5,"y":0,"z":1,"sensor":"{topic}"}}]'))
    rows.append(("a", "other", 0, 5, "ignored"))
    df = spark.createDataFrame(rows, "session_id string, topic string, offset long, s long, payload string").withColumn("ts", at(F.col("s")))
    pairs = live.run_to_table(stateful.pair_by_arrival(as_files(df, "s", parts, f"{scratch}/in")), f"{scratch}/out")
    found = sorted((r["session_id"], r["ordinal"], *[r[f"{t}_offset"] for t in align.TOPICS], r["Chest"][0]["x"]) for r in pairs.collect())
    assert found == [(s, i, *[3 * i + len(t) for t in align.TOPICS], i + 0.5) for s, n in (("a", 5), ("b", 2)) for i in range(n)]
    wide = align.align_batches(pairs).collect()
    assert sorted((r["session_id"], r["ordinal"], r["xL"], r["xR"], r["xC"]) for r in wide) == [
        (s, i, i + 0.5, i + 0.5, i + 0.5) for s, n in (("a", 5), ("b", 2)) for i in range(n)
    ]


def test_pairs_meet_in_later_triggers(spark, scratch):
    kinds = "session_id string, topic string, offset long, s long, payload string"
    rows = []
    for i in range(6):
        for j, topic in enumerate(align.TOPICS):
            if (topic, i) != ("Right", 2):
                text = f'[{{"index":1,"x":{i}.5,"y":0,"z":1,"sensor":"{topic}"}}]'
                rows.append(("a", topic, i, 10 * i + 7 * j, text))
    df = spark.createDataFrame(rows, kinds).withColumn("ts", at(F.col("s")))
    streams = [live.source_ordinals(s) for s in live.topic_streams(as_files(df, "s", 5, f"{scratch}/in"))]
    pairs = live.run_to_table(live.pair_topics(*streams), f"{scratch}/out")
    wide = align.align_batches(pairs).collect()
    assert sorted((r["ordinal"], r["xL"], r["xR"], r["xC"]) for r in wide) == [
        (i, i + 0.5, i + 0.5, i + 0.5) for i in (0, 1, 3, 4, 5)
    ]


def test_closed_windows_equal_the_batch(spark, folder, scratch):
    samples = tables.clean_imu(spark, folder).where("session_id < 4").select("session_id", "seq", "ts", "xL", "yL", "zL", "label")
    stream = as_files(samples, "ts", 3, f"{scratch}/in")
    closed = live.run_to_table(live.tumble_stream(stream, "1s", delay="2 seconds", layout="L"), f"{scratch}/out")
    whole = tumble.tumble_features(samples, "1s", layout="L", keep_incomplete=True)
    a = {(r["session_id"], r["win_start"]): r for r in closed.collect()}
    b = {(r["session_id"], r["win_start"]): r for r in whole.collect()}
    assert a and set(a) <= set(b)
    # Everything that ended before the last watermark is there.
    last = max(r["ts"] for r in samples.select("ts").collect())
    assert all(k in a or (last - k[1]).total_seconds() < 3.1 for k in b)
    for key, row in a.items():
        assert row["label"] == b[key]["label"]
        assert row["xL_mean_l"] == pytest.approx(b[key]["xL_mean_l"])
        assert row["xyL"] == pytest.approx(b[key]["xyL"]) or row["xyL"] is None


def test_advert_state_over_triggers(spark, scratch):
    stateful.with_state_store(spark)
    data = [("a", b"\x02\x01\x05"), ("b", b""), ("a", b"\x02\x01\x05"), ("a", b"\x02\x01\x06"), ("b", b"\x02\x09\x41"), ("a", b"\x02\x0a\x00"), ("a", b"\x02\x01\x06")]
    df = spark.createDataFrame([(i, a, bytearray(x)) for i, (a, x) in enumerate(data)], "seq long, addr string, data binary")
    parsed = df.select("seq", "addr", adverts.parse_fields("data").alias("list"))
    out = live.run_to_table(stateful.advert_status_stream(as_files(parsed, "seq", 4, f"{scratch}/in")), f"{scratch}/out")
    batch = adverts.advert_status(df, adverts.explode_fields(df))
    found = {r["seq"]: r["status"] for r in out.collect()}
    assert found == {r["seq"]: r["status"] for r in batch.collect()}
    assert [found[i] for i in range(7)] == ["new", "new", "old", "update", "update", "update", "old"]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_advert_state_expires(spark, scratch, parts):
    """With 10 seconds to live: a field not seen for so long is news again, a device not seen is new again."""
    stateful.with_state_store(spark)
    one, two = b"\x02\x01\x05", b"\x02\x09\x41"
    data = [(0, "a", one), (3, "a", two), (8, "a", two), (10, "a", one), (19, "a", two), (21, "a", one), (40, "a", one), (41, "b", one), (50, "a", one), (60, "a", None)]
    want = ["new", "update", "old", "old", "update", "update", "new", "new", "old", "old"]
    df = spark.createDataFrame([(i, s, a, x and bytearray(x)) for i, (s, a, x) in enumerate(data)], "seq long, s long, addr string, data binary").withColumn("ts", at(F.col("s")))
    parsed = df.select("seq", "addr", "ts", adverts.parse_fields("data").alias("list"))
    stream = stateful.advert_status_stream(as_files(parsed, "seq", parts, f"{scratch}/in"), ts="ts", ttl_seconds=10)
    out = live.run_to_table(stream, f"{scratch}/out")
    assert [r["status"] for r in out.orderBy("seq").collect()] == want


def test_scores_of_repeated_batches_replace_themselves(spark, scratch):
    rows = [(i + 1, float(i), 0.0, 1.0, t) for t in align.TOPICS for i in range(20)]
    sides = [[r for r in rows if r[4] == t] for t in align.TOPICS]
    one = "array<struct<index:int,x:double,y:double,z:double,sensor:string>>"
    df = spark.createDataFrame([("a", 0, *sides), ("a", 1, *sides)], f"session_id string, ordinal long, Left {one}, Right {one}, Chest {one}")

    def predict(features):
        return features.withColumn("prediction", F.when(F.col("xL_mean_l") > 7, 2.0).otherwise(1.0))

    live.write_scores(as_files(df, "ordinal", 2, f"{scratch}/in"), predict, f"{scratch}/scores")
    out = spark.read.parquet(f"{scratch}/scores/run=*").orderBy("ordinal").collect()
    # Frame means of positions 10..19 are 5.0 .. 9.5; five of ten exceed seven.
    assert [(r["ordinal"], r["score"], r["majority"]) for r in out] == [(0, 1.5, 1.0), (1, 1.5, 1.0)]


def test_pairs_need_no_trigger_without_input(spark, scratch):
    """Inner joins give nothing in a trigger without input, so it can be left out with the same pairs."""
    rows = spark.range(30).select(F.lit(1).alias("s"), (F.col("id") % 10).alias("n"), at(F.col("id") % 10).alias("ts"), "id")
    stream = as_files(rows, "n", 3, f"{scratch}/in")
    timed = stream.select("s", "n", live.as_instant(F.col("ts")).alias("t"), "id")
    left = timed.where("id < 10").withWatermark("t", "1 second")
    right = timed.where("id >= 10").select("n", F.col("t").alias("u"), F.col("id").alias("other")).withWatermark("u", "1 second")
    pairs = left.join(right, (left["n"] == right["n"]) & F.expr("u >= t - interval 1 second and u <= t + interval 1 second")).select("id", "other")
    seen = {}
    for empty in (True, False):
        calls = seen[empty] = []
        live.run_batches(pairs, lambda table, _, calls=calls: calls.append(sorted(map(tuple, table.collect()))), state=f"{scratch}/{empty}", empty_triggers=empty)
    assert sorted(sum(seen[True], [])) == sorted(sum(seen[False], [])) and len(sum(seen[False], [])) == 20
    assert len(seen[False]) == 3 < len(seen[True])
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_live_training_is_written_out(spark, folder):
    """Models read the frames several times; they are made once, and only the frames that are kept."""
    from registry.streams import live_training

    training = live_training(spark, folder)
    assert "Aggregate" not in training._jdf.queryExecution().toString()
    whole = tables.imu(spark, folder).groupBy("session_id", F.floor(F.col("seq") / 20)).count().where("count = 20")
    assert training.count() == whole.count()


def test_gate_reads_what_waits_once_for_all_slices_that_are_over():
    calls, waiting, timers, running = [], [], [], []
    listed = SimpleNamespace(
        appendList=waiting.extend, get=lambda: calls.append("get") or iter(list(waiting)),
        put=lambda rows: waiting.__setitem__(slice(None), rows), clear=waiting.clear,
    )
    value = SimpleNamespace(get=lambda: running[-1] if running else None, update=running.append)
    gate = stateful.EventTimeGate([SimpleNamespace(name="n")], 1_000_000)
    gate.waiting, gate.running, gate.handle = listed, value, SimpleNamespace(registerTimer=timers.append)
    rows = [{"_us": i * 500_000, "_cmd": "start" if i == 3 else "finish" if i == 40 else None, "n": i} for i in range(60)]
    list(gate.handleInputRows((1,), iter(rows), None))
    assert timers == [1000]  # one a trigger, not one a slice
    clock = SimpleNamespace(getCurrentWatermarkInMs=lambda: 25_700)
    found = list(gate.handleExpiredTimer((1,), clock, SimpleNamespace(getExpiryTimeInMs=lambda: 1000)))
    assert [r["n"] for r in found] == list(range(4, 40)) and calls == ["get"]
    assert [w[0] for w in waiting] == [i * 500_000 for i in range(50, 60)] and timers == [1000, 26_000]


def test_queues_share_groups_and_outgrow_what_is_at_hand(spark, scratch):
    """Fewer groups than sessions, one of them null; a topic waits over triggers for more than is kept beside the counters."""
    stateful.with_state_store(spark)
    n = 3 * stateful.AT_HAND
    rows = []
    for session in (None, 1, 2, 2**60 + 1):
        for j, topic in enumerate(align.TOPICS):
            for i in range(n - j):
                late = 1000 if (session, topic) == (2, "Right") else 0
                rows.append((session, topic, 2 * i + j, 10 * i + late, f'[{{"index":1,"x":{i}.5,"y":0,"z":1,"sensor":"{topic}"}}]'))
    df = spark.createDataFrame(rows, "session_id long, topic string, offset long, s long, payload string").withColumn("ts", at(F.col("s")))
    pairs = live.run_to_table(stateful.pair_by_arrival(as_files(df, "s", 3, f"{scratch}/in"), groups=2), f"{scratch}/out")
    found = [(r["session_id"], r["ordinal"], *[r[f"{t}_offset"] for t in align.TOPICS], r["Right"][0]["x"]) for r in pairs.collect()]
    want = [(s, i, 2 * i, 2 * i + 1, 2 * i + 2, i + 0.5) for s in (None, 1, 2, 2**60 + 1) for i in range(n - 2)]
    assert sorted(found, key=repr) == sorted(want, key=repr)


def test_queues_ask_the_state_twice_a_session_and_trigger():
    """Every call is a round trip between Python and Spark; a message that waits beside the counters costs none."""
    from types import SimpleNamespace

    calls = []

    def map_state(name, *_):
        held = {}
        return SimpleNamespace(
            getValue=lambda k: calls.append((name, "get")) or held.get(k),
            updateValue=lambda k, v: calls.append((name, "put")) or held.__setitem__(k, v),
            removeKey=lambda k: calls.append((name, "remove")) or held.pop(k),
        )

    pairing = stateful.FifoPairing(align.TOPICS, "session_id", "string")
    pairing.init(SimpleNamespace(getMapState=map_state))
    found = []
    for trigger in range(4):
        rows = [
            {"id": s, "topic": t, "offset": i, "at": i, "payload": f"{s}{t}{i}"}
            for s in "ab" for j, t in enumerate(align.TOPICS) for i in range(5 * trigger + j, 5 * trigger + j + 5)
        ]
        rows += [{"id": "a", "topic": "Left", "offset": -1, "at": 0, "payload": "first"}] if trigger == 0 else []
        found += pairing.handleInputRows((0,), iter(rows), None)
    assert calls == [("known", "get"), ("known", "put")] * 2 * 4
    assert [r["payload0"] for r in found if r["session_id"] == "a"][:2] == ["first", "aLeft0"]
    assert [sum(r["session_id"] == s for r in found) for s in "ab"] == [20, 20]
    long = [{"id": "c", "topic": "Left", "offset": i, "at": i, "payload": str(i)} for i in range(100)]
    for some in (long[:60], long[60:]):
        list(pairing.handleInputRows((0,), iter(some), None))
    stored = [c for c in calls if c[0] == "queue"]
    assert stored == [("queue", "put")] * (100 - stateful.AT_HAND)


def test_queues_of_sessions_that_rest(spark, scratch):
    """Sessions of one group, one null and one not a number, come in some triggers only."""
    stateful.with_state_store(spark)
    sessions, rows = (None, 1.0, 2.0, float("nan"), 5.0), []
    for k, session in enumerate(sessions):
        for trigger in range(4):
            for j, topic in enumerate(align.TOPICS):
                for i in range(3 if (trigger + k) % 2 else 0):
                    rows.append((session, topic, 10 * trigger + i, 100 * trigger + 10 * i + k + (60 if j == 1 else 0), f'[{{"index":1,"x":{j}.5,"y":0,"z":1,"sensor":"{topic}"}}]'))
    df = spark.createDataFrame(rows, "session_id double, topic string, offset long, s long, payload string").withColumn("ts", at(F.col("s")))
    pairs = live.run_to_table(stateful.pair_by_arrival(as_files(df, "s", 5, f"{scratch}/in"), groups=1), f"{scratch}/out")
    found = [(str(r["session_id"]), r["ordinal"], *[r[f"{t}_offset"] for t in align.TOPICS], r["Right"][0]["x"]) for r in pairs.collect()]
    want = []
    for k, session in enumerate(sessions):
        offsets = [10 * t + i for t in range(4) if (t + k) % 2 for i in range(3)]
        want += [(str(session), n, o, o, o, 1.5) for n, o in enumerate(offsets)]
    assert sorted(found) == sorted(want)


def few_pairs(spark, messages=12):
    """Three equal topics of 20 rows a message."""
    row = "named_struct('index', cast(i as int), 'x', cast(i + id as double), 'y', cast(i as double), 'z', 1d, 'sensor', 's')"
    df = spark.range(messages).selectExpr("1L as session_id", "id as ordinal", f"transform(sequence(1, 20), i -> {row}) as Left")
    return df.selectExpr("*", "Left as Right", "Left as Chest")


class CellModel:
    """Predicts class 0 or 1 by a mean; its index has as many numbers as one of stored neighbours."""

    def __init__(self, size):
        self.index, self.seen = SimpleNamespace(centres=np.zeros((size, 1))), []

    def transform(self, frames):
        self.seen.append(frames)
        return frames.withColumn("prediction", F.when(vector_to_array("features")[0] > 18, 1.0).otherwise(0.0))


def test_large_triggers_are_scored_in_rounds(spark, scratch, monkeypatch):
    found = {}
    for name, most in (("whole", 10**9), ("rounds", 40)):
        monkeypatch.setattr(live, "VALUES_A_ROUND", most)
        model = CellModel(1)
        stream = as_files(few_pairs(spark), "ordinal", 2, f"{scratch}/{name}")
        live.write_model_scores(stream, {"m": model}, (0, 1), ["xL_mean_l"], f"{scratch}/{name}-out")
        found[name] = sorted(map(tuple, spark.read.parquet(f"{scratch}/{name}-out/run=*").collect())), len(model.seen)
    assert found["whole"][0] == found["rounds"][0] and len(found["whole"][0]) == 12
    # 66 frames a trigger at one number each, at most 40 a round.
    assert found["whole"][1] == 2 and found["rounds"][1] == 4


def test_waiting_messages_of_scores_are_kept_on_disk(spark, scratch):
    names = ("spark.sql.streaming.stateStore.providerClass", live.STATE_CODEC, RELEASE_CONF)
    before, inside = [spark.conf.get(n) for n in names], []

    def predict(features):
        inside.append([features.sparkSession.conf.get(n) for n in names])
        return features.withColumn("prediction", F.lit(1.0))

    live.write_scores(as_files(few_pairs(spark, 2), "ordinal", 1, f"{scratch}/in"), predict, f"{scratch}/out")
    assert inside == [[live.STATE_ON_DISK[names[0]], "zstd", "true"]]
    assert [spark.conf.get(n) for n in names] == before
    assert "RocksDB" in inside[0][0]
