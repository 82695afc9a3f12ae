"""Live streams: pairing of message topics, gating, scoring, device state.

Sources are any streaming tables (files, Kafka); the functions take and return
streaming tables.  ``run_to_table`` and ``run_batches`` start a query, work off
what is available and stop, which is also how a scheduled job would run them.
"""

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window, functions as F, types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from kinetable.operators import align, overlap
from kinetable.operators.evaluate import batch_scores
from kinetable.operators.tumble import tumble_features
from kinetable.session import scratch_path, shuffles_released
from kinetable.sources.messages import read_batches

EPOCH = "1970-01-01 00:00:00"


def as_instant(ts):
    """Event time for watermarks, which need an instant: the clock read as UTC."""
    zero = F.lit(EPOCH).cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", zero, ts))


def as_clock(instant):
    """The inverse of ``as_instant``, whatever the session's time zone."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), F.lit(EPOCH).cast("timestamp_ntz"))


# ------------------------------------------------------------------ running


#: What a trigger takes at most, so that a backlog is worked off in steps of bounded size.
FILES_A_TRIGGER = 256
OFFSETS_A_TRIGGER = 5_000_000


def read_table_stream(spark, folder, schema, glob="*.parquet", files_per_trigger=FILES_A_TRIGGER):
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def read_kafka(spark, servers, topics, max_offsets=OFFSETS_A_TRIGGER):
    """Messages of Kafka topics as (topic, offset, ts, payload)."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", ",".join(topics))
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    rows = reader.load()
    return rows.select(
        F.col("key").cast("string").alias("session_id"),
        "topic",
        "offset",
        F.col("timestamp").cast("timestamp_ntz").alias("ts"),
        F.col("value").cast("string").alias("payload"),
    )


STATE_CODEC = "spark.sql.streaming.stateStore.compression.codec"


@contextmanager
def small_files(spark):
    """Streams that start inside keep compressed state and let the shuffle files of a trigger go when it ends.

    A stream that was started before keeps the codec it was started with.
    """
    before = spark.conf.get(STATE_CODEC)
    spark.conf.set(STATE_CODEC, "zstd")
    try:
        with shuffles_released(spark):
            yield
    finally:
        spark.conf.set(STATE_CODEC, before)


STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
}


@contextmanager
def state_on_disk(spark):
    """Streams that start inside keep their state in RocksDB, in an amount of memory that does not grow with it."""
    before = {name: spark.conf.get(name, None) for name in STATE_ON_DISK}
    for name, value in STATE_ON_DISK.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_to_table(stream, path=None):
    """Work off the available input in append mode; the result as a table."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    with small_files(spark):
        query = (
            stream.writeStream.outputMode("append")
            .format("parquet")
            .option("checkpointLocation", f"{path}-state")
            .option("compression", "zstd")
            .trigger(availableNow=True)
            .start(path)
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


@contextmanager
def triggers_without_input(spark, wanted):
    """Whether streams that start inside run a last trigger without input once the watermark has moved."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, str(wanted and before == "true").lower())
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_batches(stream, handle, mode="append", state=None, empty_triggers=True):
    """Work off the available input through ``handle(table, batch_id)``.

    ``empty_triggers=False`` leaves out triggers without input.  That is for streams such as inner
    joins that give nothing then: the next trigger with input drops what the watermark has passed.
    """
    state = state or scratch_path(stream.sparkSession, "state")
    with triggers_without_input(stream.sparkSession, empty_triggers), small_files(stream.sparkSession):
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(handle)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


# ----------------------------------------------------- ordinals and pairing


def source_ordinals(messages, offset="offset", first=0):
    """Message number within its topic, taken from the source's own offset.

    With one partition per topic the offset counts the topic's messages, so no
    state is needed.  ``first`` is the offset at which counting starts.
    """
    return messages.withColumn("ordinal", F.col(offset) - F.lit(first))


def counted_ordinals(messages, keys=("session_id", "topic"), order="offset"):
    """Message number within its session and topic, from a counter in state.

    The state of a key is one number.  A key's messages of one trigger are
    handled together; the source's rate limit bounds them.
    """
    schema = T.StructType([*messages.schema.fields, T.StructField("ordinal", T.LongType())])

    def count(key, batches, state):
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(order)
        rows["ordinal"] = np.arange(seen, seen + len(rows))
        state.update((seen + len(rows),))
        yield rows

    return messages.groupBy(*keys).applyInPandasWithState(
        count, schema, "seen long", "append", GroupStateTimeout.NoTimeout
    )


def pair_topics(left, right, chest, delay="1 minute", session="session_id"):
    """Join the n-th messages of three topic streams.

    Each stream has ``session``, ``ordinal``, ``ts`` and ``rows``.  Partners must
    arrive within ``delay`` of each other, so that state can be dropped.
    """
    names = align.TOPICS

    def side(stream, i):
        renamed = stream.select(
            F.col(session).alias(f"s{i}"), F.col("ordinal").alias(f"o{i}"), as_instant(F.col("ts")).alias(f"t{i}"),
            F.col("rows").alias(names[i]),
        )
        return renamed.withWatermark(f"t{i}", delay)

    def near(i, j):
        wait = F.expr(f"INTERVAL {delay}")
        a, b = F.col(f"t{i}"), F.col(f"t{j}")
        return (
            (F.col(f"s{i}") == F.col(f"s{j}"))
            & (F.col(f"o{i}") == F.col(f"o{j}"))
            & (b >= a - wait)
            & (b <= a + wait)
        )

    first, second, third = (side(s, i) for i, s in enumerate((left, right, chest)))
    joined = first.join(second, near(0, 1)).join(third, near(0, 2))
    return joined.select(
        F.col("s0").alias(session), F.col("o0").alias("ordinal"), as_clock(F.col("t0")).alias("ts"), *names
    )


def topic_streams(messages, topic="topic", layout="LRC"):
    """The three topics of one message stream, parsed."""
    parsed = read_batches(messages, layout=layout)
    return [parsed.where(F.col(topic) == t) for t in align.TOPICS]


# ------------------------------------------------------- features and scores


def batch_features(pairs, keys=("session_id", "ordinal"), **options):
    """Scoring features of paired messages.

    For use inside a micro-batch: a message pair is complete in itself, so no
    state crosses micro-batches.
    """
    aligned = align.align_batches(pairs, keys)
    # Positions count the rows that aligned; a message has at most 20 rows.
    placed = aligned.withColumnRenamed("pos", "_at")
    order = Window.partitionBy(*keys).orderBy("_at")
    placed = placed.withColumn("pos", (F.row_number().over(order) - 1).cast("long")).drop("_at")
    settings = {"correlations": None, **options}
    return overlap.scoring_features(placed, keys=keys, **settings)


def score_batches(pairs, predict, keys=("session_id", "ordinal"), **options):
    """Mean predicted class and majority of every message pair.

    ``predict`` maps a feature table to one with a ``prediction`` column, for
    example a fitted pipeline's ``transform``.
    """
    return batch_scores(predict(batch_features(pairs, keys, **options)), keys)


def keyed_features(pairs, columns, keys=("session_id", "ordinal"), **options):
    """The scoring frames of message pairs with a ``key`` each and ``columns`` as a vector."""
    frames = batch_features(pairs, keys, **options)
    named = F.concat_ws("|", *[F.col(k).cast("string") for k in (*keys, "win_end")])
    vector = array_to_vector(F.array(*[F.col(c).cast("double") for c in columns]))
    return frames.select(*keys, named.alias("key"), vector.alias("features"))


def score_models(pairs, models, classes, columns, keys=("session_id", "ordinal"), **options):
    """Mean predicted class and majority of every message pair under several models.

    ``models`` maps names to fitted models that predict a place in ``classes`` from
    ``features``, for example stored neighbours and a support vector machine.  The frames
    are made once; returns ``<name>_score`` and ``<name>_majority`` per pair.
    """
    frames = keyed_features(pairs, columns, keys, **options).persist()
    return score_frames(frames, models, classes, keys), frames


def score_frames(frames, models, classes, keys):
    """``score_models`` of frames that have been made."""
    names = F.array(*[F.lit(float(c)) for c in classes])
    whole = None
    for name, model in models.items():
        scored = model.transform(frames).withColumn("prediction", F.element_at(names, (F.col("prediction") + 1).cast("int")))
        found = batch_scores(scored, keys).withColumnsRenamed({"score": f"{name}_score", "majority": f"{name}_majority"})
        whole = found if whole is None else whole.join(found, list(keys))
    return whole


#: Numbers in the copies of frames that one round of scoring sends to the cells of stored neighbours, at most.
VALUES_A_ROUND = 500_000_000


def scoring_rounds(frames, models):
    """Rounds in which a trigger's frames are scored: a neighbour search copies a frame once for every cell at most."""
    values = max([m.index.centres.size for m in models.values() if hasattr(m, "index")], default=0)
    return 1 + frames.count() * values // VALUES_A_ROUND if values else 1


def write_model_scores(pairs, models, classes, columns, path, keys=("session_id", "ordinal"), empty_triggers=True, **options):
    """Score a stream of message pairs by several models, one row per pair.

    The models are fitted before; a stored neighbour index is joined by every
    micro-batch and not built again.  Every micro-batch writes its own folder,
    so a repeated one replaces itself.  The pairs of a large one are scored in
    rounds, whose shuffle files go one after the other.
    """

    def handle(table, batch_id):
        frames = keyed_features(table, columns, keys, **options).persist()
        rounds = scoring_rounds(frames, models)
        for i in range(rounds):
            part = frames.where(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == i) if rounds > 1 else frames
            scored = score_frames(part, models, classes, keys)
            scored.write.mode("append" if i else "overwrite").parquet(f"{path}/run={batch_id}")
        frames.unpersist()

    run_batches(pairs, handle, state=f"{path}-state", empty_triggers=empty_triggers)


def write_scores(pairs, predict, path, keys=("session_id", "ordinal"), **options):
    """Score a stream of message pairs and append one row per pair to a table.

    Every micro-batch writes its own folder, so a repeated one replaces itself.
    Messages that wait for their partners do so on disk, however many they are.
    """

    def handle(table, batch_id):
        scored = score_batches(table, predict, keys, **options)
        scored.write.mode("overwrite").parquet(f"{path}/run={batch_id}")

    with state_on_disk(pairs.sparkSession):
        run_batches(pairs, handle, state=f"{path}-state")


# ------------------------------------------------------------- device state


def latest_status_stream(status, sensor="sensor", ts="ts"):
    """Newest status per sensor, for update mode."""
    return status.groupBy(sensor).agg(F.max_by("status", ts).alias("status"), F.max(ts).alias("ts"))


def tumble_stream(samples, size, delay="10 seconds", **options):
    """Features of closed windows; rows later than ``delay`` are dropped."""
    marked = samples.withColumn("ts", as_instant(F.col("ts"))).withWatermark("ts", delay)
    closed = tumble_features(marked, size, keep_incomplete=True, **options)
    return closed.withColumn("win_start", as_clock(F.col("win_start")))
