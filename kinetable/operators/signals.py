"""State signals: sensor status, buttons, slow sensors, class names."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F, types as T

from kinetable.operators.ordering import time_slice, with_neighbour
from kinetable.schema import CHEST_ACTIVITIES, RECORDED_ACTIVITIES, STILL_POSES
from kinetable.session import checkpointed, small_batches

# ---------------------------------------------------------------- fixed values
# Bits of a button notification and their names.
ALL_BUTTONS = 3
BUTTON_NAMES = {1: "Right button", 2: "Left button", 3: "Both buttons"}
# ------------------------------------------------------------ end fixed values

CATALOGUES = {
    "chest": CHEST_ACTIVITIES,
    "recorded": RECORDED_ACTIVITIES,
    "poses": STILL_POSES,
}


def labels_dim(spark, kind="chest"):
    """Class names by label; a handful of rows."""
    return spark.createDataFrame(sorted(CATALOGUES[kind].items()), "label int, name string")


def with_label_name(df, names, label="label"):
    """Attach the class name; ``names`` is the fixed list of ``labels_dim``."""
    return df.join(F.broadcast(names), label, "left")


def parse_temp_hum(text):
    """Temperature and humidity of a text message ``"<t> <h>"``, both integers."""
    parts = F.split(text, " ")
    return F.struct(
        F.get(parts, F.lit(0)).try_cast("int").alias("temp"),
        F.get(parts, F.lit(1)).try_cast("int").alias("hum"),
    )


def shown_humidity(column):
    """The screen shows humidity without its sign."""
    return F.abs(column)


def latest(df, keys, value, ts="ts", out=None):
    """Newest value per key; partial maxima before the shuffle."""
    return df.groupBy(*keys).agg(F.max_by(value, ts).alias(out or value))


def status_changes(status, sensor="sensor", ts="ts", slice_seconds=86400):
    """Rows on which a sensor's light flips; every sensor starts switched off."""
    before = with_neighbour(
        status, [sensor], [ts], "status", "_before", time_slice(ts, slice_seconds)
    )
    changed = F.col("status") != F.coalesce(F.col("_before"), F.lit("off"))
    return before.where(changed).drop("_before")


def keypress_edges(presses, device="device", ts="ts", value="value", slice_seconds=86400):
    """Buttons pressed and released at every notification, as bit masks.

    The first notification of a device is compared with no button pressed.
    """
    seen = with_neighbour(
        presses, [device], [ts], value, "_last", time_slice(ts, slice_seconds)
    )
    now, last = F.col(value), F.coalesce(F.col("_last"), F.lit(0))
    down = now.bitwiseAND(F.bitwise_not(last)).bitwiseAND(F.lit(ALL_BUTTONS))
    up = F.bitwise_not(now).bitwiseAND(last).bitwiseAND(F.lit(ALL_BUTTONS))
    return seen.withColumns({"down": down, "up": up}).drop("_last")


def button_name(mask):
    """Readable name of a button mask."""
    names = F.create_map(*[F.lit(x) for pair in BUTTON_NAMES.items() for x in pair])
    return F.try_element_at(names, mask.cast("int"))


def first_per_period(df, keys, ts="ts", seconds=60):
    """First row of every fixed period: the plain form of slow sampling."""
    others = [c for c in df.columns if c not in keys]
    picked = df.withColumn("period", time_slice(ts, seconds)).groupBy(*keys, "period").agg(
        F.min_by(F.struct(*others), F.col(ts)).alias("_row")
    )
    return picked.select(*keys, "period", "_row.*")


@F.pandas_udf(T.ArrayType(T.LongType()))
def next_entries(late: pd.Series, following: pd.Series, after: pd.Series) -> pd.Series:
    """Place of the first entry after each of ``late``: 2 i in the following slice, 2 i + 1 in the one after it, -1 for none."""
    found = []
    for times, first, second in zip(late, following, after):
        times, first, second = (np.zeros(0, np.int64) if x is None else np.asarray(x, np.int64) for x in (times, first, second))
        one, two = (np.searchsorted(x, times, side="right") for x in (first, second))
        found.append(np.where(one < len(first), 2 * one, np.where(two < len(second), 2 * two + 1, -1)))
    return pd.Series(found)


def chained_entries(slices, gap):
    """(_key, _s, _times, _entry): where the chain from a key's first row enters each of its slices.

    ``slices`` has the times of every slice, its possible entries ``_ins`` and where they leave it.
    A slice is at least two gaps long, so a chain passes over one slice at most.
    """
    group = F.floor(F.col("piece") / F.lit(1000))
    named = slices.withColumnRenamed("_s", "piece")
    named = with_neighbour(named, ["_key"], ["piece"], "piece", "_s1", group, ahead=True)
    named = with_neighbour(named, ["_key"], ["piece"], "_s1", "_s2", group, ahead=True).withColumnRenamed("piece", "_s")
    lists = slices.select(F.col("_key").alias("_k"), F.col("_s").alias("_at"), "_ins")
    for i in (1, 2):
        other = lists.select(F.col("_k").alias(f"_k{i}"), F.col("_at").alias(f"_at{i}"), F.col("_ins").alias(f"_ins{i}"))
        named = named.join(other, (F.col("_key") == F.col(f"_k{i}")) & (F.col(f"_s{i}") == F.col(f"_at{i}")), "left")
    late = F.transform("_outs", lambda t: t + F.lit(gap))
    steps = named.select("_key", "_s", "_s1", "_s2", F.posexplode(next_entries(late, "_ins1", "_ins2")).alias("_i", "_to"))
    steps = steps.where("_to >= 0").select(
        "_key", "_s", "_i", F.when(F.col("_to") % 2 == 0, F.col("_s1")).otherwise(F.col("_s2")).alias("_ts"),
        F.floor(F.col("_to") / 2).cast("int").alias("_ti"),
    )
    steps = checkpointed(steps)
    known = checkpointed(slices.groupBy("_key").agg(F.min("_s").alias("_s")).select("_key", "_s", F.lit(0).alias("_i")))
    most = slices.groupBy("_key").count().agg(F.max("count").alias("n")).first()["n"] or 0
    for turn in range(max(0, most - 1).bit_length()):
        reached = known.join(steps, ["_key", "_s", "_i"]).select("_key", F.col("_ts").alias("_s"), F.col("_ti").alias("_i"))
        known = checkpointed(known.unionByName(reached))
        further = steps.select("_key", F.col("_s").alias("_ts"), F.col("_i").alias("_ti"), F.col("_ts").alias("_us"), F.col("_ti").alias("_ui"))
        doubled = steps.join(further, ["_key", "_ts", "_ti"])
        steps = checkpointed(doubled.select("_key", "_s", "_i", F.col("_us").alias("_ts"), F.col("_ui").alias("_ti")))
    return known.join(slices, ["_key", "_s"]).select("_key", "_s", "_times", F.get("_ins", F.col("_i")).alias("_entry"))


def slice_steps(batch, width, gap):
    """The times of a batch of slices in one line, and each one's successor in a chain.

    Returns the times, their slice's place in the batch, where each slice ends, the times
    on a line that keeps slices more than a gap apart, and the place of the first time of the same
    slice that is more than ``gap`` later (a time's own place if it leaves the slice).
    """
    lists = batch.column("_times")
    t, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    owner, ends = np.repeat(np.arange(batch.num_rows), lengths), np.cumsum(lengths)
    line = t - batch.column("_s").to_numpy()[owner] * width + owner * 2 * width
    after = np.searchsorted(line, line + gap, side="right")
    return t, owner, ends, line, np.where(after < ends[owner], after, np.arange(len(t)))


def thin_by_gap(df, key, ts="ts", seconds=60, slice_seconds=86400):
    """Keep a row when more than ``seconds`` have passed since the last kept one.

    The rule is sequential per key.  Keys are cut into slices of time: every slice lists where
    a chain that enters it at one of its first rows would leave it, and so where it would
    enter the next slice.  These steps are composed by pointer doubling: after r rounds the
    entries of 2**r slices are known, so a key of n slices takes log2(n) joins on
    (key, slice, entry), which spread one key over all tasks.  Every slice then marks its
    rows from its known entry.  Many slices are worked off together as one line of times.  Entries lie within the first ``seconds`` of a slice, so
    the lists are smaller than the data by ``slice_seconds / seconds``.
    """
    gap = int(seconds * 1_000_000)
    width = int(slice_seconds * 1_000_000)
    if width < 2 * gap:
        raise ValueError("a slice must be at least two gaps long")
    small_batches(df.sparkSession)
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    timed = df.withColumn("_t", F.timestamp_diff("MICROSECOND", zero, F.col(ts)))
    key_type = dict(df.dtypes)[key]
    # Rows of one key and time are kept or dropped together.
    cut = timed.select(F.col(key).alias("_key"), "_t", F.floor(F.col("_t") / F.lit(width)).alias("_s"))
    cut = cut.where("_key is not null and _t is not null").distinct()
    times = cut.groupBy("_key", "_s").agg(F.sort_array(F.collect_list("_t")).alias("_times"))

    def exits(batches):
        for batch in batches:
            t, owner, ends, line, after = slice_steps(batch, width, gap)
            leave = after
            while not np.array_equal(leave, leave[leave]):
                leave = leave[leave]
            lengths = np.diff(ends, prepend=0)
            early = np.bincount(owner[line % (2 * width) <= gap], minlength=batch.num_rows)
            taken = np.arange(len(t)) - (ends - lengths)[owner] <= early[owner]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.minimum(early + 1, lengths))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[taken])) for x in (t, t[leave])]
            yield pa.record_batch([*batch.columns, *lists], names=["_key", "_s", "_times", "_ins", "_outs"])

    def mark(batches):
        for batch in batches:
            t, _, ends, line, after = slice_steps(batch, width, gap)
            base = np.arange(batch.num_rows) * 2 * width - batch.column("_s").to_numpy() * width
            at = np.searchsorted(line, base + batch.column("_entry").to_numpy())
            kept, owner = [], np.arange(batch.num_rows)
            while len(at):
                kept.append((owner, at))
                further = after[at] != at
                owner, at = owner[further], after[at[further]]
            if kept:
                owner, at = (np.concatenate(x) for x in zip(*kept))
                yield pa.record_batch([batch.column("_key").take(pa.array(owner)), pa.array(t[at])], names=["_key", "_t"])

    slices = times.mapInArrow(exits, f"_key {key_type}, _s long, _times array<long>, _ins array<long>, _outs array<long>")
    entries = chained_entries(checkpointed(slices), gap)
    kept = entries.mapInArrow(mark, f"_key {key_type}, _t long")
    found = (timed[key] == kept["_key"]) & (timed["_t"] == kept["_t"])
    return timed.join(kept, found, "left_semi").select(*df.columns)
