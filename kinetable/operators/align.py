"""Alignment of sensors, of message batches, and gating by control events."""

from pyspark.sql import Window, functions as F

from kinetable.operators.ordering import slice_cuts, time_slice, with_position, with_whole_position
from kinetable.schema import AXES, BATCH_ROWS, SENSOR_NAMES, SENSORS
from kinetable.session import checkpointed

TOPICS = tuple(SENSOR_NAMES[s] for s in SENSORS)


def align_sensors(samples, session="session_id", seq="seq", label="label"):
    """Wide rows for the positions that all three sensors have.

    One shuffle on (session, position) for all three sensors; the label is the
    chest sensor's.  Equal to two inner joins as long as a sensor has one row
    per position.
    """
    columns = [
        F.max(F.when(F.col("sensor") == s, F.col(a))).alias(f"{a}{s}")
        for s in SENSORS
        for a in AXES
    ]
    present = [F.max(F.when(F.col("sensor") == s, 1)).alias(f"_has{s}") for s in SENSORS]
    tail = []
    if label in samples.columns:
        tail.append(F.max(F.when(F.col("sensor") == SENSORS[-1], F.col(label))).alias(label))
    wide = samples.groupBy(session, seq).agg(*columns, *tail, *present)
    complete = wide.where(F.col("_hasL") + F.col("_hasR") + F.col("_hasC") == 3)
    return complete.drop("_hasL", "_hasR", "_hasC")


def join_sensors(left, right, chest, on=("session_id", "seq"), label="label"):
    """The same alignment as two equi-joins of three per-sensor tables."""
    on = list(on)

    def named(table, sensor, extra=()):
        return table.select(*on, *[F.col(a).alias(f"{a}{sensor}") for a in AXES], *extra)

    tail = [label] if label in chest.columns else []
    return named(left, "L").join(named(right, "R"), on).join(named(chest, "C", tail), on)


def message_rows(samples, n=BATCH_ROWS, session="session_id", seq="seq"):
    """Samples grouped into messages of ``n`` positions, as sorted arrays.

    The group is one message, so the collected list has at most ``n`` rows.
    The message comes before the topic in the key: Spark sorts the groups of a
    collected list, and rows that lie in order are then nearly sorted.
    """
    named = F.create_map(*[F.lit(x) for pair in SENSOR_NAMES.items() for x in pair])
    row = F.struct((F.col(seq) % n + 1).cast("int").alias("index"), "x", "y", "z")
    grouped = samples.groupBy(
        session, F.floor(F.col(seq) / n).alias("batch"), named[F.col("sensor")].alias("topic")
    ).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    # The rows of a message name its sensor, but are moved without it.
    full = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("index", "x", "y", "z")], F.col("topic").alias("sensor")))
    grouped = grouped.withColumn("rows", full)
    return grouped.select(session, "topic", "batch", "rows")


def to_batches(samples, n=BATCH_ROWS, session="session_id", seq="seq"):
    """Message payloads: JSON arrays whose numbers have six decimals."""
    messages = message_rows(samples, n, session, seq)
    item = F.transform(
        "rows",
        lambda r: F.format_string(
            '{"index": %d, "x": %f, "y": %f, "z": %f, "sensor": "%s"}',
            r["index"], r["x"], r["y"], r["z"], r["sensor"],
        ),
    )
    payload = F.concat(F.lit("["), F.array_join(item, ","), F.lit("]"))
    return messages.select(session, "topic", "batch", F.size("rows").cast("long").alias("n"), payload.alias("payload"))


def with_ordinal(messages, keys=("session_id", "topic"), order=("batch",)):
    """Number the messages of every topic in arrival order, from 0.

    Only keys and order are numbered, and written out once for that; the
    messages themselves then meet their numbers where a grouping by keys and
    order has put them, and are not shuffled for their places.  Where every key
    has few messages they are counted where a grouping by the first key has put them.
    """
    keys, order = list(keys), list(order)
    groups = checkpointed(messages.groupBy(*keys, *order).agg(F.count(F.lit(1)).alias("_n")))
    cuts = slice_cuts(groups, keys, order)
    if not cuts:
        return with_whole_position(messages, keys, order, "ordinal")
    placed = with_position(groups, keys, order, out="_first", weight="_n", cuts=cuts)
    placed = placed.select("_first", *[F.col(c).alias(f"_o{i}") for i, c in enumerate([*keys, *order])])
    alike = Window.partitionBy(*keys, *order).orderBy(*order)
    ranked = messages.withColumn("_same", F.row_number().over(alike) - 1)
    same = F.lit(True)
    for i, c in enumerate([*keys, *order]):
        # Of the order only the first column must be known.
        same = same & (F.col(c).eqNullSafe(F.col(f"_o{i}")) if i > len(keys) else F.col(c) == F.col(f"_o{i}"))
    joined = ranked.join(placed, same, "left")
    return joined.select(*messages.columns, (F.col("_first") + F.col("_same")).cast("long").alias("ordinal"))


def pair_batches(messages, session="session_id", ordinal="ordinal"):
    """Pair the n-th message of each topic with the n-th of the other two.

    A message without two partners stays out, like an unanswered queue entry.
    """
    # The triple (session, topic, ordinal) is unique: every list has one entry.
    sides = [F.collect_list(F.when(F.col("topic") == t, F.col("rows"))).alias(t) for t in TOPICS]
    grouped = messages.groupBy(session, ordinal).agg(*sides)
    complete = grouped
    for t in TOPICS:
        complete = complete.where(F.size(t) > 0)
    return complete.select(session, ordinal, *[F.get(t, F.lit(0)).alias(t) for t in TOPICS])


def align_batches(pairs, keys=("session_id", "ordinal")):
    """Zip paired messages by position and keep positions whose indexes agree.

    Lists of different length are cut to the shortest one; a disagreement skips
    that position only.
    """
    zipped = pairs.select(*keys, F.posexplode(F.arrays_zip(*TOPICS)).alias("pos", "r"))
    index = [F.col(f"r.{t}.index") for t in TOPICS]
    agreed = zipped.where((index[0] == index[1]) & (index[0] == index[2]))
    return agreed.select(
        *keys,
        "pos",
        index[0].alias("index"),
        *[
            F.col(f"r.{SENSOR_NAMES[s]}.{a}").alias(f"{a}{s}")
            for s in SENSORS
            for a in AXES
        ],
    )


def gate_by_control(samples, control, device="device", ts="ts", bucket_seconds=86400, command="command"):
    """Keep the samples whose device's last command, at their time or before, is a start.

    Commands and samples of a device are walked together in slices of time,
    and the last command of the slices before is carried into a slice: one
    pass, however often a device toggles.  Of commands at the same time the
    last by name counts.  Rows without a device or time are dropped.
    """
    commands = control.select(device, ts, F.col(command).alias("_command"), F.lit(0).alias("_sample"))
    both = samples.withColumn("_sample", F.lit(1)).unionByName(commands, allowMissingColumns=True)
    both = both.withColumn("_slice", time_slice(ts, bucket_seconds))
    within = Window.partitionBy(device, "_slice").orderBy(ts, "_sample", "_command")
    walked = both.withColumn("_near", F.last("_command", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.when(F.col("_command").isNotNull(), F.struct(ts, "_command"))
    ends = both.groupBy(device, "_slice").agg(F.max_by("_command", place).alias("_end"))
    earlier = Window.partitionBy(device).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(device, "_slice", F.last("_end", ignorenulls=True).over(earlier).alias("_before"))
    joined = walked.where("_sample = 1").join(carried, [device, "_slice"])
    return joined.where(F.coalesce("_near", "_before") == "start").select(*samples.columns)


def ready_from(status, session="session_id", sensors=SENSORS, ts="ts"):
    """Time from which a session has all its sensors switched on."""
    on = status.where(F.col("status") == "on")
    firsts = [F.min(F.when(F.col("sensor") == s, F.col(ts))).alias(f"_on{s}") for s in sensors]
    grouped = on.groupBy(session).agg(*firsts)
    complete = grouped.dropna("any", subset=[f"_on{s}" for s in sensors])
    return complete.select(session, F.greatest(*[f"_on{s}" for s in sensors]).alias("ready"))


def gate_by_ready(samples, status, session="session_id", sensors=SENSORS, ts="ts"):
    """Drop samples taken before the last of the session's sensors came on."""
    ready = ready_from(status, session, sensors, ts)
    return samples.join(ready, session).where(F.col(ts) >= F.col("ready")).drop("ready")
