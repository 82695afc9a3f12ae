"""Features of disjoint time windows: one grouping, one aggregation."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from kinetable.functions import stats
from kinetable.operators.clean import DEFAULT_START
from kinetable.schema import SENSORS, axis_columns

DEFAULT_STATISTICS = ("mean", "std", "var", "rms")
EPOCH = datetime(1970, 1, 1)


def parse_size(size):
    """Seconds of a window size such as ``10``, ``"10s"`` or ``"500ms"``."""
    if isinstance(size, (int, float)):
        return timedelta(seconds=size)
    text = size.strip()
    if text.endswith("ms"):
        return timedelta(milliseconds=float(text[:-2]))
    if text.endswith("s"):
        return timedelta(seconds=float(text[:-1]))
    if text.endswith("min"):
        return timedelta(minutes=float(text[:-3]))
    raise ValueError(f"cannot read window size {size!r}")


def window_column(ts, size, origin=DEFAULT_START):
    """Spark time window whose bins start at midnight of the origin's day.

    Spark counts windows from 1970; sizes that do not divide a day need the
    matching start offset.
    """
    step = parse_size(size)
    midnight = datetime.fromisoformat(str(origin)).replace(
        hour=0, minute=0, second=0, microsecond=0
    )
    micros = timedelta(microseconds=1)
    shift = ((midnight - EPOCH) % step) // micros
    width = step // micros
    return F.window(ts, f"{width} microseconds", startTime=f"{shift} microseconds")


def tumble(df, size, ts="ts", origin=DEFAULT_START):
    """Add ``win_start``, the start of the row's window; bins are [start, end)."""
    bin_ = window_column(F.col(ts), size, origin)
    return df.withColumn("_win", bin_).withColumn("win_start", F.col("_win.start")).drop("_win")


def first_lower(position, sensor):
    """Suffix rule of tumbling features: the first statistic is in lower case."""
    return sensor.lower() if position == 0 else sensor


def tumble_features(
    df,
    size="10s",
    f_list=DEFAULT_STATISTICS,
    layout=SENSORS,
    session="session_id",
    label="label",
    origin=DEFAULT_START,
    keep_incomplete=False,
    parity=False,
    extra_keys=(),
    classes=None,
):
    """All statistics, magnitude, pair correlations and the majority label.

    One hash aggregation: partial aggregates are formed before the only
    shuffle, whose key includes the window, so a long recording does not make
    a hot partition.  ``parity`` reproduces two slips of the original scripts:
    the label enters the magnitude, and the chest means show the right sensor.
    """
    stats.check_statistics(f_list)
    keys = [session, *extra_keys, "win_start"]
    by, windowed = keys, df
    if df.isStreaming:
        # The watermark belongs to the window column itself, so group by that.
        by = [*keys[:-1], window_column(F.col("ts"), size, origin).alias("_win")]
    elif "win_start" not in df.columns:
        windowed = tumble(df, size, origin=origin)
    swap = right_for_chest if parity and {"R", "C"} <= set(layout) else None
    columns, custom = stats.axis_statistics(layout, f_list, first_lower, swap)
    sources = axis_columns(layout) + ([label] if parity else [])
    columns.append(stats.mean_magnitude(sources).alias("mean_mag"))
    columns += stats.pair_correlations(layout)
    if label in df.columns:
        columns.append(stats.majority(F.col(label), classes).alias(label))
    features = windowed.groupBy(*by).agg(*columns).withColumns(custom)
    if df.isStreaming:
        features = features.withColumn("win_start", F.col("_win.start")).drop("_win")
        names = [c for c in features.columns if c not in keys]
        features = features.select(*keys, *names)
    if keep_incomplete:
        return features
    return features.dropna("any")


def right_for_chest(position, column):
    """The first statistic of the chest axes reads the right sensor."""
    return column.replace("C", "R") if position == 0 else column


def window_apply(df, size, func, schema, session="session_id", ts="ts", origin=DEFAULT_START):
    """A Python function from one window's rows to a table of results.

    ``func`` gets the rows of one window of one recording as a pandas table,
    whose size the sampling rate bounds; ``schema`` is the type of its result,
    to which the window's key is added.  Columns the function does not need
    should be dropped before.  Windows lie one after the other in sorted
    batches, so a batch takes many of them to Python at once.
    """
    kinds = dict(df.dtypes)
    windowed = tumble(df, size, ts, origin).withColumn("_key", F.col(session).cast("string"))
    sorted_rows = windowed.repartition(session, "win_start").sortWithinPartitions(session, "win_start", ts)

    def starts(rows):
        """Places of the first rows of windows."""
        key, before = rows["_key"], rows["_key"].shift()
        other = ((key != before) & ~(key.isna() & before.isna())) | (rows["win_start"] != rows["win_start"].shift())
        other.iloc[0] = True
        return np.flatnonzero(other.to_numpy())

    def applied(rows, begins):
        plain = rows.drop(columns="_key")
        ends = [*begins[1:], len(rows)]
        found = [func(plain.iloc[a:b].reset_index(drop=True)) for a, b in zip(begins, ends)]
        out, owner = pd.concat(found, ignore_index=True), np.repeat(begins, [len(f) for f in found])
        out.insert(0, "_key", rows["_key"].to_numpy()[owner])
        out.insert(1, "win_start", rows["win_start"].to_numpy()[owner])
        return out

    def run(batches):
        waiting = None  # the last window so far: the next batch may go on with it
        for rows in batches:
            if not len(rows):
                continue
            rows = rows if waiting is None else pd.concat([waiting, rows], ignore_index=True)
            begins = starts(rows)
            if len(begins) > 1:
                yield applied(rows.iloc[: begins[-1]], begins[:-1])
            waiting = rows.iloc[begins[-1] :].reset_index(drop=True)
        if waiting is not None:
            yield applied(waiting, np.array([0]))

    made = sorted_rows.mapInPandas(run, f"_key string, win_start timestamp_ntz, {schema}")
    rest = [c for c in made.columns if c not in ("_key", "win_start")]
    return made.select(F.col("_key").cast(kinds[session]).alias(session), "win_start", *rest)


def feature_cells(features):
    """Number of cells of a feature table: rows times columns."""
    return features.agg((F.count(F.lit(1)) * F.lit(len(features.columns))).alias("cells"))


def with_window_sizes(df, sizes, ts="ts"):
    """One copy of every row per window size, with its window start.

    All sizes are then computed by one grouping on ``(wsize, win_start)``.
    """
    choices = [
        F.struct(
            F.lit(parse_size(s).total_seconds()).alias("wsize"),
            bin_start(F.col(ts), s).alias("win_start"),
        )
        for s in sizes
    ]
    return df.select(*df.columns, F.inline(F.array(*choices)))


def bin_start(ts, size, origin=DEFAULT_START):
    """Start of the bin that holds ``ts``, by integer arithmetic on microseconds."""
    midnight = F.lit(str(origin)).cast("timestamp_ntz")
    midnight = F.date_trunc("day", midnight).cast("timestamp_ntz")
    width = F.lit(parse_size(size) // timedelta(microseconds=1))
    elapsed = F.timestamp_diff("MICROSECOND", midnight, ts)
    return F.timestamp_add("MICROSECOND", elapsed - F.pmod(elapsed, width), midnight)


def tumble_sweep(df, sizes, **options):
    """Tumbling features for several window sizes in one job."""
    sized = with_window_sizes(df, sizes)
    return tumble_features(sized, extra_keys=("wsize",), **options)
