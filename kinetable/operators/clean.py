"""Time axis, cleaning and projections of sample tables."""

from pyspark.ml.feature import Imputer
from pyspark.sql import functions as F

from kinetable.operators.ordering import with_position
from kinetable.schema import (
    COUNTS_PER_G,
    NULL_LABEL,
    PERIOD_US,
    SESSION_OFFSET_HOURS,
    axis_columns,
)

DEFAULT_START = "2024-01-01 00:00:00"


def add_micros(start, micros):
    """``start + micros`` on time-zone-free timestamps."""
    return F.timestamp_add("MICROSECOND", micros, start)


def as_ntz(text):
    return F.lit(text).cast("timestamp_ntz")


def with_time_axis(df, period_us=PERIOD_US, start=DEFAULT_START, position="seq", out="ts"):
    """Synthetic time of every row: ``start + position * period``.

    The position must be the one before any filter, so that dropped rows leave
    gaps in time.
    """
    origin = as_ntz(start) if isinstance(start, str) else start
    return df.withColumn(out, add_micros(origin, F.col(position) * F.lit(int(period_us))))


def with_sample_position(df, session="session_id", order=("index",), out="seq"):
    """Position of every row within its recording, before any filter."""
    return with_position(df, [session], order, out=out)


def with_session_offset(df, session="session_id", ts="ts", hours=SESSION_OFFSET_HOURS):
    """Shift every recording by ``hours`` times its rank among the recordings."""
    sessions = df.select(session).distinct().withColumn("_all", F.lit(0))
    ranks = with_position(sessions, ["_all"], [session], out="_nth").drop("_all")
    step = int(hours * 3600 * 1_000_000)
    moved = df.join(ranks, session)
    return moved.withColumn(ts, add_micros(F.col(ts), F.col("_nth") * F.lit(step))).drop("_nth")


def clean(df, label="label"):
    """Drop rows with any NULL or NaN, and rows of the null class."""
    return df.dropna("any").where(F.col(label) != NULL_LABEL)


def is_usable(df, label="label"):
    """Condition of ``clean``: nothing missing and not the null class."""
    condition = F.col(label) != NULL_LABEL
    for name, kind in df.dtypes:
        condition = condition & F.col(name).isNotNull()
        if kind in ("double", "float"):
            condition = condition & ~F.isnan(F.col(name))
    return condition


def prepare_recordings(
    df, session="session_id", order=("index",), label="label", period_us=PERIOD_US, start=DEFAULT_START, made=None, **options
):
    """Time axis, cleaning and row position of raw recordings in one pass.

    ``seq`` and ``ts`` count all rows, so cleaning leaves gaps in time; ``pos``
    counts the rows that remain, as row-count windows need it.  ``made`` maps
    names of further columns to expressions over ``df``: cleaning sees them like
    the others, but rows are moved to their places without them.
    """
    made = dict(made or {})
    usable = is_usable(df.withColumns(made), label)
    if made:
        df, usable = df.withColumns(made).withColumn("_usable", usable).select(*df.columns, "_usable"), F.col("_usable")
    placed = with_position(df, [session], order, out="seq", among={"pos": usable}, **options)
    return with_time_axis(placed.where(F.col("pos").isNotNull()).drop("_usable").withColumns(made), period_us, start)


def axes(df, sensor, keys=("session_id", "seq", "ts")):
    """Project one sensor's axes, with the key columns the table has."""
    present = [k for k in keys if k in df.columns]
    return df.select(*present, *axis_columns(sensor))


def features_only(df, label="label"):
    return df.drop(label)


def as_null(column):
    """NULL for NaN and both infinities."""
    c = F.col(column)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def fill_features(df, columns, value=0.0):
    """Infinities and NaN count as missing, and missing values become ``value``."""
    filled = {c: F.coalesce(as_null(c), F.lit(float(value))) for c in columns}
    return df.withColumns(filled)


def impute_mean(train, other, columns):
    """Fill both tables with the column means of ``train`` (fitting runs a job)."""
    imputer = Imputer(strategy="mean", inputCols=list(columns), outputCols=list(columns))
    model = imputer.fit(train)
    return model.transform(train), model.transform(other)


def drop_incomplete(df, columns, label="label"):
    """Drop rows with a missing feature or label; features and labels stay aligned."""
    return df.dropna("any", subset=[*columns, label])


def to_g(column):
    """Raw counts of the movement sensor in units of g."""
    return F.col(column) / F.lit(COUNTS_PER_G)


def session_starts(df, session="session_id", ts="ts"):
    """First timestamp per recording; aggregated before the shuffle."""
    return df.groupBy(session).agg(F.min(ts).alias("_start"))


def with_elapsed(df, session="session_id", ts="ts", out="elapsed"):
    """Seconds since the recording's first row."""
    joined = df.join(session_starts(df, session, ts), session)
    micros = F.timestamp_diff("MICROSECOND", F.col("_start"), F.col(ts))
    return joined.withColumn(out, micros / F.lit(1e6)).drop("_start")


def limit_duration(df, seconds, session="session_id", ts="ts"):
    """Keep the rows recorded in the first ``seconds`` of every recording."""
    timed = with_elapsed(df, session, ts, out="_elapsed")
    return timed.where(F.col("_elapsed") <= F.lit(float(seconds))).drop("_elapsed")


def class_counts(df, label="label"):
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
