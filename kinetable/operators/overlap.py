"""Features of overlapping row-count windows.

A frame is the current row and the ``w - 1`` rows before it; only every
``step``-th frame is kept.  Instead of sliding a window function over sorted
rows and throwing most results away, each row is sent to the few kept frames
that contain it and the frames are hash-aggregated, with partial aggregates
before the shuffle.  Frames that lie close are instead formed in blocks: their
partial aggregates would be larger than the rows, so the rows are shuffled, each
once and those at a block's edge twice, and sent to their frames after that.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kinetable.functions import stats
from kinetable.operators.ordering import with_position
from kinetable.schema import AXES, SENSORS, axis_columns

#: Frames of a block, and the largest step between frames that are formed in blocks.
FRAMES_A_BLOCK = 64
BLOCKED_STEP = 16

FFT_BINS = {"zero": 0, "positive": 1, "negative": 2}


def expand_frames(df, w, step, start, pos="pos", block_keys=None):
    """One row per (row, kept frame that contains it).

    Kept frames end at positions ``start, start + step, ...``.  Adds ``win_end``,
    ``n_frame`` (rows in the frame, fewer than ``w`` at the start of a session)
    and ``in_frame`` (position of the row inside the frame).  With ``block_keys`` the
    result is partitioned by them and ``_block``, so that grouping by both and the frame needs no shuffle.
    """
    w, step, start = as_column(w), as_column(step), as_column(start)
    r = F.col(pos)
    first = F.greatest(F.lit(0), F.ceil((r - start) / step.cast("double"))).cast("long")
    last = F.floor((r + w - F.lit(1) - start) / step.cast("double")).cast("long")
    ends = df.withColumns({"_f": first, "_l": last}).where(F.col("_f") <= F.col("_l"))
    if block_keys is not None:
        low, high = (F.floor(F.col(c) / F.lit(FRAMES_A_BLOCK)) for c in ("_f", "_l"))
        ends = ends.withColumn("_block", F.explode(F.sequence(low, high))).repartition(*block_keys, "_block")
        edge = F.col("_block") * F.lit(FRAMES_A_BLOCK)
        ends = ends.withColumns({"_f": F.greatest("_f", edge), "_l": F.least("_l", edge + F.lit(FRAMES_A_BLOCK - 1))})
    ends = ends.withColumn("_i", F.explode(F.sequence("_f", "_l"))).drop("_f", "_l")
    ends = ends.withColumn("win_end", F.col("_i") * step + start).drop("_i")
    begin = F.greatest(F.col("win_end") - w + F.lit(1), F.lit(0))
    return ends.withColumns(
        {
            "n_frame": F.col("win_end") - begin + F.lit(1),
            "in_frame": r - begin,
        }
    )


def as_column(value):
    return F.lit(int(value)) if isinstance(value, (int, float)) else value


def fft_magnitude(column, k):
    """Magnitude of Fourier bin ``k`` of a frame, as sums over its rows."""
    x = F.col(column)
    if k == 0:
        return F.abs(F.sum(x))
    # F.sum of the same expression is computed once however often it is used.
    re = F.sum(x * F.col(f"_cos{k}"))
    im = F.sum(x * F.col(f"_sin{k}"))
    return F.sqrt(re * re + im * im)


def with_phases(df, bins):
    """Cosine and sine of every row's phase in its frame, per Fourier bin."""
    turn = F.col("in_frame") / F.col("n_frame")
    waves = {}
    for k in bins:
        if k:
            angle = F.lit(2.0 * math.pi * k) * turn
            waves[f"_cos{k}"] = F.cos(angle)
            waves[f"_sin{k}"] = F.sin(angle)
    return df.withColumns(waves)


def lower_suffix(_, sensor):
    return sensor.lower()


def frame_features(
    df,
    w,
    step,
    start,
    keys=("session_id",),
    pos="pos",
    layout=SENSORS,
    f_list=("mean", "std", "var", "rms"),
    magnitude=True,
    fft=(),
    correlations="pairs",
    label="label",
    label_rule="majority",
    min_rows=None,
    fill=None,
    classes=None,
):
    """Features of every kept frame.

    ``label_rule``: ``majority`` of the frame, or ``point`` (label of its last
    row).  ``correlations``: ``pairs`` (xy, xz, yz), ``self`` (a column with
    itself over the last ``w / 2`` rows: 1 or missing, as the original scripts
    compute it) or None.  Statistics of frames shorter than ``min_rows`` are
    missing; ``fill`` replaces missing features by a number.
    """
    stats.check_statistics(f_list)
    keys = list(keys)
    sized = isinstance(w, (int, float))
    half = int(w / 2) if sized else None
    min_rows = half if sized and min_rows is None else int(min_rows or 0)
    columns, custom = stats.axis_statistics(layout, f_list, lower_suffix)
    blocked = isinstance(step, (int, float)) and (step <= BLOCKED_STEP or bool(custom))
    by = [*keys, "_block", "win_end"] if blocked else [*keys, "win_end"]
    frames = expand_frames(df, w, step, start, pos, keys if blocked else None)
    bins = [FFT_BINS[name] for name in fft]
    if fft:
        frames = with_phases(frames, bins)
    for name, k in zip(fft, bins):
        for sensor in layout:
            for axis in AXES:
                alias = f"{axis}{sensor}_fft_{sensor.lower()}_{name}"
                columns.append(fft_magnitude(f"{axis}{sensor}", k).alias(alias))
    if magnitude:
        columns.append(stats.mean_magnitude(axis_columns(layout)).alias("mean_mag"))
    if correlations == "pairs":
        columns += stats.pair_correlations(layout)
    elif correlations == "self":
        recent = F.col(pos) > F.col("win_end") - F.lit(half)
        enough = F.count(F.when(recent, 1)) == F.lit(half)
        for c in axis_columns(layout):
            spread = F.var_samp(F.when(recent, F.col(c)))
            columns.append(F.when(enough & (spread > 0), F.lit(1.0)).alias(c))
    names = feature_columns(layout, f_list, magnitude, fft, correlations)
    helpers = [F.max(pos).alias("_last"), F.count(F.lit(1)).alias("n_rows")]
    if label and label in df.columns:
        if label_rule == "majority":
            columns.append(stats.majority(F.col(label), classes).alias(label))
        else:
            at_end = F.when(F.col(pos) == F.col("win_end"), F.col(label))
            columns.append(F.max(at_end).alias(label))
    grouped = frames.groupBy(*by).agg(*columns, *helpers)
    # A frame exists only if the row at its end exists.
    finished = grouped.where(F.col("_last") == F.col("win_end")).withColumns(custom)
    if sized and start + 1 < min_rows:
        # The first frames are too short; self-correlation has its own minimum.
        own = axis_columns(layout) if correlations == "self" else []
        seen = F.col("n_rows") >= F.lit(min_rows)
        finished = finished.withColumns({c: F.when(seen, F.col(c)) for c in names if c not in own})
    if fill is not None:
        finished = finished.withColumns({c: F.coalesce(F.col(c), F.lit(float(fill))) for c in names})
    tail = [label] if label and label in df.columns else []
    return finished.select(*keys, "win_end", "n_rows", *names, *tail)


def feature_columns(layout, f_list, magnitude=True, fft=(), correlations="pairs"):
    """Names of the feature columns, a function of the parameters only."""
    names = []
    for f in f_list:
        called = f if isinstance(f, str) else f.__name__
        names += [f"{c}_{called}_{c[1].lower()}" for c in axis_columns(layout)]
    for name in fft:
        names += [f"{c}_fft_{c[1].lower()}_{name}" for c in axis_columns(layout)]
    if magnitude:
        names.append("mean_mag")
    if correlations == "pairs":
        names += [f"{a}{b}{s}" for s in layout for a, b in stats.AXIS_PAIRS]
    elif correlations == "self":
        names += axis_columns(layout)
    return names


def placed_rows(df, session, order, pos):
    """Rows with their position among the rows left after cleaning.

    ``prepare_recordings`` has counted it already; other tables, whose ``order``
    has gaps, are counted here.
    """
    return df if pos in df.columns else with_position(df, [session], [order], out=pos)


def overlap_features(
    df, wsize_sec, overlap=0.5, rate=10, session="session_id", order="seq", pos="pos", **options
):
    """Training features: frames of ``rate * wsize_sec`` rows, kept every
    ``overlap`` share of a frame, over the rows left after cleaning."""
    w = int(rate * wsize_sec)
    step = int(w * overlap)
    placed = placed_rows(df, session, order, pos)
    return frame_features(placed, w, step, step, keys=(session,), pos=pos, **options)


#: Statistics that the frames of a message compute from its array.
MESSAGE_STATISTICS = ("mean", "std", "var", "rms")


def scoring_features(
    df, wsize_sec=2, overlap=0.5, rate=10, step=None, keys=("session_id", "batch"), pos="pos", **options
):
    """Scoring features of live batches: every frame from position ``w * overlap``.

    The step is ``int(wsize_sec * overlap)`` rows as in the live server; pass
    ``step`` for another one.  A batch is one message, so positions inside it
    are given by the message itself, and a message's frames are computed from
    one array of its rows: no row is sent to several frames.  Other
    statistics, labels and correlations take the general way of ``frame_features``.
    """
    w = int(rate * wsize_sec)
    start = int(w * overlap)
    step = step or max(1, int(wsize_sec * overlap))
    settings = {
        "magnitude": False,
        "fft": ("zero", "positive", "negative"),
        "label": None,
        "fill": 0.0,
        **options,
    }
    plain = {"layout", "f_list", "fft", "fill", "magnitude", "label", "correlations"}
    by_array = set(settings) <= plain and not settings["magnitude"] and settings["label"] is None
    by_array = by_array and settings.get("correlations", "pairs") is None and set(settings.get("f_list", ())) <= set(MESSAGE_STATISTICS)
    if not by_array:
        return frame_features(df, w, step, start, keys=keys, pos=pos, **settings)
    settings = {k: v for k, v in settings.items() if k not in ("magnitude", "label", "correlations")}
    return message_frames(df, w, step, start, keys, pos, **settings)


def message_frames(df, w, step, start, keys, pos="pos", layout=SENSORS, f_list=MESSAGE_STATISTICS, fft=(), fill=None):
    """``frame_features`` of messages, from one array a message.

    A message is one row of the result's input: its rows are collected once
    and every kept frame is a slice of them.  Missing and NaN values are left out.
    """
    keys, axes = list(keys), axis_columns(layout)
    names = feature_columns(layout, f_list, False, fft, None)
    bins = [FFT_BINS[name] for name in fft]
    least = int(w / 2) if start + 1 < int(w / 2) else 0
    kinds = dict(df.dtypes)
    rows = df.select(*keys, F.struct(F.col(pos).cast("int").alias("pos"), *[F.col(c).cast("double").alias(c) for c in axes]).alias("_row"))
    messages = rows.where("_row.pos is not null").groupBy(*keys).agg(F.collect_list("_row").alias("_rows"))

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("_rows"))
            values = lists.flatten()
            owner = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            at = values.field(0).to_numpy()
            length = int(at.max(initial=-1)) + 1
            x = np.full((batch.num_rows, length, len(axes)), np.nan)
            there = np.zeros((batch.num_rows, length), dtype=bool)
            there[owner, at] = True
            for i in range(len(axes)):
                x[owner, at, i] = values.field(1 + i).to_numpy(zero_copy_only=False)
            for end in range(start, length, step):
                own = np.flatnonzero(there[:, end])
                if not len(own):
                    continue
                begin = max(0, end - w + 1)
                columns = frame_columns(x[own, begin : end + 1], f_list, bins)
                n_rows = there[own, begin : end + 1].sum(1)
                if least:
                    columns = np.where((n_rows >= least)[:, None], columns, np.nan)
                known = np.isfinite(columns)
                shown = [pa.array(c, mask=~k) for c, k in zip(columns.T, known.T)]
                fixed = [batch.column(batch.schema.get_field_index(k)).take(pa.array(own)) for k in keys]
                ends = [pa.array(np.full(len(own), end, dtype=np.int64)), pa.array(n_rows.astype(np.int64))]
                yield pa.record_batch([*fixed, *ends, *shown], names=[*keys, "win_end", "n_rows", *names])

    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "win_end long", "n_rows long", *[f"`{n}` double" for n in names]])
    found = messages.mapInArrow(run, schema)
    return found if fill is None else found.withColumns({n: F.coalesce(F.col(n), F.lit(float(fill))) for n in names})


def frame_columns(x, f_list, bins):
    """Features of frames ``x[frame, row, axis]``, missing values NaN, in the order of the feature columns."""
    known = ~np.isnan(x)
    n = known.sum(1).astype(float)
    filled = np.where(known, x, 0.0)
    few = np.where(n > 0, n, np.nan)
    mean = filled.sum(1) / few
    apart = np.where(known, x - mean[:, None, :], 0.0)
    variance = (apart * apart).sum(1) / np.where(n > 1, n - 1, np.nan)
    made = {"mean": mean, "std": np.sqrt(variance), "var": variance, "rms": np.sqrt((filled * filled).sum(1) / few)}
    columns = [made[f] for f in f_list]
    turn = 2.0 * np.pi * np.arange(x.shape[1]) / x.shape[1]
    for k in bins:
        if k == 0:
            found = np.abs(filled.sum(1))
        else:
            found = np.hypot(np.einsum("fra,r->fa", filled, np.cos(k * turn)), np.einsum("fra,r->fa", filled, np.sin(k * turn)))
        columns.append(np.where(n > 0, found, np.nan))
    return np.concatenate(columns, axis=1)


def overlap_sweep(
    df, sizes_sec, overlap=0.5, rate=52, session="session_id", order="seq", pos="pos", **options
):
    """Overlapping features for several window sizes in one job, keyed by ``wsize``."""
    placed = placed_rows(df, session, order, pos)
    choices = []
    for seconds in sizes_sec:
        w = int(rate * seconds)
        step = int(w * overlap)
        if 2 * (step + 1) < w:
            raise ValueError("the sweep needs an overlap of one half or more")
        choices.append(
            F.struct(
                F.lit(float(seconds)).alias("wsize"),
                F.lit(w).cast("long").alias("_rows"),
                F.lit(step).cast("long").alias("_step"),
            )
        )
    sized = placed.select("*", F.inline(F.array(*choices)))
    step = F.col("_step")
    return frame_features(sized, F.col("_rows"), step, step, keys=(session, "wsize"), pos=pos, **options)
