"""Cleaning, tumbling and overlapping features on the derived recordings."""

import re

import pandas as pd
from pyspark.sql import functions as F

from kinetable.operators import clean as cl
from kinetable.operators import overlap, tumble
from kinetable.operators.evaluate import ordered_split
from kinetable.operators.ordering import with_position
from kinetable.plans import tables
from registry.common import AXIS, IMU, query, rounded, sql_corr, sql_round, sql_statistic

SWEEP = (2, 3, 5, 7, 10, 13, 15, 20)

# ------------------------------------------------------------------ cleaning


@query(
    "time_axis",
    f"with {IMU} select session_id, seq, ts from imu",
)
def time_axis(spark, folder):
    return tables.imu(spark, folder).select("session_id", "seq", "ts")


@query(
    "session_offset",
    f"""with {IMU}, nth as (
      select s_suppkey as session_id, dense_rank() over (order by s_suppkey) - 1 as k
      from supplier where s_suppkey in (select session_id from imu))
    select session_id, seq, ts + to_hours(cast(3 * k as integer)) as ts
    from imu join nth using (session_id)""",
)
def session_offset(spark, folder):
    return cl.with_session_offset(tables.imu(spark, folder)).select("session_id", "seq", "ts")


@query(
    "clean_samples",
    f"""with {IMU} select session_id, seq, cast(label as bigint) as label,
      round("xL", 12) as "xL", round("zC", 12) as "zC" from clean""",
)
def clean_samples(spark, folder):
    kept = cl.clean(tables.imu(spark, folder))
    return rounded(kept.select("session_id", "seq", "label", "xL", "zC"), 12)


@query(
    "clean_missing",
    """select o_orderkey as session_id, cast(label as bigint) as label, x from (
      select o_orderkey, case when o_orderkey % 7 = 0 then null else o_totalprice / 4096 end as x,
        case o_orderstatus when 'F' then 1 when 'O' then 2 else 0 end as label from orders) t
    where x is not null and label <> 0""",
)
def clean_missing(spark, folder):
    orders = tables.table(spark, folder, "orders")
    status = F.col("o_orderstatus")
    raw = orders.select(
        F.col("o_orderkey").alias("session_id"),
        F.when(status == "F", 1).when(status == "O", 2).otherwise(0).cast("long").alias("label"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(float("nan"))).otherwise(cl.to_g("o_totalprice")).alias("x"),
    )
    return cl.clean(raw)


@query(
    "sensor_axes",
    f'with {IMU} select session_id, seq, ts, "xR", "yR", "zR" from imu',
)
def sensor_axes(spark, folder):
    return cl.axes(tables.imu(spark, folder), "R")


@query(
    "features_only",
    f'with {IMU} select session_id, seq, "xL", "yL", "zL" from clean',
)
def features_only(spark, folder):
    part = tables.clean_imu(spark, folder).select("session_id", "seq", "xL", "yL", "zL", "label")
    return cl.features_only(part)


@query(
    "counts_to_g",
    """select l_orderkey, l_linenumber as line, l_partkey,
      cast(floor(l_extendedprice) as bigint) / 4096e0 as g from lineitem""",
)
def counts_to_g(spark, folder):
    line = tables.table(spark, folder, "lineitem")
    raw = line.withColumn("raw", F.floor("l_extendedprice"))
    return raw.select("l_orderkey", F.col("l_linenumber").alias("line"), "l_partkey", cl.to_g("raw").alias("g"))


@query(
    "elapsed_seconds",
    """select event_id, user_id, date_diff('microsecond', min(ts) over (partition by user_id), ts) / 1e6
      as elapsed from events""",
)
def elapsed_seconds(spark, folder):
    events = tables.table(spark, folder, "events")
    return cl.with_elapsed(events, "user_id").select("event_id", "user_id", "elapsed")


@query(
    "limit_duration",
    """select event_id, user_id from (
      select *, min(ts) over (partition by user_id) as t0 from events) t
      where ts <= t0 + interval 7 day""",
)
def limit_duration(spark, folder):
    events = tables.table(spark, folder, "events")
    return cl.limit_duration(events, 7 * 86400, "user_id").select("event_id", "user_id")


@query(
    "class_counts",
    f"with {IMU} select cast(label as bigint) as label, count(*) as n from clean group by label",
)
def class_counts(spark, folder):
    return rounded(cl.class_counts(tables.clean_imu(spark, folder)))


@query(
    "prepared_recordings",
    f"""with {IMU} select session_id, seq, ts, row_number() over (partition by session_id order by seq) - 1 as pos
    from clean""",
)
def prepared_recordings(spark, folder):
    return tables.clean_imu(spark, folder).select("session_id", "seq", "ts", "pos")


@query(
    "dense_position",
    f"""with {IMU} select session_id, seq,
      row_number() over (partition by session_id order by seq) - 1 as pos from clean""",
)
def dense_position(spark, folder):
    rows = cl.clean(tables.imu(spark, folder))
    return with_position(rows, ["session_id"], ["seq"], slice_by=F.floor(F.col("seq") / 100)).select(
        "session_id", "seq", "pos"
    )


# ------------------------------------------------------------ tumbling windows


def sql_bins(size, source="clean"):
    return (
        f"time_bucket(interval '{size} second', ts, timestamp '2024-01-01 00:00:00') as win_start"
    )


def sql_tumble(columns, size, source="clean", having=""):
    listed = ",\n ".join(columns)
    return f"""with {IMU}, binned as (select *, {sql_bins(size)} from {source})
    select session_id, win_start, {listed} from binned group by session_id, win_start {having}"""


SIMPLE = [
    sql_round(sql_statistic(f, c), f"{c}_{f}_{c[1].lower() if i == 0 else c[1]}")
    for i, f in enumerate(["mean", "std", "var", "rms"])
    for c in AXIS
]
MAGNITUDE = "avg(sqrt(" + " + ".join(f'"{c}" * "{c}"' for c in AXIS) + "))"
MAGNITUDE_LABEL = MAGNITUDE[:-2] + " + label * label))"
PAIRS = [
    sql_round(sql_corr(f"{p[0]}{s}", f"{p[1]}{s}"), f"{p}{s}")
    for s in "LRC"
    for p in ("xy", "xz", "yz")
]


@query("tumble_mean_std_var_rms", sql_tumble(SIMPLE, 1))
def tumble_mean_std_var_rms(spark, folder):
    full = tumble.tumble_features(tables.clean_imu(spark, folder), "1s", keep_incomplete=True)
    return rounded(full.drop("mean_mag", "label", *[f"{p}{s}" for s in "LRC" for p in ("xy", "xz", "yz")]))


@query("tumble_mean_mag", sql_tumble([sql_round(MAGNITUDE, "mean_mag")], 2))
def tumble_mean_mag(spark, folder):
    full = tumble.tumble_features(tables.clean_imu(spark, folder), "2s", f_list=(), keep_incomplete=True)
    return rounded(full.select("session_id", "win_start", "mean_mag"))


@query(
    "tumble_parity",
    sql_tumble(
        [
            sql_round('avg("xR")', "xC_mean_c"),
            sql_round('avg("zR")', "zC_mean_c"),
            sql_round(MAGNITUDE_LABEL, "mean_mag"),
        ],
        2,
    ),
)
def tumble_parity(spark, folder):
    full = tumble.tumble_features(tables.clean_imu(spark, folder), "2s", keep_incomplete=True, parity=True)
    return rounded(full.select("session_id", "win_start", "xC_mean_c", "zC_mean_c", "mean_mag"))


@query("tumble_pair_corr", sql_tumble(PAIRS, 2))
def tumble_pair_corr(spark, folder):
    full = tumble.tumble_features(tables.clean_imu(spark, folder), "2s", f_list=(), keep_incomplete=True)
    return rounded(full.drop("mean_mag", "label"))


MODE = f"""modes as (
  select session_id, win_start, label from (
    select session_id, win_start, label, row_number() over (
      partition by session_id, win_start order by count(*) desc, label) as k
    from binned group by session_id, win_start, label) t where k = 1)"""


@query(
    "tumble_mode_label",
    f"""with {IMU}, binned as (select *, {sql_bins(7)} from clean), {MODE}
    select session_id, win_start, cast(label as bigint) as label from modes""",
)
def tumble_mode_label(spark, folder):
    full = tumble.tumble_features(tables.clean_imu(spark, folder), "7s", f_list=(), keep_incomplete=True)
    return rounded(full.select("session_id", "win_start", "label"))


FULL_NAMES = (
    [f"{c}_{f}_{c[1].lower() if i == 0 else c[1]}" for i, f in enumerate(["mean", "std", "var", "rms"]) for c in AXIS]
    + ["mean_mag"]
    + [f"{p}{s}" for s in "LRC" for p in ("xy", "xz", "yz")]
)


def sql_tumble_full(size):
    body = ",\n ".join(SIMPLE + [sql_round(MAGNITUDE, "mean_mag")] + PAIRS)
    whole = " and ".join(f'"{c}" is not null' for c in FULL_NAMES)
    return f"""with {IMU}, binned as (select *, {sql_bins(size)} from clean), {MODE},
    feats as (select session_id, win_start, {body} from binned group by session_id, win_start)
    select feats.*, cast(label as bigint) as label from feats join modes using (session_id, win_start)
    where {whole}"""


@query("tumble_features_full", sql_tumble_full(2))
def tumble_features_full(spark, folder):
    return rounded(tumble.tumble_features(tables.clean_imu(spark, folder), "2s", classes=tables.CLASSES))


@query(
    "feature_cells",
    f"""with {IMU}, binned as (select *, {sql_bins(3)} from clean),
    feats as (select session_id, win_start, {", ".join(PAIRS)}, {sql_round(MAGNITUDE, "mean_mag")}
      from binned group by session_id, win_start)
    select count(*) * 13 as cells from feats where {" and ".join(f'"{p}{s}" is not null' for s in "LRC" for p in ("xy", "xz", "yz"))}""",
)
def feature_cells(spark, folder):
    feats = tumble.tumble_features(tables.clean_imu(spark, folder), "3s", f_list=())
    return tumble.feature_cells(feats)


def sql_sweep_part(size):
    return f"""select session_id, cast({size} as double) as wsize,
      time_bucket(interval '{size} second', ts, timestamp '2024-01-01 00:00:00') as win_start,
      {sql_round('avg("xL")', "xL_mean_l")}, {sql_round('stddev_samp("yC")', "yC_std_C")},
      {sql_round(sql_corr("xR", "zR"), "xzR")} from clean group by all"""


@query("window_size_sweep", f"with {IMU} " + " union all ".join(sql_sweep_part(s) for s in SWEEP))
def window_size_sweep(spark, folder):
    full = tumble.tumble_sweep(tables.clean_imu(spark, folder), SWEEP, f_list=("mean", "std"), keep_incomplete=True)
    return rounded(full.select("session_id", "wsize", "win_start", "xL_mean_l", "yC_std_C", "xzR"))


@query(
    "custom_statistic",
    f"""with {IMU}, binned as (select *, {sql_bins(2)} from clean)
    select session_id, win_start, {sql_round('max("xL") - min("xL")', "xL_spread_L")},
      {sql_round('avg("xL")', "xL_mean_l")} from binned group by session_id, win_start""",
)
def custom_statistic(spark, folder):
    def spread(values):
        return values.max() - values.min()

    rows = tables.clean_imu(spark, folder)
    full = tumble.tumble_features(rows, "2s", f_list=("mean", spread), layout="L", keep_incomplete=True)
    return rounded(full.select("session_id", "win_start", "xL_mean_l", "xL_spread_L"))


@query(
    "window_apply",
    f"""with {IMU}, binned as (select *, {sql_bins(7)} from clean)
    select session_id, win_start, arg_min("xL", seq) as first, arg_max("xL", seq) as last, count(*) as n
    from binned group by session_id, win_start""",
)
def window_apply(spark, folder):
    def ends(rows):
        x = rows["xL"]
        return pd.DataFrame({"first": [x.iloc[0]], "last": [x.iloc[-1]], "n": [len(x)]})

    rows = tables.clean_imu(spark, folder).select("session_id", "ts", "xL")
    return tumble.window_apply(rows, "7s", ends, "first double, last double, n long")


@query(
    "imputed_features",
    f"""with {IMU}, binned as (select *, {sql_bins(1)} from clean),
    sided as (select session_id, win_start, {sql_corr("xL", "yL")} as c, avg("zR") as m
      from binned group by session_id, win_start),
    filled as (select session_id, win_start, m,
      coalesce(c, (select avg(c) from sided where session_id % 4 <> 0)) as c from sided where session_id % 4 = 0)
    select session_id, win_start, round(c, 6) + 0.0 as "xyL", round(m, 6) + 0.0 as "zR_mean_r" from filled""",
)
def imputed_features(spark, folder):
    full = tumble.tumble_features(tables.clean_imu(spark, folder), "1s", f_list=("mean",), keep_incomplete=True)
    part = full.select("session_id", "win_start", "xyL", "zR_mean_r")
    train, test = part.where("session_id % 4 <> 0"), part.where("session_id % 4 = 0")
    return rounded(cl.impute_mean(train, test, ["xyL"])[1])


# --------------------------------------------------------- overlapping windows


def sql_frames(columns, w=20, start=10, step=10, where="true", source="clean"):
    """Sliding SQL frames over every row, then the kept ones."""
    listed = ",\n ".join(columns)
    return f"""with {IMU}, placed as (
      select *, row_number() over (partition by session_id order by seq) - 1 as pos from {source}),
    slid as (select session_id, pos as win_end, label, {listed} from placed
      window f as (partition by session_id order by pos rows between {w - 1} preceding and current row))
    select * exclude (label) from slid where win_end >= {start} and (win_end - {start}) % {step} = 0 and {where}"""


AGGREGATE = re.compile(r"\b(covar_samp|stddev_samp|var_samp|avg|sum|count)\(")


def over(expr):
    """Put every aggregate of an SQL expression over the sliding frame ``f``."""
    out, at = "", 0
    while found := AGGREGATE.search(expr, at):
        end, depth = found.end(), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(expr[end], 0)
            end += 1
        out += expr[at:end] + " over f"
        at = end
    return out + expr[at:]


OVERLAP = [
    sql_round(over(sql_statistic(f, c)), f"{c}_{f}_{c[1].lower()}")
    for f in ("mean", "std", "var", "rms")
    for c in AXIS
]


@query("overlap_features", sql_frames(OVERLAP + [sql_round(over(MAGNITUDE), "mean_mag")]))
def overlap_features(spark, folder):
    full = overlap.overlap_features(tables.clean_imu(spark, folder), 2, correlations=None, label=None)
    return rounded(full.drop("n_rows"))


OVERLAP_PAIRS = [
    sql_round(over(sql_corr(f"{p[0]}{s}", f"{p[1]}{s}")), f"{p}{s}") for s in "LRC" for p in ("xy", "xz", "yz")
]


@query("overlap_pair_corr", sql_frames(OVERLAP_PAIRS, w=104, start=52, step=52))
def overlap_pair_corr(spark, folder):
    full = overlap.overlap_features(
        tables.clean_imu(spark, folder), 2, rate=52, f_list=(), magnitude=False, label=None
    )
    return rounded(full.drop("n_rows"))


SELF_COLUMNS = [
    f'case when count(*) over h = 10 and var_samp("{c}") over h > 0 then 1e0 end as "{c}"' for c in AXIS
]


@query(
    "overlap_self_corr",
    sql_frames(SELF_COLUMNS).replace(
        "window f as", "window h as (partition by session_id order by pos rows between 9 preceding and current row), f as"
    ),
)
def overlap_self_corr(spark, folder):
    full = overlap.overlap_features(
        tables.clean_imu(spark, folder), 2, f_list=(), magnitude=False, label=None, correlations="self"
    )
    return rounded(full.drop("n_rows"))


FFT_NAMES = {"zero": 0, "positive": 1, "negative": 2}


def sql_fft(source_where="true", start=10, step=10):
    """Join form: every kept frame with its rows, phases from the frame's start."""
    columns = ",\n ".join(
        sql_round(
            f'abs(sum("{c}"))'
            if k == 0
            else f'sqrt(pow(sum("{c}" * cos(2 * pi() * {k} * j / n)), 2) + pow(sum("{c}" * sin(2 * pi() * {k} * j / n)), 2))',
            f"{c}_fft_{c[1].lower()}_{name}",
        )
        for name, k in FFT_NAMES.items()
        for c in AXIS
    )
    return f"""with {IMU}, placed as (
      select *, row_number() over (partition by session_id order by seq) - 1 as pos from clean),
    ends as (select session_id, pos as win_end, greatest(pos - 19, 0) as first,
      pos - greatest(pos - 19, 0) + 1 as n from placed where pos >= {start} and (pos - {start}) % {step} = 0),
    framed as (select e.session_id, win_end, cast(n as double) as n, pos - first as j, {", ".join(f'"{c}"' for c in AXIS)}
      from ends e join placed p on p.session_id = e.session_id and p.pos between e.first and e.win_end)
    select session_id, win_end, {columns} from framed group by session_id, win_end"""


@query("overlap_fft", sql_fft())
def overlap_fft(spark, folder):
    full = overlap.overlap_features(
        tables.clean_imu(spark, folder), 2, f_list=(), magnitude=False, label=None, correlations=None,
        fft=("zero", "positive", "negative"),
    )
    return rounded(full.drop("n_rows"))


@query(
    "overlap_mode_label",
    f"""with {IMU}, placed as (
      select session_id, label, row_number() over (partition by session_id order by seq) - 1 as pos from clean),
    ends as (select session_id, pos as win_end from placed where pos > 0 and pos % 10 = 0),
    framed as (select e.session_id, win_end, label, count(*) as k from ends e join placed p
      on p.session_id = e.session_id and p.pos between e.win_end - 19 and e.win_end group by all)
    select session_id, win_end, cast(label as bigint) as label from (
      select *, row_number() over (partition by session_id, win_end order by k desc, label) as r from framed) t
    where r = 1""",
)
def overlap_mode_label(spark, folder):
    full = overlap.overlap_features(
        tables.clean_imu(spark, folder), 2, f_list=(), magnitude=False, correlations=None
    )
    return rounded(full.drop("n_rows"))


@query(
    "overlap_point_label",
    f"""with {IMU}, placed as (
      select session_id, label, row_number() over (partition by session_id order by seq) - 1 as pos from clean)
    select session_id, pos as win_end, cast(label as bigint) as label from placed where pos > 0 and pos % 10 = 0""",
)
def overlap_point_label(spark, folder):
    full = overlap.overlap_features(
        tables.clean_imu(spark, folder), 2, f_list=(), magnitude=False, correlations=None, label_rule="point"
    )
    return rounded(full.drop("n_rows"))


@query(
    "filled_features",
    sql_frames(
        [
            sql_round(f"coalesce({over(sql_corr(p[0] + s, p[1] + s))}, 0)", f"{p}{s}")
            for s in "LRC"
            for p in ("xy", "xz", "yz")
        ],
        w=4, start=1, step=1,
    ),
)
def filled_features(spark, folder):
    rows = tables.clean_imu(spark, folder)
    full = overlap.frame_features(
        rows, 4, 1, 1, f_list=(), magnitude=False, label=None, min_rows=2, fill=0.0
    )
    return rounded(full.drop("n_rows"))


@query(
    "overlap_custom",
    sql_frames([sql_round('max("xL") over f - min("xL") over f', "xL_spread_l")]),
)
def overlap_custom(spark, folder):
    def spread(values):
        return values.max() - values.min()

    full = overlap.overlap_features(
        tables.clean_imu(spark, folder), 2, f_list=(spread,), layout="L", magnitude=False, correlations=None, label=None
    )
    return rounded(full.select("session_id", "win_end", "xL_spread_l"))


@query(
    "split_side_features",
    f"""with {IMU}, n as (select *, row_number() over (partition by session_id order by seq) - 1 as r,
      count(*) over (partition by session_id) as n from clean),
    sides as (select *, case when r < n - ceil(n * 0.25) then 'train' else 'test' end as side from n),
    placed as (select *, row_number() over (partition by session_id, side order by seq) - 1 as pos from sides)
    select session_id, side, win_end, "xL_mean_l", label from (
      select session_id, side, pos as win_end, cast(label as bigint) as label, {sql_round('avg("xL") over f', "xL_mean_l")}
      from placed window f as (partition by session_id, side order by pos rows between 19 preceding and current row)) t
    where win_end > 0 and win_end % 10 = 0""",
)
def split_side_features(spark, folder):
    # Every slice has at most so many rows of a recording; none need be sampled for them.
    slices = F.floor(F.col("seq") / 4096)
    sided = ordered_split(tables.clean_imu(spark, folder), slice_by=slices)
    sided = with_position(sided, ["session_id", "side"], ["seq"], slice_by=slices)
    full = overlap.frame_features(
        sided, 20, 10, 10, keys=("session_id", "side"), f_list=("mean",), magnitude=False, correlations=None,
        label_rule="point",
    )
    return rounded(full.select("session_id", "side", "win_end", "xL_mean_l", "label"))


def sql_overlap_sweep(seconds):
    w = 10 * seconds
    step = w // 2
    return f"""select session_id, cast({seconds} as double) as wsize, win_end, "xL_mean_l", "yC_var_c" from (
      select session_id, pos as win_end,
        {sql_round('avg("xL") over f', "xL_mean_l")}, {sql_round('var_samp("yC") over f', "yC_var_c")}
      from placed window f as (partition by session_id order by pos rows between {w - 1} preceding and current row)) t
    where win_end > 0 and win_end % {step} = 0"""


@query(
    "overlap_size_sweep",
    f"""with {IMU}, placed as (
      select *, row_number() over (partition by session_id order by seq) - 1 as pos from clean) """
    + " union all ".join(sql_overlap_sweep(s) for s in SWEEP),
)
def overlap_size_sweep(spark, folder):
    full = overlap.overlap_sweep(
        tables.clean_imu(spark, folder), SWEEP, rate=10, f_list=("mean", "var"), magnitude=False,
        correlations=None, label=None,
    )
    return rounded(full.select("session_id", "wsize", "win_end", "xL_mean_l", "yC_var_c"))


def unrounded(expression, name):
    return f'{expression} as "{name}"'


def sql_scoring(shown=sql_round):
    """Statistics of the scoring frames."""
    return [
        shown(f"coalesce({over(sql_statistic(f, c))}, 0)", f"{c}_{f}_{c[1].lower()}")
        for f in ("mean", "std", "var", "rms")
        for c in AXIS
    ]


def sql_scoring_fft(shown=sql_round):
    """Fourier columns of the scoring frames; frames of a batch of 20 rows all start with its first row."""
    return [
        shown(
            f'abs(sum(p."{c}"))'
            if k == 0
            else f'sqrt(pow(sum(p."{c}" * cos(2 * pi() * {k} * p.pos / (e.pos + 1))), 2) + pow(sum(p."{c}" * sin(2 * pi() * {k} * p.pos / (e.pos + 1))), 2))',
            f"{c}_fft_{c[1].lower()}_{name}",
        )
        for name, k in FFT_NAMES.items()
        for c in AXIS
    ]


@query(
    "scoring_features",
    f"""with {IMU}, placed as (select *, seq // 20 as batch, seq % 20 as pos from imu),
    slid as (select session_id, batch, pos as win_end, {", ".join(sql_scoring())} from placed
      window f as (partition by session_id, batch order by pos rows between 19 preceding and current row)),
    waves as (select e.session_id, e.batch, e.pos as win_end, {", ".join(sql_scoring_fft())}
      from placed e join placed p on e.session_id = p.session_id and e.batch = p.batch and p.pos <= e.pos
      where e.pos >= 10 group by e.session_id, e.batch, e.pos)
    select * from slid join waves using (session_id, batch, win_end)""",
)
def scoring_features(spark, folder):
    rows = tables.imu(spark, folder).withColumns(
        {"batch": F.floor(F.col("seq") / 20), "pos": F.col("seq") % 20}
    )
    full = overlap.scoring_features(rows, correlations=None)
    return rounded(full.drop("n_rows"))
