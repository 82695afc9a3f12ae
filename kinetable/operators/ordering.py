"""Row positions, quantile groups and running totals without hot partitions.

A window partitioned by a recording would put a whole recording in one task.
The functions here number rows in two levels instead: rows are cut into slices
of the order column, numbered within their slice, and shifted by the number of
rows in earlier slices.  A recording that holds a third of all rows is spread
over as many tasks as it has slices; the per-slice counts are aggregated before
they are shuffled.
"""

from collections import Counter
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Window, functions as F

#: Slices of a table for each shuffle partition, and sampled rows for each slice.
SLICES_A_PARTITION = 4
SAMPLED_A_SLICE = 16
#: Sampled rows of a key up to which it stays whole: half of a shuffle partition.
SMALL_KEY = 2 * SAMPLED_A_SLICE


def sortable(df, column):
    """A text or number that sorts like the column."""
    kind, value = dict(df.dtypes)[column], F.col(column)
    if kind in ("string", "bigint", "int", "smallint", "tinyint"):
        return value if kind == "string" else value.cast("long")
    if kind == "timestamp_ntz":
        zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", zero, value)
    if kind == "timestamp":
        return F.unix_micros(value)
    if kind == "date":
        return F.unix_date(value).cast("long")
    return value.cast("double")


def slice_number(value, cuts):
    """How far ``value`` reaches in the sorted ``cuts``: 0 before the first, never decreasing.

    Two short searches, first among every n-th cut and then among the cuts
    after it, so a row costs about twice the root of their number.
    """
    if not cuts:
        return F.when(value.isNotNull(), F.lit(0))

    def reached(among):
        return F.size(F.filter(among, lambda cut: cut <= value))

    width = int(len(cuts) ** 0.5) + 1
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    group = reached(F.array(*[F.lit(g[0]) for g in groups]))
    inside = reached(F.get(F.array(*[F.array(*[F.lit(c) for c in g]) for g in groups]), group - 1))
    number = F.when(group == 0, F.lit(0)).otherwise(group * F.lit(width + 1) + inside)
    return F.when(value.isNotNull(), number)


def slice_cuts(df, keys, order):
    """Cuts between slices of about equal row counts along the first order column.

    The cuts are quantiles of a sample of the rows, those with the smallest
    digests of key and order: sixteen a slice, whatever the size of the table.
    The number of slices follows ``spark.sql.shuffle.partitions``, which is set
    to the size of cluster and data.
    Where no key has more of the sample than half a shuffle partition there are
    no cuts: keys are small enough to stay whole.  Otherwise a key with a third
    of the rows has a third of the sample and as large a share of the slices.
    Rows with one and the same order value stay together.  Runs one job over
    keys and order.
    """
    slices = SLICES_A_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = sortable(df, order[0])
    rows = df.select(value.alias("_v"), F.xxhash64(*keys).alias("_k"), F.xxhash64(*keys, *order).alias("_d")).where("_v is not null")
    sample = rows.orderBy("_d", "_v").limit(slices * SAMPLED_A_SLICE).collect()
    if max(Counter(r["_k"] for r in sample).values(), default=0) <= SMALL_KEY:
        return []
    found = sorted(r["_v"] for r in sample if r["_v"] == r["_v"])
    return sorted(set(found[SAMPLED_A_SLICE::SAMPLED_A_SLICE]))


def default_slice(df, keys, order):
    """Number of a row's slice, between the cuts of ``slice_cuts``."""
    return slice_number(sortable(df, order[0]), slice_cuts(df, keys, order))


def with_slice(df, order, cuts, out="_slice"):
    """Add the number of a row's slice between ``cuts``; numbers and times are looked up by bisection.

    As doubles large integers may tie, but never change places, which is all that slices need.
    """
    value = sortable(df, order[0])
    if not cuts or isinstance(cuts[0], str):
        return df.withColumn(out, slice_number(value, cuts))
    inner = sorted({float(c) for c in cuts} - {float("-inf"), float("inf")})
    found = Bucketizer(splits=[float("-inf"), *inner, float("inf")], inputCol="_v", outputCol="_found", handleInvalid="keep")
    known = found.transform(df.withColumn("_v", value.cast("double")))
    return known.withColumn(out, F.when(F.col("_v").isNotNull(), F.col("_found"))).drop("_v", "_found")


def with_position(df, keys, order, slice_by=None, out="pos", size_out=None, among=None, weight=None, cuts=None):
    """Dense position (from 0) of every row within ``keys`` along ``order``.

    ``slice_by`` must be a non-decreasing function of the order columns; by
    default there are slices between the cuts of ``slice_cuts``, and where it finds
    none the rows of a key stay together.  With ``size_out`` the number of rows of the key group is attached as well.
    ``among`` maps further output names to conditions: the position counted
    among the rows that fulfil the condition, NULL for the others, in the same
    pass.  Rows with a NULL key or order value are kept and get no position.
    With ``weight``, a column without missing values, a row stands for so many
    rows, and its position is that of the first of them.  ``cuts`` are those of
    ``slice_cuts``, where they are known.
    """
    keys, order, among = list(keys), list(order), dict(among or {})
    if slice_by is None:
        cuts = slice_cuts(df, keys, order) if cuts is None else cuts
        if not cuts:
            return with_whole_position(df, keys, order, out, size_out, among, weight)
        sliced = with_slice(df, order, cuts)
    else:
        sliced = df.withColumn("_slice", slice_by)
    counted = {"": F.lit(1), **{f"_{n}": F.when(c, 1) for n, c in among.items()}}
    sums = {n: F.count(c) for n, c in counted.items()}
    if weight:
        sums[""] = F.sum(weight)
    counts = sliced.groupBy(*keys, "_slice").agg(*[s.alias(f"_rows{n}") for n, s in sums.items()])
    along = Window.partitionBy(*keys).orderBy("_slice")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    shifts = [
        F.coalesce(F.sum(F.when(F.col("_slice").isNotNull(), F.col(f"_rows{n}"))).over(earlier), F.lit(0)).alias(f"_before{n}")
        for n in counted
    ]
    if size_out:
        shifts.append(F.sum("_rows").over(Window.partitionBy(*keys)).alias(size_out))
    shifts = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_s"),
        *shifts,
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    ranks = {"_rank": F.sum(weight).over(so_far) - F.col(weight) + 1 if weight else F.row_number().over(within)}
    for n, condition in among.items():
        ranks[f"_rank_{n}"] = F.when(condition, F.count(F.when(condition, 1)).over(so_far))
    ranked = sliced.withColumns(ranks)
    # Plain equality keeps the partitioning of the ranked side: no second shuffle.
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    joined = ranked.join(shifts, same, "left")
    made = {out: "", **{n: f"_{n}" for n in among}}
    kept = [F.col(c) for c in df.columns if c not in made and c != size_out]
    positions = [
        (F.col(f"_before{n}") + F.col(f"_rank{n}") - 1).cast("long").alias(name)
        for name, n in made.items()
    ]
    extra = [F.col(size_out).cast("long").alias(size_out)] if size_out else []
    return joined.select(*kept, *positions, *extra)


def with_whole_position(df, keys, order, out="pos", size_out=None, among=None, weight=None):
    """``with_position`` where every key is small: one window over the key.

    The rows are shuffled by their key alone, so what groups them by it and more needs no second shuffle.
    """
    alike = Window.partitionBy(*keys)
    so_far = alike.orderBy(F.col(order[0]).asc_nulls_last(), *order[1:]).rowsBetween(Window.unboundedPreceding, 0)
    known = reduce(and_, [F.col(c).isNotNull() for c in [*keys, order[0]]])
    counted = {out: F.sum(weight).over(so_far) - F.col(weight) + 1 if weight else F.count(F.lit(1)).over(so_far)}
    for n, condition in (among or {}).items():
        counted[n] = F.when(condition, F.count(F.when(condition, 1)).over(so_far))
    kept = [F.col(c) for c in df.columns if c not in counted and c != size_out]
    positions = [F.when(known, n - 1).cast("long").alias(name) for name, n in counted.items()]
    size = (F.sum(weight) if weight else F.count(F.lit(1))).over(alike)
    extra = [F.when(reduce(and_, [F.col(k).isNotNull() for k in keys]), size).cast("long").alias(size_out)] if size_out else []
    return df.select(*kept, *positions, *extra)


def with_neighbour(df, keys, order, value, out, slice_by, ahead=False):
    """The value of the previous (or next) row of the key group, or NULL.

    Works like ``lag`` and ``lead`` but in slices: inside a slice by a window,
    and for the row at the slice's edge from the nearest filled slice beside it.
    ``slice_by`` must be a non-decreasing function of the order columns.
    """
    keys, order = list(keys), list(order)
    sliced = df.withColumn("_slice", slice_by)
    boxed = F.struct(F.col(value).alias("v"))
    place = F.struct(*order)
    edge = (F.min_by if ahead else F.max_by)(boxed, place).alias("_edge")
    edges = sliced.groupBy(*keys, "_slice").agg(edge)
    along = Window.partitionBy(*keys).orderBy("_slice")
    within = Window.partitionBy(*keys, "_slice").orderBy(*order)
    move = F.lead if ahead else F.lag
    beside = edges.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_s"),
        move("_edge").over(along).alias("_beside"),
    )
    near = sliced.withColumn("_near", move(boxed).over(within))
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    joined = near.join(beside, same, "left")
    kept = [F.col(c) for c in df.columns if c != out]
    return joined.select(*kept, F.coalesce("_near", "_beside")["v"].alias(out))


def time_slice(ts, seconds=86400):
    """Slices of a time order: whole steps since 1970."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("SECOND", zero, F.col(ts)) / F.lit(seconds))


def with_hash_order(df, key, seed, out="_h"):
    """A reproducible random order: the digest of the row key and a seed."""
    return df.withColumn(out, F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))


def quantile_splits(df, column, parts):
    """Cut points that divide the values of ``column`` into about equal parts.

    Runs one job; the result is at most ``parts - 1`` numbers whatever the size
    of the table.
    """
    steps = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(column, steps, 10 * parts).alias("q")).first()
    return sorted(set(row["q"] or []))


def running_totals(df, order, values, descending=False, parts=None):
    """Inclusive running sums of ``values`` along a unique double ``order`` column.

    The table is cut into quantile ranges; sums run within each range and the
    totals of the ranges before it are added.  No task sees more than one range.
    Columns ``cum_<value>`` and ``all_<value>`` (the grand total) are added.
    """
    spark = df.sparkSession
    parts = parts or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)
    cuts = [float("-inf")] + quantile_splits(df, order, parts) + [float("inf")]
    ranged = Bucketizer(splits=cuts, inputCol=order, outputCol="_range").transform(df)
    key, walk = F.col("_range"), F.col(order)
    if descending:
        key, walk = key.desc(), walk.desc()
    totals = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    # At most ``parts`` rows, fixed by the cut points and not by the data.
    ahead = Window.partitionBy(F.lit(0)).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    offsets = totals.select(
        "_range",
        *[F.coalesce(F.sum(f"_t_{v}").over(ahead), F.lit(0)).alias(f"_o_{v}") for v in values],
        *[F.sum(f"_t_{v}").over(everything).alias(f"all_{v}") for v in values],
    )
    inside = Window.partitionBy("_range").orderBy(walk).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.select("*", *[F.sum(v).over(inside).alias(f"_w_{v}") for v in values])
    joined = summed.join(F.broadcast(offsets), "_range")
    return joined.select(
        *df.columns,
        *[(F.col(f"_w_{v}") + F.col(f"_o_{v}")).alias(f"cum_{v}") for v in values],
        *[f"all_{v}" for v in values],
    )
