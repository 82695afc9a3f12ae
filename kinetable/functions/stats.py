"""Window statistics as aggregate columns, and the statistic registry.

Every builder takes value columns and returns one aggregate column, so any
number of statistics of any number of axes is one ``agg`` over one grouping.
"""

from pyspark.sql import functions as F

from kinetable.schema import AXES

AXIS_PAIRS = (("x", "y"), ("x", "z"), ("y", "z"))


# Statistics of one column share aggregates (sum, count, central moment); Spark
# computes equal aggregates of a grouping once.  This keeps the row buffer of a
# full feature set within the field limit of whole-stage code generation, and the
# results in methods small enough for the JVM to compile.


def mean(c):
    return F.try_divide(F.sum(c), F.count(c))


def std(c):
    return F.sqrt(F.var_samp(c))


def rms(c):
    return F.sqrt(F.try_divide(F.sum(c * c), F.count(c)))


def safe_corr(a, b):
    """Pearson correlation; NULL for constant axes and for single rows.

    Spark's ``corr`` divides by zero on a constant column, which is an error
    in ANSI mode, hence the explicit quotient.
    """
    spread = F.sqrt(F.var_samp(a) * F.var_samp(b))
    return F.covar_samp(a, b) / F.nullif(spread, F.lit(0.0))


def magnitude(columns):
    """Euclidean norm of one row over the given columns."""
    total = None
    for c in columns:
        square = F.col(c) * F.col(c)
        total = square if total is None else total + square
    return F.sqrt(total)


def mean_magnitude(columns):
    return F.avg(magnitude(columns))


def majority(label, classes=None):
    """Most frequent value of a group, the smallest one on ties.

    With the list of all ``classes`` the counts are plain aggregates, which is
    faster; a label outside the list is then an error.
    """
    if classes is None:
        return F.mode(label, True)
    known = F.coalesce(label.isin(*classes), F.lit(True))
    checked = F.when(known, label).otherwise(
        F.raise_error(F.concat(F.lit("label outside the class list: "), label.cast("string"))).cast("int")
    )
    counts = [
        F.struct(F.count(F.when(checked == c, 1)).alias("n"), F.lit(-c).alias("c")) for c in classes
    ]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] > 0, -best["c"])


STATISTICS = {"mean": mean, "std": std, "var": F.var_samp, "rms": rms}


def register_statistic(name, builder):
    """Add a statistic: ``builder`` maps a value column to an aggregate column."""
    STATISTICS[name] = builder


def feature_name(axis, statistic, suffix):
    return f"{axis}_{statistic}_{suffix}"


def check_statistics(f_list):
    unknown = [f for f in f_list if isinstance(f, str) and f not in STATISTICS]
    if unknown:
        raise ValueError(f"unknown statistics {unknown}; have {sorted(STATISTICS)}")


def custom_statistic(func):
    """A Python function over one window's values, as a function of the arrays of ``window_values``.

    This is the slow path: windows travel to Python as arrays, many in an Arrow
    batch.  An array is one window of one session, whose size the sampling rate bounds.
    """
    import pandas as pd

    def evaluate(windows: pd.Series) -> pd.Series:
        return windows.map(lambda values: float(func(pd.Series(values)))).astype("float64")

    return F.pandas_udf(evaluate, "double")


def window_values(column):
    """All values of a window as an array, missing ones included."""
    return F.transform(F.collect_list(F.struct(column.alias("v"))), lambda row: row["v"])


def axis_statistics(layout, f_list, suffix_of, source_of=None):
    """Aggregate columns for every named statistic of every axis of a layout.

    ``suffix_of(position, sensor)`` gives the name's suffix; ``source_of`` may
    replace the column a statistic reads.  Python functions are aggregated as
    arrays; the second result maps their names to what remains to be done.
    """
    columns, custom = [], {}
    for position, f in enumerate(f_list):
        for sensor in layout:
            for axis in AXES:
                name = f"{axis}{sensor}"
                source = source_of(position, name) if source_of else name
                called = f if isinstance(f, str) else f.__name__
                alias = feature_name(name, called, suffix_of(position, sensor))
                if isinstance(f, str):
                    columns.append(STATISTICS[f](F.col(source)).alias(alias))
                else:
                    columns.append(window_values(F.col(source)).alias(alias))
                    custom[alias] = custom_statistic(f)(F.col(alias))
    return columns, custom


def pair_correlations(layout):
    """xy, xz and yz correlation of every sensor, named xyL, xzL, yzL, ..."""
    return [
        safe_corr(F.col(f"{a}{sensor}"), F.col(f"{b}{sensor}")).alias(f"{a}{b}{sensor}")
        for sensor in layout
        for a, b in AXIS_PAIRS
    ]
