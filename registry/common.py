"""Registration of queries with their SQL twins, and shared SQL fragments."""

from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    """Register a function (spark, folder) -> DataFrame, and its SQL if it has one."""

    def add(func):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = func
        if sql is not None:
            ORACLES[name] = sql
        return func

    return add


def rounded(df, digits=6):
    """Round all double columns, so that the order of a sum does not matter.

    Spark's rounding never gives -0.0; the SQL twins add zero for that.  Wide
    tables are rounded as one array, which keeps the generated code small.
    """
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    wide = len(doubles) > 20
    source = df
    if wide:
        whole = F.transform(F.array(*doubles), lambda x: F.round(x, digits))
        source = df.withColumn("_rounded", whole)
    columns = []
    for c, kind in df.dtypes:
        if kind == "double":
            value = F.get("_rounded", F.lit(doubles.index(c))) if wide else F.round(F.col(c), digits)
        else:
            value = F.col(c).cast("long") if kind in ("int", "smallint", "tinyint") else F.col(c)
        columns.append(value.alias(c))
    return source.select(*columns)


# The recordings of kinetable.plans.tables.imu, written independently in SQL.
IMU = """
imu as materialized (
  select l_suppkey as session_id,
    row_number() over (partition by l_suppkey
                       order by l_orderkey, l_linenumber, l_partkey) - 1 as seq,
    timestamp '2024-01-01 00:00:00' + to_microseconds(19230 * (row_number() over (
      partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) - 1)) as ts,
    l_quantity / 53e0 as "xL", l_extendedprice / 104729e0 as "yL", l_discount * 100e0 / 97e0 as "zL",
    l_tax * 100e0 / 89e0 as "xR", (l_partkey % 97) / 97e0 as "yR", (l_orderkey % 89) / 89e0 as "zR",
    l_quantity * (1e0 - l_discount) / 53e0 as "xC",
    l_extendedprice * (1e0 + l_tax) / 104729e0 as "yC", l_linenumber / 7e0 as "zC",
    case when l_returnflag = 'N' then 0
         when l_returnflag = 'A' then case when l_linestatus = 'F' then 1 else 2 end
         when l_linestatus = 'F' then 3 else 4 end as label
  from lineitem
),
clean as (select * from imu where label <> 0)
"""

LONG = """
imu_long as materialized (
  select session_id, seq, ts, label, 'L' as sensor, "xL" as x, "yL" as y, "zL" as z
  from imu where (seq + 0) % 11 <> 0
  union all
  select session_id, seq, ts, label, 'R', "xR", "yR", "zR" from imu where (seq + 1) % 11 <> 0
  union all
  select session_id, seq, ts, label, 'C', "xC", "yC", "zC" from imu where (seq + 2) % 11 <> 0
)
"""

AXIS = [f"{a}{s}" for s in "LRC" for a in "xyz"]


def sql_statistic(f, column):
    """SQL text of one statistic of a column."""
    return {
        "mean": f'avg("{column}")',
        "std": f'stddev_samp("{column}")',
        "var": f'var_samp("{column}")',
        "rms": f'sqrt(avg("{column}" * "{column}"))',
    }[f]


def sql_corr(a, b):
    return (
        f'covar_samp("{a}", "{b}") / nullif(stddev_samp("{a}") * stddev_samp("{b}"), 0)'
    )


def sql_round(expr, alias, digits=6):
    return f'round({expr}, {digits}) + 0.0 as "{alias}"'
