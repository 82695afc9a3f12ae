"""Registration, tables and small helpers shared by the training-data operators."""

from pyspark.sql import functions as F

from kinetable.session import BATCH_BYTES, scratch_path, small_batches  # noqa: F401

QUERIES = {}
ORACLES = {}

#: Text bytes that one vectorised step holds; a longer single text is a step of its own.
STEP_BYTES = 500_000


def query(name, sql=None):
    """Register a function (spark, folder) -> DataFrame, and its SQL if it has one."""

    def add(func):
        QUERIES[name] = func
        if sql is not None:
            ORACLES[name] = sql
        return func

    return add


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def written(df, name, by=()):
    """Write ``df`` to the cluster's shared folder and read it back.

    Cuts the lineage with a copy that survives lost executors; the files go
    when the application's scratch folder is cleaned.  ``by`` names columns
    that become folders, so that a later filter on them reads only its own.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*([by] if isinstance(by, str) else by)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(column, n):
    """crc32 of a column's text modulo ``n``; null ids count as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def keep_columns(df, wanted):
    """Only the columns an operator works on, so that clashing names cannot meet its own."""
    return df.select(*[F.col(f"`{c}`") for c in wanted])
