"""Sample files, payload tables and captured adverts; explicit schemas only."""

from pyspark.sql import functions as F, types as T

from kinetable.schema import PHONE_SCHEMA, SENSORS, axis_columns, sample_schema

LAYOUTS = ("LRC", "LR", "L")


def read_samples(spark, path, layout="LRC", schema=None):
    """Headerless sample files: position, axes and label, one file per recording.

    ``path`` may be a file, a folder, a list or a glob; the file's name without
    its extension becomes ``session_id``.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    rows = spark.read.schema(schema or sample_schema(layout)).csv(path)
    return rows.withColumn("session_id", file_stem(F.input_file_name()))


def read_phone_samples(spark, path):
    """Phone recordings: ten columns in the file, five of them read."""
    return read_samples(spark, path, "L", PHONE_SCHEMA).select("session_id", "index", "x", "y", "z", "label")


def file_stem(name):
    return F.regexp_extract(name, r"([^/]+?)(?:\.[^./]*)?$", 1)


PAYLOAD_SCHEMA = T.StructType(
    [
        T.StructField("device", T.StringType()),
        T.StructField("generation", T.StringType()),
        T.StructField("characteristic", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("data", T.BinaryType()),
    ]
)

ADVERT_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("addr", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("addr_type", T.IntegerType()),
        T.StructField("rssi", T.IntegerType()),
        T.StructField("flag", T.IntegerType()),
        T.StructField("data", T.BinaryType()),
    ]
)


def read_payloads(spark, path):
    """Captured characteristic values."""
    return spark.read.schema(PAYLOAD_SCHEMA).parquet(path)


def read_adverts(spark, path):
    """Captured advertisements."""
    return spark.read.schema(ADVERT_SCHEMA).parquet(path)


def write_samples(df, path, layout=SENSORS, parts=("label", "person"), mode="errorifexists"):
    """Aligned labelled samples as headerless CSV, one folder per activity and person.

    The label is both a folder key and the last column of the file.
    """
    columns = ["seq", *axis_columns(layout), "label"]
    keyed = df.select(
        *[F.col(c) for c in columns[:-1]],
        F.col("label").alias("_label"),
        *[F.col(p).alias(p) for p in parts],
    )
    keyed.write.mode(mode).partitionBy(*parts).option("quoteAll", False).csv(path)
