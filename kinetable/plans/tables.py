"""Sample, batch, event and payload tables derived from the driver's tables.

Divisors are primes so that window means are not decimal numbers that end
exactly on a rounding boundary.
"""

from functools import reduce

from pyspark.sql import functions as F

from kinetable.operators.clean import prepare_recordings, with_time_axis
from kinetable.operators.ordering import with_position
from kinetable.schema import AXES, SENSORS


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


CLASSES = (1, 2, 3, 4)
ORDER = ["l_orderkey", "l_linenumber", "l_partkey"]
READINGS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line_samples(spark, folder):
    """The columns of ``lineitem`` that the samples are made of, one recording per supplier."""
    line = table(spark, folder, "lineitem")
    status = F.concat("l_returnflag", "l_linestatus")
    label = (
        F.when(F.col("l_returnflag") == "N", 0)
        .when(status == "AF", 1)
        .when(status == "AO", 2)
        .when(status == "RF", 3)
        .otherwise(4)
    )
    return line.select(F.col("l_suppkey").alias("session_id"), *ORDER, *READINGS, label.cast("int").alias("label"))


def sensor_readings():
    """The axes of the three sensors, by name, over the columns of ``line_samples``."""
    qty, price, disc, tax = (F.col(c) for c in READINGS)
    return {
        "xL": qty / 53e0,
        "yL": price / 104729e0,
        "zL": disc * 100e0 / 97e0,
        "xR": tax * 100e0 / 89e0,
        "yR": (F.col("l_partkey") % 97) / F.lit(97e0),
        "zR": (F.col("l_orderkey") % 89) / F.lit(89e0),
        "xC": qty * (1e0 - disc) / 53e0,
        "yC": price * (1e0 + tax) / 104729e0,
        "zC": F.col("l_linenumber") / F.lit(7e0),
    }


def raw_samples(spark, folder):
    """Three-sensor rows from ``lineitem``, one recording per supplier."""
    made = [value.alias(c) for c, value in sensor_readings().items()]
    return line_samples(spark, folder).select("session_id", *ORDER, *made, "label")


def imu(spark, folder):
    """All samples with position and time.

    The axes are made after the rows have been moved to their positions: the columns they are made of are fewer.
    """
    placed = with_position(line_samples(spark, folder), ["session_id"], ORDER, out="seq")
    made = [value.alias(c) for c, value in sensor_readings().items()]
    return with_time_axis(placed.select("session_id", *made, "label", "seq"))


def clean_imu(spark, folder):
    """The samples left after cleaning, with ``seq``, ``ts`` and ``pos``."""
    rows = prepare_recordings(line_samples(spark, folder), order=ORDER, made=sensor_readings())
    return rows.select("session_id", *sensor_readings(), "label", "seq", "pos", "ts")


def imu_long(spark, folder):
    """One row per session, position and sensor; each sensor misses some rows."""
    wide = imu(spark, folder).withColumn("nth", F.explode(F.array(*[F.lit(i) for i in range(len(SENSORS))])))

    def of_sensor(values):
        return reduce(lambda found, i: found.when(F.col("nth") == i, values[i]), range(1, len(SENSORS)), F.when(F.col("nth") == 0, values[0]))

    # Picked one by one: who asks for keys alone does not move the readings.
    rows = wide.select(
        "session_id", "seq", "ts", "label", of_sensor([F.lit(s) for s in SENSORS]).alias("sensor"),
        *[of_sensor([F.col(f"{a}{s}") for s in SENSORS]).alias(a) for a in AXES], "nth",
    )
    return rows.where((F.col("seq") + F.col("nth")) % 11 != 0).drop("nth")
