"""Names, types and fixed values shared by all operators."""

from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
SENSORS = ("L", "R", "C")
AXES = ("x", "y", "z")
SENSOR_NAMES = {"L": "Left", "R": "Right", "C": "Chest"}

# Sample periods in microseconds: 52 Hz recordings, and the live server's clock.
PERIOD_US = 19230
LIVE_PERIOD_US = 9090
SESSION_OFFSET_HOURS = 3
NULL_LABEL = 0
BATCH_ROWS = 20

# Raw counts per g of the movement sensor.
COUNTS_PER_G = 4096.0

# Activity names of the chest data set, and of the project's own recordings.
CHEST_ACTIVITIES = {
    1: "Working at Computer",
    2: "Standing Up, Walking and Going up\\down stairs",
    3: "Standing",
    4: "Walking",
    5: "Going Up\\Down Stairs",
    6: "Walking and Talking with Someone",
    7: "Talking while Standing",
}
RECORDED_ACTIVITIES = {0: "Null", 1: "Still", 2: "Running"}
STILL_POSES = {1: "still_hands_back", 2: "still_hands_side"}
# ------------------------------------------------------------ end fixed values


def axis_columns(layout="LRC"):
    """Axis column names of a layout, sensor by sensor: xL, yL, zL, xR, ..."""
    return [f"{axis}{sensor}" for sensor in layout for axis in AXES]


def sample_schema(layout="LRC"):
    """Row type of a headerless sample file: position, axes, label."""
    return T.StructType(
        [T.StructField("index", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in axis_columns(layout)]
        + [T.StructField("label", T.IntegerType())]
    )


PHONE_SCHEMA = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("arrival_time", T.LongType()),
        T.StructField("creation_time", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("z", T.DoubleType()),
        T.StructField("user", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("device", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)

#: JSON message types, by layout of the sender.
BATCH_TYPE = "array<struct<index:int,x:double,y:double,z:double,sensor:string>>"
SINGLE_BATCH_TYPE = "array<struct<index:int,x:double,y:double,z:double>>"
PAIR_BATCH_TYPE = (
    "array<struct<xL:double,yL:double,zL:double,xR:double,yR:double,zR:double>>"
)
