"""Analytics of captured device advertisements."""

from pyspark.sql import functions as F

from kinetable.functions import bytes as b
from kinetable.functions import text as tx
from kinetable.operators.ordering import with_neighbour
from kinetable.operators.tumble import tumble

# ---------------------------------------------------------------- fixed values
ADDRESS_TYPES = {1: "public", 2: "random"}
NOT_CONNECTABLE_BIT = 4
FIELD_NAMES = {
    0x01: "Flags",
    0x02: "Incomplete 16b Services",
    0x03: "Complete 16b Services",
    0x04: "Incomplete 32b Services",
    0x05: "Complete 32b Services",
    0x06: "Incomplete 128b Services",
    0x07: "Complete 128b Services",
    0x08: "Short Local Name",
    0x09: "Complete Local Name",
    0x0A: "Tx Power",
    0x14: "16b Service Solicitation",
    0x15: "128b Service Solicitation",
    0x16: "16b Service Data",
    0x17: "Public Target Address",
    0x18: "Random Target Address",
    0x19: "Appearance",
    0x1A: "Advertising Interval",
    0x1F: "32b Service Solicitation",
    0x20: "32b Service Data",
    0x21: "128b Service Data",
    0xFF: "Manufacturer",
}
NAME_FIELDS = (0x08, 0x09)
UUID_FIELDS = {2: (0x02, 0x03), 4: (0x04, 0x05), 16: (0x06, 0x07)}
# ------------------------------------------------------------ end fixed values

SEQ_SLICE = 1 << 20

FIELDS_SQL = """
aggregate(
  sequence(1, greatest(length({d}), 1)),
  named_struct('p', 1, 'a', cast(array() as array<struct<type:int,value:binary>>)),
  (s, i) -> if(
    length({d}) - s.p >= 1,
    named_struct(
      'p', s.p + cast(conv(hex(substring({d}, s.p, 1)), 16, 10) as int) + 1,
      'a', array_append(s.a, named_struct(
        'type', cast(conv(hex(substring({d}, s.p + 1, 1)), 16, 10) as int),
        'value', substring({d}, s.p + 2,
          greatest(cast(conv(hex(substring({d}, s.p, 1)), 16, 10) as int) - 1, 0))))),
    s),
  s -> s.a)
"""


def parse_fields(data="data"):
    """Length-type-value fields of an advert as an array of (type, value).

    Parsing stops when fewer than two bytes are left; a field longer than the
    rest keeps what is there; a length of zero moves on by one byte.
    """
    return F.expr(FIELDS_SQL.format(d=f"`{data}`"))


def explode_fields(adverts, data="data", keep=("seq", "addr")):
    """One row per field of every advert, numbered in order of appearance."""
    fields = adverts.select(*keep, F.posexplode(parse_fields(data)).alias("n", "f"))
    return fields.select(*keep, "n", F.col("f.type").alias("type"), F.col("f.value").alias("value"))


def field_name(kind):
    """Description of a field type; unknown types are shown in hex."""
    table = F.create_map(*[F.lit(x) for pair in FIELD_NAMES.items() for x in pair])
    shown = F.concat(F.lit("0x"), F.lower(F.hex(kind)))
    return F.coalesce(F.try_element_at(table, kind.cast("int")), shown)


def uuid_list(value, width):
    """Canonical UUIDs of a packed little-endian list; a short tail is dropped."""
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(F.length(value) - width, F.lit(0)), F.lit(width)),
        lambda s: s + width <= F.length(value),
    )

    def one(start):
        piece = F.call_function("substring", value, start + 1, F.lit(width))
        return tx.uuid_from_text(b.reversed_hex(piece, width))

    return F.transform(starts, one)


def field_text(kind, value):
    """Readable value: name text, UUIDs with commas, otherwise hex."""
    shown = F.when(kind.isin(*NAME_FIELDS), tx.name_text(value))
    for width, kinds in UUID_FIELDS.items():
        shown = shown.when(kind.isin(*kinds), F.array_join(uuid_list(value, width), ","))
    return shown.otherwise(F.lower(F.hex(value)))


def latest_fields(fields, addr="addr", kind="type", value="value", order=("seq", "n")):
    """Last value of every field of every device."""
    return fields.groupBy(addr, kind).agg(F.max_by(value, F.struct(*order)).alias(value))


def device_profiles(fields, addr="addr", kind="type", value="value", order=("seq", "n")):
    """All fields of a device as one map; a device has at most 256 field types."""
    last = latest_fields(fields, addr, kind, value, order)
    entries = F.collect_list(F.struct(kind, value))
    return last.groupBy(addr).agg(F.map_from_entries(entries).alias("fields"))


def changed_fields(fields, addr="addr", kind="type", value="value", order=("seq", "n")):
    """Mark fields that are new for their device or have another value than before."""
    slice_by = F.floor(F.col(order[0]) / F.lit(SEQ_SLICE))
    seen = with_neighbour(
        fields.withColumn("_box", F.struct(F.col(value).alias("v"))),
        [addr, kind], list(order), "_box", "_before", slice_by,
    )
    fresh = F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(value))
    return seen.withColumn("changed", fresh).drop("_box", "_before")


def advert_status(adverts, fields, addr="addr", seq="seq", **names):
    """Every advert as ``new`` (first of its device), ``update`` or ``old``."""
    marked = changed_fields(fields, addr, order=(seq, "n") if "n" in fields.columns else (seq,), **names)
    news = marked.groupBy(seq).agg(F.max("changed").alias("_news"))
    firsts = adverts.groupBy(addr).agg(F.min(seq).alias("_first"))
    joined = adverts.join(news, seq, "left").join(firsts, addr)
    status = (
        F.when(F.col(seq) == F.col("_first"), "new")
        .when(F.coalesce("_news", F.lit(False)), "update")
        .otherwise("old")
    )
    return joined.withColumn("status", status).select(*adverts.columns, "status")


def with_signal(adverts, rssi="rssi", flag="flag", kind="addr_type"):
    """Signal strength in dBm, connectable flag and address type name."""
    types = F.create_map(*[F.lit(x) for pair in ADDRESS_TYPES.items() for x in pair])
    return adverts.withColumns(
        {
            "dbm": -F.col(rssi),
            "connectable": F.col(flag).bitwiseAND(F.lit(NOT_CONNECTABLE_BIT)) == 0,
            "address": F.try_element_at(types, F.col(kind).cast("int")),
        }
    )


def report(adverts, only_new=False, include_old=False, sensitivity=-128, connectable_only=False):
    """The adverts a scan prints, by status, signal strength and connectability."""
    wanted = ["new"] + ([] if only_new else ["update"]) + (["old"] if include_old else [])
    shown = adverts.where(F.col("status").isin(*wanted) & (F.col("dbm") >= sensitivity))
    return shown.where("connectable") if connectable_only else shown


def address_conflicts(adverts, addr="addr", kind="addr_type"):
    """Devices whose address type changed during the scan."""
    grouped = adverts.groupBy(addr).agg(F.min(kind).alias("first_type"), F.max(kind).alias("last_type"))
    return grouped.where(F.col("first_type") != F.col("last_type"))


def scan_windows(adverts, seconds=10, addr="addr", ts="ts"):
    """Adverts per device and scan of ``seconds``."""
    binned = tumble(adverts, seconds, ts=ts)
    return binned.groupBy(addr, "win_start").agg(F.count(F.lit(1)).alias("n"))


def uuid_names(catalogue):
    """Names by UUID from the assigned numbers; the last kind in order wins."""
    rows = catalogue.where(F.col("number").isNotNull())
    return rows.groupBy(tx.uuid_from_int(F.col("number")).alias("uuid")).agg(
        F.max_by("name", "kind").alias("uuid_name")
    )


def with_uuid_name(df, names, uuid="uuid"):
    """Common name of a UUID, or its short form if it has none."""
    joined = df.join(names.withColumnRenamed("uuid", "_uuid"), F.col(uuid) == F.col("_uuid"), "left")
    return joined.withColumn(
        "uuid_name", F.coalesce("uuid_name", tx.short_uuid(F.col(uuid)))
    ).drop("_uuid")
