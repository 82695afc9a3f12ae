"""Scalar functions, payload decoders and advert analytics."""

from pyspark.sql import functions as F

from kinetable.functions import bytes as b
from kinetable.functions import decoders as d
from kinetable.functions import text as tx
from kinetable.operators import adverts
from kinetable.plans import tables
from registry.common import query, rounded

# Integers of the payload fixtures: u16 in 0..65535, s16 in -32768..32767.
RAW_SQL = """
raw as (select l_orderkey as k, cast(l_linenumber as bigint) as line, l_partkey as part,
  cast(floor(l_extendedprice * 100) as bigint) % 65536 as u1,
  (l_orderkey * 7919 + l_partkey * 104729) % 65536 as u2,
  (l_partkey * 31337 + l_linenumber * 4099) % 65536 as u3,
  l_suppkey % 256 as b1, (l_orderkey + l_partkey) % 256 as b2, l_linenumber * 37 % 256 as b3,
  l_suppkey as device from lineitem)
"""


def raw(spark, folder):
    line = tables.table(spark, folder, "lineitem")
    key, part, nth = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
    return line.select(
        key.alias("k"), nth.cast("long").alias("line"), part.alias("part"),
        (F.floor(F.col("l_extendedprice") * 100) % 65536).alias("u1"),
        ((key * 7919 + part * 104729) % 65536).alias("u2"),
        ((part * 31337 + nth * 4099) % 65536).alias("u3"),
        (F.col("l_suppkey") % 256).alias("b1"),
        ((key + part) % 256).alias("b2"),
        (nth.cast("long") * 37 % 256).alias("b3"),
        F.col("l_suppkey").alias("device"),
    )


def s16(name):
    return f"({name} - case when {name} >= 32768 then 65536 else 0 end)"


def s8(name):
    return f"({name} - case when {name} >= 128 then 256 else 0 end)"


def packed(*parts):
    """Binary column of (column, width) parts."""
    return F.concat(*[b.to_bytes(F.col(c), w) for c, w in parts])


THREE = (("u1", 2), ("u2", 2), ("u3", 2))
KEYS = ("k", "line", "part")


def decoded(name, kind, parts, formulas, digits=None):
    """Register a decoder with the same formula on the source integers."""
    columns = ", ".join(
        (f"round({f}, {digits}) + 0.0" if digits else f) + f" as {n}" for n, f in formulas.items()
    )

    @query(name, f"with {RAW_SQL} select k, line, part, {columns} from raw")
    def run(spark, folder):
        made = raw(spark, folder).withColumn("data", packed(*parts))
        values = d.decode(made, kind).select(*KEYS, *formulas)
        return rounded(values, digits) if digits else values

    return run


decoded(
    "decode_movement", "movement", THREE * 3,
    {
        **{f"acc_{a}": f"{s16(u)} / 4096e0" for a, u in zip("xyz", ("u1", "u2", "u3"))},
        **{f"gyro_{a}": f"{s16(u)} * (500e0 / 65536e0)" for a, u in zip("xyz", ("u1", "u2", "u3"))},
        **{f"mag_{a}": f"{s16(u)} * (4912e0 / 32760e0)" for a, u in zip("xyz", ("u1", "u2", "u3"))},
    },
)
decoded(
    "decode_acceleration", "movement_acceleration", THREE * 3,
    {a: f"{s16(u)} * (8e0 / 32768e0)" for a, u in zip("xyz", ("u1", "u2", "u3"))},
)
decoded(
    "decode_gyro", "movement_gyro", THREE * 3,
    {a: f"{s16(u)} * (500e0 / 65536e0)" for a, u in zip("xyz", ("u1", "u2", "u3"))},
)
decoded(
    "decode_magnet", "movement_magnet", THREE * 3,
    {a: f"{s16(u)} * (4912e0 / 32760e0)" for a, u in zip("xyz", ("u1", "u2", "u3"))},
)
decoded(
    "decode_humidity_v1", "humidity_v1", THREE[:2],
    {
        "temperature": "-46.85e0 + 175.72e0 * (u1 / 65536e0)",
        "humidity": "-6e0 + 125e0 * ((u2 & 65532) / 65536e0)",
    },
)
decoded(
    "decode_humidity_hdc1000", "humidity_hdc1000", THREE[:2],
    {"temperature": "-40e0 + 165e0 * (u1 / 65536e0)", "humidity": "100e0 * (u2 / 65536e0)"},
)
decoded(
    "decode_humidity_signed", "humidity_signed", THREE[:2],
    {
        "temperature": f"({s16('u1')} / 65536e0) * 165e0 - 40e0",
        "humidity": f"({s16('u2')} / 65536e0) * 100e0",
    },
)
decoded(
    "decode_magnetometer_v1", "magnetometer_v1", THREE,
    {a: f"1000e0 * ({s16(u)} / 32768e0)" for a, u in zip("xyz", ("u1", "u2", "u3"))},
)
decoded(
    "decode_gyroscope_v1", "gyroscope_v1", THREE,
    {a: f"250e0 * ({s16(u)} / 32768e0)" for a, u in zip("xyz", ("u1", "u2", "u3"))},
)
decoded(
    "decode_infrared_tmp007", "infrared_tmp007", THREE[:2],
    {"ambient": f"({s16('u2')} >> 2) * 0.03125e0", "target": f"({s16('u1')} >> 2) * 0.03125e0"},
)
DIE = f"({s16('b2')} / 8e0 + 273.15e0)"
OFF = f"({DIE} - 298.15e0)"
VOLTS = f"(1.5625e-7 * {s16('u1')} - (-2.94e-5 + -5.7e-7 * {OFF} + 4.63e-9 * {OFF} * {OFF}))"
decoded(
    "decode_barometer_bmp280", "barometer_bmp280", (("u1", 2), ("b1", 1), ("u2", 2), ("b2", 1)),
    {"temperature": "(b1 * 65536 + u1) / 100e0", "pressure": "(b2 * 65536 + u2) / 100e0"},
)
decoded(
    "decode_light", "light", (("u1", 2),),
    {"lux": "0.01e0 * ((u1 & 4095) << (u1 >> 12))"},
)
decoded("decode_battery", "battery", (("b1", 1),), {"percent": "cast(b1 as double)"})
decoded(
    "decode_box_temperature", "box_temperature", (("b1", 1), ("b3", 1)),
    {"temperature": f"{s8('b1')} + b3 / 100e0"},
)
decoded(
    "decode_box_pressure", "box_pressure", (("u1", 2), ("u2", 2), ("b3", 1)),
    {"pressure": "(u1 + u2 * 65536) + b3 / 100e0"},
)
decoded("decode_box_humidity", "box_humidity", (("b2", 1),), {"humidity": f"cast({s8('b2')} as double)"})
decoded(
    "decode_box_gas", "box_gas", THREE[:2],
    {"eco2": "cast(u1 as double)", "tvoc": "cast(u2 as double)"},
)
decoded("decode_box_button", "box_button", (("b3", 1),), {"state": f"cast({s8('b3')} as double)"})
decoded(
    "decode_box_tap", "box_tap", (("b1", 1), ("b2", 1)),
    {"direction": "cast(b1 as double)", "count": f"cast({s8('b2')} as double)"},
)


@query(
    "decode_infrared_v1",
    f"""with {RAW_SQL}, warm as (select k, line, part, {s16('u1')} as v, ({s8('b2')} * 16) / 128e0 as ambient from raw),
    die as (select *, ambient + 273.15e0 as t, ambient + 273.15e0 - 298.15e0 as o from warm),
    seen as (select *, 1.5625e-7 * v - (-2.94e-5 + -5.7e-7 * o + 4.63e-9 * o * o) as w,
      6.4e-14 * (1e0 + 1.75e-3 * o + -1.678e-5 * o * o) as s from die)
    select k, line, part, ambient, round(pow(pow(t, 4e0) + (w + 13.4e0 * w * w) / s, 0.25e0) - 273.15e0, 6) + 0.0 as target
    from seen""",
)
def decode_infrared_v1(spark, folder):
    made = raw(spark, folder)
    cold = F.when(F.col("b2") >= 128, F.col("b2") - 256).otherwise(F.col("b2")) * 16
    data = F.concat(b.to_bytes(F.col("u1"), 2), b.to_bytes(cold, 2))
    values = d.decode(made.withColumn("data", data), "infrared_v1")
    return rounded(values.select(*KEYS, "ambient", "target"))


@query(
    "decode_accelerometer_v1",
    f"""with {RAW_SQL} select k, line, part, {', '.join(
        f"{s8(c)} / case when device % 2 = 0 then 64e0 else 16e0 end as {a}" for a, c in zip("xyz", ("b1", "b2", "b3")))}
    from raw""",
)
def decode_accelerometer_v1(spark, folder):
    made = raw(spark, folder).withColumns(
        {
            "data": packed(("b1", 1), ("b2", 1), ("b3", 1)),
            "firmware": F.when(F.col("device") % 2 == 0, "1.4 (Jul 2013)").otherwise("1.5 (Oct 2013)"),
        }
    )
    return d.decode(made, "accelerometer_v1", firmware=F.col("firmware")).select(*KEYS, "x", "y", "z")


# Calibration numbers of a device's first-generation barometer.
CALIBRATION_SQL = """
cal as (select s_suppkey as device, 40000 + s_suppkey % 1000 as c1, 30000 + s_suppkey % 999 as c2,
  45000 + s_suppkey % 998 as c3, 36000 + s_suppkey % 997 as c4, -1000 - s_suppkey % 996 as c5,
  700 + s_suppkey % 995 as c6, -4000 + s_suppkey % 994 as c7, 5000 + s_suppkey % 993 as c8 from supplier)
"""


def calibrations(spark, folder):
    key = F.col("s_suppkey")
    numbers = (
        40000 + key % 1000, 30000 + key % 999, 45000 + key % 998, 36000 + key % 997,
        -1000 - key % 996, 700 + key % 995, -4000 + key % 994, 5000 + key % 993,
    )
    return tables.table(spark, folder, "supplier").select(
        key.alias("device"), F.concat(*[b.to_bytes(n, 2) for n in numbers]).alias("calibration")
    )


@query(
    "decode_barometer_v1",
    f"""with {RAW_SQL}, {CALIBRATION_SQL},
    j as (select raw.k, line, part, {s16('u1')} as t, u2 as p, cal.* from raw join cal using (device))
    select k, line, part, device, round(c1 / 16777216e0 * t + c2 / 1024e0, 6) + 0.0 as temperature,
      round(((c3 + c4 / 131072e0 * t + c5 / 17179869184e0 * t * t) * p
        + (c6 * 16384e0 + c7 / 8e0 * t + c8 / 524288e0 * t * t)) / 1638400e0, 6) + 0.0 as pressure from j""",
)
def decode_barometer_v1(spark, folder):
    payloads = raw(spark, folder).withColumn("data", packed(*THREE[:2]))
    return rounded(
        d.decode_barometer(payloads, calibrations(spark, folder)).select(*KEYS, "device", "temperature", "pressure")
    )


@query(
    "unpack_integers",
    f"""with {RAW_SQL} select k, line, part, {s16('u1')} as i16, u2 as u16, {s8('b1')} as i8, b2 as u8,
      u3 + b3 * 65536 as u24, u1 + u2 * 65536 as u32, {s8('b1')} as hex8 from raw""",
)
def unpack_integers(spark, folder):
    made = raw(spark, folder).withColumn(
        "data", packed(("u1", 2), ("u2", 2), ("b1", 1), ("b2", 1), ("u3", 2), ("b3", 1))
    )
    data = F.col("_image")
    return made.withColumn("_image", b.image(F.col("data"))).select(
        *KEYS,
        b.sint16(data, 0).alias("i16"), b.uint16(data, 2).alias("u16"), b.sint8(data, 4).alias("i8"),
        b.uint8(data, 5).alias("u8"), b.uint24(data, 6).alias("u24"), b.uint32(data, 0).alias("u32"),
        b.signed_hex8(F.hex(F.substring("data", 5, 1))).alias("hex8"),
    )


@query(
    "device_generations",
    """select l_suppkey as device, case when max(case when l_partkey % 7 = 0 then 1 else 0 end) = 1 then 'CC2650' else 'v1' end
      as generation from lineitem group by l_suppkey""",
)
def device_generations(spark, folder):
    line = tables.table(spark, folder, "lineitem")
    services = line.select(
        F.col("l_suppkey").alias("device"),
        F.when(F.col("l_partkey") % 7 == 0, "AA70").otherwise(F.concat(F.lit("AA"), F.col("l_linenumber"), F.lit("0"))).alias("service"),
    )
    return d.device_generations(services)


MIX = ("aa01", "aa21", "aa71", "2a19", "beef", "aa81", "0201", "aa11", "aa41")


@query(
    "decode_mixed",
    f"""with {RAW_SQL}, {CALIBRATION_SQL}, mixed as (select *, case when device % 3 = 0 then 'v1' when device % 3 = 1 then 'CC2650' else 'box' end
      as generation, [{', '.join(f"'{m}'" for m in MIX)}][cast(k % 9 + 1 as integer)] as code from raw),
    kinds as (select *, case when code = '0201' and generation = 'box' then 'temperature' when code = '0201' then 'unknown'
        when code = 'aa01' then 'infrared' when code = 'aa21' then 'humidity' when code = 'aa71' then 'light'
        when code = '2a19' then 'battery' when code = 'aa81' then 'movement' when code = 'aa11' then 'accelerometer'
        when code = 'aa41' then 'barometer' else 'unknown' end as kind, {s16('u1')} as t from mixed)
    select k, line, part, kind, case
        when generation = 'CC2650' and kind = 'humidity' then 100e0 * (u2 / 65536e0)
        when generation = 'v1' and kind = 'accelerometer' then
          ((u1 & 255) - case when (u1 & 255) >= 128 then 256 else 0 end) / case when device % 2 = 0 then 64e0 else 16e0 end
        when generation = 'v1' and kind = 'barometer' then
          round(((c3 + c4 / 131072e0 * t + c5 / 17179869184e0 * t * t) * u2
            + (c6 * 16384e0 + c7 / 8e0 * t + c8 / 524288e0 * t * t)) / 1638400e0, 6) + 0.0
        when generation = 'CC2650' and kind = 'barometer' then (u1 + (u2 & 255) * 65536) / 100e0
        when generation = 'v1' and kind = 'humidity' then -6e0 + 125e0 * ((u2 & 65532) / 65536e0)
        when generation = 'CC2650' and kind = 'light' then 0.01e0 * ((u1 & 4095) << (u1 >> 12))
        when generation in ('CC2650', 'box') and kind = 'battery' then cast(u1 & 255 as double)
        when generation = 'box' and kind = 'temperature' then
          ((u1 & 255) - case when (u1 & 255) >= 128 then 256 else 0 end) + (u1 >> 8) / 100e0
        when generation = 'box' and kind = 'humidity' then
          cast((u1 & 255) - case when (u1 & 255) >= 128 then 256 else 0 end as double) end as reading,
      printf('%02x%02x%02x%02x', u1 & 255, u1 >> 8, u2 & 255, u2 >> 8) as raw from kinds left join cal using (device)""",
)
def decode_mixed(spark, folder):
    family = F.element_at(F.array(F.lit("v1"), F.lit("CC2650"), F.lit("box")), (F.col("device") % 3 + 1).cast("int"))
    code = F.element_at(F.array(*[F.lit(m) for m in MIX]), (F.col("k") % 9 + 1).cast("int"))
    made = raw(spark, folder).withColumns(
        {
            "generation": family, "characteristic": code, "data": packed(*THREE[:2]),
            "firmware": F.when(F.col("device") % 2 == 0, "1.4 (Jul 2013)").otherwise("1.5 (Oct 2013)"),
        }
    )
    made = made.join(calibrations(spark, folder), "device", "left")
    found = d.decode_all(made, firmware="firmware", calibration="calibration")
    value = F.coalesce(
        *[F.try_element_at(F.col("readings"), F.lit(n)) for n in ("lux", "humidity", "percent")],
        F.when(F.col("kind") == "temperature", F.try_element_at(F.col("readings"), F.lit("temperature"))),
        F.when(F.col("kind") == "accelerometer", F.try_element_at(F.col("readings"), F.lit("x"))),
        F.when(
            F.col("kind") == "barometer",
            F.when(F.col("generation") == "v1", F.round(F.try_element_at(F.col("readings"), F.lit("pressure")), 6) + 0.0)
            .otherwise(F.try_element_at(F.col("readings"), F.lit("temperature"))),
        ),
    )
    return found.select(*KEYS, "kind", value.alias("reading"), "raw")


# ------------------------------------------------------------- scalar functions


@query(
    "scalar_math",
    """select l_orderkey, l_linenumber as line, l_partkey, round(sqrt(l_quantity), 9) as root, l_quantity * l_quantity as square,
      abs(l_discount - 0.05) as off, round(pow(l_quantity, 0.25), 9) as fourth, pow(l_quantity, 4) as power4,
      1.5e0 + 2.5e-3 * l_quantity + -1.25e-5 * l_quantity * l_quantity as poly from lineitem""",
)
def scalar_math(spark, folder):
    q = F.col("l_quantity")
    return tables.table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line"), "l_partkey",
        F.round(F.sqrt(q), 9).alias("root"), (q * q).alias("square"), F.abs(F.col("l_discount") - 0.05).alias("off"),
        F.round(F.pow(q, F.lit(0.25)), 9).alias("fourth"), F.pow(q, F.lit(4.0)).alias("power4"),
        b.quadratic(1.5, 2.5e-3, -1.25e-5, q).alias("poly"),
    )


@query(
    "bit_operations",
    f"""with {RAW_SQL} select k, line, part, u1 & u2 as a, u1 | u2 as o, ~u1 as n, u1 << 3 as l, u1 >> 5 as r from raw""",
)
def bit_operations(spark, folder):
    u1, u2 = F.col("u1"), F.col("u2")
    return raw(spark, folder).select(
        *KEYS, u1.bitwiseAND(u2).alias("a"), u1.bitwiseOR(u2).alias("o"), F.bitwise_not(u1).alias("n"),
        F.shiftleft(u1, 3).alias("l"), F.shiftright(u1, 5).alias("r"),
    )


@query(
    "uuid_normalise",
    """with t as (select o_orderkey as k, case o_orderkey % 5
        when 0 then printf('%04X', o_custkey) when 1 then printf('%08X', o_orderkey * 7919)
        when 2 then upper(md5(cast(o_orderkey as varchar))) when 3 then 'not-a-uuid'
        else printf('F000%04X-0451-4000-B000-000000000000', o_custkey % 65536) end as raw from orders),
    s as (select k, raw, replace(raw, '-', '') as x from t),
    f as (select k, raw, lower(case when length(x) <= 8 then lpad(x, 8, '0') || '00001000800000805F9B34FB' else x end) as y from s),
    u as (select k, raw, case when regexp_full_match(y, '[0-9a-f]{32}') then
      y[1:8] || '-' || y[9:12] || '-' || y[13:16] || '-' || y[17:20] || '-' || y[21:32] end as uuid from f)
    select k, raw, uuid, case when uuid like '%-0000-1000-8000-00805f9b34fb' then
      case when uuid like '0000%' then uuid[5:8] else uuid[1:8] end else uuid end as short from u""",
)
def uuid_normalise(spark, folder):
    orders = tables.table(spark, folder, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = (
        F.when(key % 5 == 0, F.format_string("%04X", cust))
        .when(key % 5 == 1, F.format_string("%08X", key * 7919))
        .when(key % 5 == 2, F.upper(F.md5(key.cast("string"))))
        .when(key % 5 == 3, "not-a-uuid")
        .otherwise(F.format_string("F000%04X-0451-4000-B000-000000000000", cust % 65536))
    )
    parsed = orders.select(key.alias("k"), text.alias("raw")).withColumn("uuid", tx.uuid_from_text(F.col("raw")))
    return parsed.withColumn("short", tx.short_uuid(F.col("uuid")))


@query(
    "uuid_bytes",
    """select o_orderkey as k, printf('0000%04x-0000-1000-8000-00805f9b34fb', o_custkey % 65536) as uuid,
      printf('%02x:%02x:%02x:00:01:ff', o_custkey & 255, (o_custkey >> 8) & 255, o_orderkey & 255) as mac, true as valid
    from orders""",
)
def uuid_bytes(spark, folder):
    orders = tables.table(spark, folder, "orders")
    packed16 = b.to_bytes(F.col("o_custkey") % 65536, 2)
    address = F.concat(b.to_bytes(F.col("o_custkey"), 2), b.to_bytes(F.col("o_orderkey"), 1), F.unhex(F.lit("0001FF")))
    made = orders.select(
        F.col("o_orderkey").alias("k"),
        tx.uuid_from_text(b.reversed_hex(packed16, 2)).alias("uuid"),
        tx.mac_text(address).alias("mac"),
    )
    return made.withColumn("valid", tx.is_mac(F.col("mac")))


NAMES_SQL = " || ".join(f"case when m & {bit} <> 0 then '{name} ' else '' end" for bit, name in tx.PROPERTY_NAMES)


@query("property_names", f"with t as (select o_orderkey as k, o_orderkey % 256 as m from orders) select k, {NAMES_SQL} as names from t")
def property_names(spark, folder):
    orders = tables.table(spark, folder, "orders")
    return orders.select(F.col("o_orderkey").alias("k"), tx.property_names(F.col("o_orderkey") % 256).alias("names"))


@query(
    "identifiers",
    """with w as (select doc_id, replace(replace(replace(lang || ' ' || source || '-(data) ' || doc_id, '(', ' '), ')', ' '), '-', ' ') as s
      from documents),
    x as (select doc_id, string_split(s, ' ') as a from w)
    select doc_id, lower(a[1]) || list_aggregate(list_transform(a[2:], lambda v: upper(v[1:1]) || lower(v[2:])), 'string_agg', '') as ident,
      cast(('0x' || printf('%x', doc_id)) as bigint) as number, list_last(string_split('org.' || lang || '.' || source, '.')) as cname
    from x join documents using (doc_id)""",
)
def identifiers(spark, folder):
    docs = tables.table(spark, folder, "documents")
    label = F.concat_ws("", "lang", F.lit(" "), "source", F.lit("-(data) "), F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id",
        tx.identifier(label).alias("ident"),
        tx.hex_number(F.concat(F.lit("0x"), F.lower(F.hex("doc_id")))).alias("number"),
        tx.last_component(F.concat_ws(".", F.lit("org"), "lang", "source")).alias("cname"),
    )


@query(
    "fixed_formats",
    """select l_orderkey, l_linenumber as line, l_partkey, printf('%.6f', l_extendedprice / 104729e0) as f6,
      printf('%.2f', l_extendedprice / 104729e0) as f2, cast(cast(trunc(l_extendedprice) as bigint) as varchar) as d,
      round(l_extendedprice / 104729e0, 2) as r2 from lineitem""",
)
def fixed_formats(spark, folder):
    x = F.col("l_extendedprice") / F.lit(104729e0)
    return tables.table(spark, folder, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("line"), "l_partkey", tx.fixed_text(x, 6).alias("f6"),
        tx.fixed_text(x, 2).alias("f2"), tx.integer_text(F.col("l_extendedprice")).alias("d"), F.round(x, 2).alias("r2"),
    )


@query("name_text", "select doc_id, text as name, length(text) as n from documents")
def name_text(spark, folder):
    docs = tables.table(spark, folder, "documents")
    shown = docs.select("doc_id", tx.name_text(F.col("text").cast("binary")).alias("name"))
    return shown.withColumn("n", F.length("name").cast("long"))


@query(
    "name_text_broken",
    """select customer.c_custkey as k, regexp_replace(c_name || '??' || c_mktsegment, '[^\\x20-\\x7F]', '?', 'g') as name from customer""",
)
def name_text_broken(spark, folder):
    customer = tables.table(spark, folder, "customer")
    broken = F.concat(F.col("c_name").cast("binary"), F.unhex(F.lit("FF0A")), F.col("c_mktsegment").cast("binary"))
    return customer.select(F.col("c_custkey").alias("k"), tx.name_text(broken).alias("name"))


# -------------------------------------------------------------------- adverts


# One advert per event with three fields: flags, a 16-bit service list of one
# or two entries (plus a stray byte), and a short name.
ADVERT_SQL = """
adv as (select event_id as seq, user_id as addr, ts, event_type,
  cast(floor(value) as bigint) % 8 as v, user_id % 2 + 1 as addr_type, cast(floor(value) as bigint) % 100 + 1 as rssi,
  case when event_type = 'error' then 4 else 0 end as flag from events),
fields as (
  select seq, addr, 0 as n, 1 as type, printf('%02x', v) as value from adv union all
  select seq, addr, 1, 3, printf('%02x18', v) || case when event_type = 'view' then '0f18aa' else '' end from adv union all
  select seq, addr, 2, 9, lower(hex(event_type)) from adv)
"""


def advert_events(spark, folder):
    events = tables.table(spark, folder, "events")
    v = F.floor("value") % 8
    service = F.concat(
        b.to_bytes(v, 1), F.unhex(F.lit("18")),
        F.when(F.col("event_type") == "view", F.unhex(F.lit("0F18AA"))).otherwise(F.unhex(F.lit(""))),
    )
    name = F.col("event_type").cast("binary")

    def field(kind, value):
        return F.concat(b.to_bytes(F.length(value) + 1, 1), b.to_bytes(F.lit(kind), 1), value)

    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("addr"),
        "ts",
        (F.col("user_id") % 2 + 1).alias("addr_type"),
        (F.floor("value") % 100 + 1).alias("rssi"),
        F.when(F.col("event_type") == "error", 4).otherwise(0).cast("long").alias("flag"),
        F.concat(field(1, b.to_bytes(v, 1)), field(3, service), field(9, name)).alias("data"),
    )


@query("advert_fields", f"with {ADVERT_SQL} select seq, addr, cast(n as bigint) as n, cast(type as bigint) as type, value from fields")
def advert_fields(spark, folder):
    fields = adverts.explode_fields(advert_events(spark, folder))
    return rounded(fields.withColumn("value", F.lower(F.hex("value"))))


@query(
    "advert_texts",
    f"""with {ADVERT_SQL} select seq, 'Flags' as field, printf('%02x', v) as shown from adv union all
    select seq, 'Complete 16b Services', printf('000018%02x-0000-1000-8000-00805f9b34fb', v) ||
      case when event_type = 'view' then ',0000180f-0000-1000-8000-00805f9b34fb' else '' end from adv union all
    select seq, 'Complete Local Name', event_type from adv""",
)
def advert_texts(spark, folder):
    fields = adverts.explode_fields(advert_events(spark, folder))
    return fields.select(
        "seq", adverts.field_name(F.col("type")).alias("field"),
        adverts.field_text(F.col("type"), F.col("value")).alias("shown"),
    )


@query(
    "advert_field_names",
    "select user_id % 256 as type, case user_id % 256 "
    + " ".join(f"when {k} then '{v}'" for k, v in adverts.FIELD_NAMES.items())
    + " else '0x' || printf('%x', user_id % 256) end as name, count(*) as n from events group by all",
)
def advert_field_names(spark, folder):
    events = tables.table(spark, folder, "events").withColumn("type", F.col("user_id") % 256)
    return events.groupBy("type", adverts.field_name(F.col("type")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "advert_latest",
    f"with {ADVERT_SQL} select addr, cast(type as bigint) as type, arg_max(value, seq) as value from fields group by addr, type",
)
def advert_latest(spark, folder):
    last = adverts.latest_fields(adverts.explode_fields(advert_events(spark, folder)))
    return rounded(last.withColumn("value", F.lower(F.hex("value"))))


@query(
    "advert_profiles",
    f"""with {ADVERT_SQL}, last as (select addr, type, arg_max(value, seq) as value from fields group by addr, type)
    select addr, count(*) as n, string_agg(type || '=' || value, ';' order by type) as fields from last group by addr""",
)
def advert_profiles(spark, folder):
    profiles = adverts.device_profiles(adverts.explode_fields(advert_events(spark, folder)))
    entries = F.array_sort(F.map_entries("fields"))
    shown = F.transform(entries, lambda e: F.concat_ws("=", e["key"].cast("string"), F.lower(F.hex(e["value"]))))
    return profiles.select("addr", F.size("fields").cast("long").alias("n"), F.array_join(shown, ";").alias("fields"))


STATUS_SQL = f"""{ADVERT_SQL},
  changes as (select seq, max(case when b4 is null or b4 <> value then 1 else 0 end) as changed from (
    select *, lag(value) over (partition by addr, type order by seq, n) as b4 from fields) t group by seq),
  firsts as (select addr, min(seq) as f from adv group by addr),
  graded as (select adv.*, case when seq = f then 'new' when changed = 1 then 'update' else 'old' end as status
    from adv join firsts using (addr) left join changes using (seq))"""


def graded_adverts(spark, folder):
    source = advert_events(spark, folder)
    return adverts.advert_status(source, adverts.explode_fields(source))


@query("advert_status", f"with {STATUS_SQL} select seq, addr, status from graded")
def advert_status(spark, folder):
    return graded_adverts(spark, folder).select("seq", "addr", "status")


@query(
    "advert_report",
    f"""with {STATUS_SQL} select seq, addr, status, -rssi as dbm, flag & 4 = 0 as connectable,
      case addr_type when 1 then 'public' else 'random' end as address from graded
    where status in ('new', 'update') and -rssi >= -20 and flag & 4 = 0""",
)
def advert_report(spark, folder):
    shown = adverts.report(adverts.with_signal(graded_adverts(spark, folder)), sensitivity=-20, connectable_only=True)
    return shown.select("seq", "addr", "status", "dbm", "connectable", "address")


@query(
    "address_conflicts",
    """select user_id as addr, cast(min(t) as bigint) as first_type, cast(max(t) as bigint) as last_type from (
      select user_id, case when event_id % 97 = 0 then 2 else 1 end as t from events) x
    group by user_id having min(t) <> max(t)""",
)
def address_conflicts(spark, folder):
    events = tables.table(spark, folder, "events").select(
        F.col("user_id").alias("addr"), F.when(F.col("event_id") % 97 == 0, 2).otherwise(1).alias("addr_type")
    )
    return rounded(adverts.address_conflicts(events))


@query(
    "scan_windows",
    """select user_id as addr, time_bucket(interval '3600 second', ts, timestamp '2024-01-01 00:00:00') as win_start,
      count(*) as n from events group by all""",
)
def scan_windows(spark, folder):
    events = tables.table(spark, folder, "events").withColumnRenamed("user_id", "addr")
    return adverts.scan_windows(events, 3600)


@query(
    "uuid_names",
    """with names as (select p_partkey as number, arg_max(p_name, p_partkey) as name from part group by p_partkey)
    select l_orderkey, l_linenumber as line, l_partkey, case when l_partkey % 2 = 0 then name
      when l_partkey < 65536 then printf('%04x', l_partkey) else printf('%08x', l_partkey) end as uuid_name
    from lineitem left join names on number = l_partkey""",
)
def uuid_names(spark, folder):
    part = tables.table(spark, folder, "part").where("p_partkey % 2 = 0")
    catalogue = part.select(F.lit("service_UUIDs").alias("kind"), F.col("p_partkey").alias("number"), F.col("p_name").alias("name"))
    line = tables.table(spark, folder, "lineitem")
    keyed = line.select(
        "l_orderkey", F.col("l_linenumber").alias("line"), "l_partkey", tx.uuid_from_int(F.col("l_partkey")).alias("uuid")
    )
    return adverts.with_uuid_name(keyed, adverts.uuid_names(catalogue)).drop("uuid")
