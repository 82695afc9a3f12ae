"""Bytes, identifiers, payload decoders and adverts."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from kinetable.functions import bytes as b
from kinetable.functions import decoders as d
from kinetable.functions import text as tx
from kinetable.operators import adverts


def one(spark, data, **columns):
    """A one-row table with a payload."""
    return spark.createDataFrame([(bytearray(data),)], "data binary").withColumns(
        {k: F.lit(v) for k, v in columns.items()}
    )


@pytest.mark.parametrize("value", [0, 1, -1, 32767, -32768, 0x1234])
def test_integers_round_trip(spark, value):
    packed = struct.pack("<hIb", value, value & 0xFFFFFFFF, value % 128)
    df = one(spark, packed).withColumn("c", b.image(F.col("data")))
    c = F.col("c")
    row = df.select(
        b.sint16(c, 0), b.uint16(c, 0), b.uint32(c, 2), b.uint24(c, 2), b.sint8(c, 6), b.uint16(c, 6)
    ).first()
    u = value & 0xFFFFFFFF
    assert list(row) == [value, value & 0xFFFF, u, u & 0xFFFFFF, value % 128, None]
    back = df.select(F.concat(b.to_bytes(F.lit(value), 2), b.to_bytes(F.lit(value), 4)).alias("p")).first()["p"]
    assert bytes(back) == packed[:6]


def test_bytes_that_are_no_text(spark):
    row = one(spark, b"\xc3\xa9\xff\x00").select(F.decode("data", "ISO-8859-1").alias("c")).select(
        b.uint16(F.col("c"), 0).alias("a"), b.uint16(F.col("c"), 2).alias("z")
    ).first()
    assert (row["a"], row["z"]) == (0xA9C3, 0x00FF)


def decoded(spark, kind, data, **inputs):
    return d.decode(one(spark, data), kind, **{k: F.lit(v) for k, v in inputs.items()}).drop("data").first().asDict()


def test_movement_scales(spark):
    raw = (100, -200, 300, 4096, -4096, 2048, 1, -32768, 32767)
    out = decoded(spark, "movement", struct.pack("<9h", *raw))
    assert (out["acc_x"], out["acc_y"], out["acc_z"]) == (1.0, -1.0, 0.5)
    assert out["gyro_y"] == -200 * 500.0 / 65536.0
    assert out["mag_y"] == -32768 * (4912.0 / 32760)


def test_accelerometer_scale_depends_on_firmware(spark):
    data = struct.pack("bbb", 64, -64, 16)
    assert decoded(spark, "accelerometer_v1", data)["x"] == 4.0
    assert decoded(spark, "accelerometer_v1", data, firmware="1.4 (May 2013)")["y"] == -1.0
    assert decoded(spark, "accelerometer_v1", data, firmware="1.40")["z"] == 1.0
    assert decoded(spark, "accelerometer_v1", data, firmware=None)["z"] == 1.0


def test_infrared(spark):
    out = decoded(spark, "infrared_v1", struct.pack("<hh", -120, 3200))
    die = 25 + 273.15
    off = die - 298.15
    volts = 1.5625e-7 * -120 - (-2.94e-5 - 5.7e-7 * off + 4.63e-9 * off**2)
    sens = 6.4e-14 * (1 + 1.75e-3 * off - 1.678e-5 * off**2)
    assert out["ambient"] == 25.0
    assert out["target"] == pytest.approx((die**4 + (volts + 13.4 * volts**2) / sens) ** 0.25 - 273.15)
    shifted = decoded(spark, "infrared_tmp007", struct.pack("<hh", -5, 7))
    assert (shifted["target"], shifted["ambient"]) == (-2 * 0.03125, 0.03125)


def test_humidity_light_pressure(spark):
    assert decoded(spark, "humidity_hdc1000", struct.pack("<HH", 32768, 65535))["temperature"] == 42.5
    assert decoded(spark, "humidity_signed", struct.pack("<HH", 0, 49152))["humidity"] == -25.0
    assert decoded(spark, "light", struct.pack("<H", 0x2345))["lux"] == 0.01 * (0x345 << 2)
    assert decoded(spark, "light", struct.pack("<H", 0xF001))["lux"] == 0.01 * (1 << 15)
    out = decoded(spark, "barometer_bmp280", bytes([0x10, 0x27, 0, 0xA0, 0x86, 1]))
    assert out == {"temperature": 100.0, "pressure": 1000.0}
    assert decoded(spark, "box_temperature", bytes([0xFF, 5]))["temperature"] == -1 + 0.05
    assert decoded(spark, "box_gas", struct.pack("<HH", 400, 65000)) == {"eco2": 400.0, "tvoc": 65000.0}
    assert decoded(spark, "humidity_v1", b"\x01")["temperature"] is None


def test_barometer_with_calibration(spark):
    cal = (45697, 25592, 48894, 36174, 7001, 1990, -2369, 5037)
    payloads = spark.createDataFrame([("a", bytearray(struct.pack("<hH", -2000, 41000)))], "device string, data binary")
    numbers = spark.createDataFrame([("a", bytearray(struct.pack("<4H4h", *cal)))], "device string, calibration binary")
    out = d.decode_barometer(payloads, numbers).first()
    t = -2000.0
    gain = cal[2] + cal[3] / 2**17 * t + cal[4] / 2**34 * t * t
    offset = cal[5] * 2**14 + cal[6] / 8 * t + cal[7] / 2**19 * t * t
    assert out["temperature"] == pytest.approx(cal[0] / 2**24 * t + cal[1] / 2**10)
    assert out["pressure"] == pytest.approx((gain * 41000 + offset) / (100 * 2**14))


def test_mixed_payloads_are_routed(spark):
    rows = [
        ("CC2650", "AA21", struct.pack("<HH", 32768, 0)),
        ("v1", "aa21", struct.pack("<HH", 0, 0)),
        ("box", "0203", b"\x2a"),
        ("box", "0205", b"\x01\x02"),
        ("v1", "dead", b"\x99"),
        ("CC2650", "aa71", b"\x01"),
    ]
    df = spark.createDataFrame([(g, c, bytearray(x)) for g, c, x in rows], "generation string, characteristic string, data binary")
    out = [r for r in d.decode_all(df).collect()]
    assert out[0]["readings"] == {"temperature": 42.5, "humidity": 0.0}
    assert out[1]["readings"]["temperature"] == -46.85
    assert out[2]["readings"] == {"humidity": 42.0}
    assert (out[3]["kind"], out[3]["readings"], out[3]["raw"]) == ("color", None, "0102")
    assert out[4]["kind"] == "unknown"
    assert out[5]["readings"] == {}


def test_uuid_forms(spark):
    forms = {
        "180F": "0000180f-0000-1000-8000-00805f9b34fb",
        "0000180f": "0000180f-0000-1000-8000-00805f9b34fb",
        "F000AA81-0451-4000-B000-000000000000": d.tag_uuid("AA81"),
        "xyz": None,
        "123456789": None,
    }
    df = spark.createDataFrame([(k,) for k in forms], "t string")
    out = {r["t"]: r["u"] for r in df.select("t", tx.uuid_from_text(F.col("t")).alias("u")).collect()}
    assert out == forms
    with pytest.raises(Exception, match="16 bytes"):
        df.select(tx.require_uuid(F.col("t"))).collect()
    assert spark.range(1).select(tx.uuid_from_int(F.lit(-1))).first()[0] is None


def test_texts(spark):
    row = spark.range(1).select(
        tx.identifier(F.lit("Battery Level (State)-x")),
        tx.property_names(F.lit(0b10010010)),
        tx.short_uuid(F.lit("0000180f-0000-1000-8000-00805f9b34fb")),
        tx.short_uuid(F.lit("1234180f-0000-1000-8000-00805f9b34fb")),
        tx.mac_text(F.unhex(F.lit("24718900FFAB"))),
        tx.name_text(F.unhex(F.lit("41C3A9"))),
        tx.name_text(F.unhex(F.lit("41FF7E0A"))),
        tx.name_text(F.unhex(F.lit(""))),
        tx.hex_number(F.lit("0x2A19")),
        tx.hex_number(F.lit("0xZZ")),
    ).first()
    assert list(row) == [
        "batteryLevelStateX", "READ NOTIFY EXTENDED PROPERTIES ", "180f", "1234180f", "24:71:89:00:ff:ab",
        "Aé", "A?~?", "", 0x2A19, None,
    ]


def fields_of(data):
    """Length-type-value reading in plain Python."""
    out = []
    while len(data) >= 2:
        out.append((data[1], bytes(data[2 : data[0] + 1])))
        data = data[data[0] + 1 :]
    return out


def test_random_adverts(spark):
    rng = random.Random(7)
    cases = [b"", b"\x00", b"\x05", b"\x00\x00\x02\x01\x06", b"\x03\xff"]
    for _ in range(300):
        cases.append(bytes(rng.randint(0, 6) if rng.random() < 0.5 else rng.randint(0, 255) for _ in range(rng.randint(0, 40))))
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i long, data binary")
    for row in df.select("i", adverts.parse_fields("data").alias("f")).collect():
        assert [(x["type"], bytes(x["value"])) for x in row["f"]] == fields_of(cases[row["i"]])


def test_field_values(spark):
    rows = [
        (3, bytes.fromhex("0f180a18ff")), (6, bytes(range(16))), (5, b"\x01\x02\x03"), (9, b"Tag"), (255, b"\x0d\x00"), (2, b""),
    ]
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "k int, v binary")
    out = [r[0] for r in df.select(adverts.field_text(F.col("k"), F.col("v"))).collect()]
    assert out == [
        "0000180f-0000-1000-8000-00805f9b34fb,0000180a-0000-1000-8000-00805f9b34fb",
        "0f0e0d0c-0b0a-0908-0706-050403020100", "", "Tag", "0d00", "",
    ]


def test_advert_status_within_one_advert(spark):
    """A field that comes twice in an advert is compared with its own first copy."""
    rows = [(1, "a", b"\x02\x01\x05"), (2, "a", b"\x02\x01\x05"), (3, "a", b"\x02\x01\x06\x02\x01\x05"), (4, "a", b""), (5, "b", b"")]
    df = spark.createDataFrame([(s, a, bytearray(x)) for s, a, x in rows], "seq long, addr string, data binary")
    out = adverts.advert_status(df, adverts.explode_fields(df)).orderBy("seq").collect()
    assert [r["status"] for r in out] == ["new", "old", "update", "old", "new"]


def test_report_filters(spark):
    df = spark.createDataFrame(
        [("new", 50, 0), ("update", 50, 0), ("old", 50, 0), ("new", 90, 0), ("new", 50, 4)], "status string, rssi int, flag int"
    ).withColumn("addr_type", F.lit(2))
    marked = adverts.with_signal(df)
    assert adverts.report(marked).count() == 4
    assert adverts.report(marked, only_new=True).count() == 3
    assert adverts.report(marked, include_old=True, sensitivity=-60, connectable_only=True).count() == 3
    assert marked.first()["address"] == "random"


def test_uuid_names_prefer_the_last_kind(spark):
    catalogue = spark.createDataFrame(
        [("characteristic_UUIDs", 0x2A19, "Battery Level"), ("service_UUIDs", 0x180F, "Battery"), ("service_UUIDs", 0x2A19, "Other")],
        "kind string, number long, name string",
    )
    df = spark.createDataFrame([(0x180F,), (0x2A19,), (0x1234,)], "n long").select(tx.uuid_from_int(F.col("n")).alias("uuid"))
    out = {r["uuid"][4:8]: r["uuid_name"] for r in adverts.with_uuid_name(df, adverts.uuid_names(catalogue)).collect()}
    assert out == {"180f": "Battery", "2a19": "Other", "1234": "1234"}
