"""Payload decoders: one struct-like set of columns per sensor kind.

``DECODERS[kind]`` maps the image of a payload (``bytes.image``) to named value
columns.  Everything is column arithmetic, so a table of mixed payloads is
decoded in one scan.
"""

from pyspark.sql import functions as F

from kinetable.functions import bytes as b
from kinetable.schema import COUNTS_PER_G

# ---------------------------------------------------------------- fixed values
ZERO_CELSIUS_K = 273.15
REFERENCE_K = 298.15
IR_VOLTS_PER_COUNT = 1.5625e-7
IR_SENSITIVITY = 6.4e-14
IR_SENSITIVITY_POLY = (1.0, 1.75e-3, -1.678e-5)
IR_OFFSET_POLY = (-2.94e-5, -5.7e-7, 4.63e-9)
IR_SEEBECK_POLY = (0.0, 1.0, 13.4)
TMP007_DEGREES_PER_COUNT = 0.03125

# Data characteristics by short code.
TAG_CHARACTERISTICS = {
    "aa01": "infrared",
    "aa11": "accelerometer",
    "aa21": "humidity",
    "aa31": "magnetometer",
    "aa41": "barometer",
    "aa51": "gyroscope",
    "aa71": "light",
    "aa81": "movement",
    "ffe1": "keys",
    "2a19": "battery",
}
BOX_CHARACTERISTICS = {
    "0201": "temperature",
    "0202": "pressure",
    "0203": "humidity",
    "0204": "gas",
    "0205": "color",
    "0302": "button",
    "0402": "tap",
    "0403": "orientation",
    "0404": "quaternion",
    "0405": "step_counter",
    "0406": "raw_data",
    "0407": "euler",
    "0408": "rotation_matrix",
    "0409": "heading",
    "040a": "gravity_vector",
    "0503": "speaker_status",
    "0504": "microphone",
}
GENERATION_SERVICE = "aa70"
# ------------------------------------------------------------ end fixed values


def tag_uuid(code):
    """UUID of a tag characteristic, from its short code in hex."""
    return f"f000{code.lower()}-0451-4000-b000-000000000000"


def box_uuid(code):
    return f"ef68{code.lower()}-9b35-4933-9b10-52ffa9740042"


def triple(chars, first, scale):
    return {a: b.sint16(chars, first + 2 * i) * F.lit(scale) for i, a in enumerate("xyz")}


def movement_acceleration(chars):
    return {a: b.sint16(chars, 6 + 2 * i) / F.lit(COUNTS_PER_G) for i, a in enumerate("xyz")}


def movement_gyro(chars):
    return triple(chars, 0, 500.0 / 65536.0)


def movement_magnet(chars):
    return triple(chars, 12, 4912.0 / 32760)


def movement(chars):
    sets = {"acc": movement_acceleration, "gyro": movement_gyro, "mag": movement_magnet}
    return {f"{n}_{a}": c for n, f in sets.items() for a, c in f(chars).items()}


def accelerometer_v1(chars, firmware=None):
    """Three signed bytes; firmware 1.4 has a finer scale."""
    fine = F.coalesce(F.startswith(firmware, F.lit("1.4 ")), F.lit(False)) if firmware is not None else F.lit(False)
    scale = F.when(fine, F.lit(64.0)).otherwise(F.lit(16.0))
    return {a: b.sint8(chars, i) / scale for i, a in enumerate("xyz")}


def infrared_v1(chars):
    """Thermopile: the object's temperature from its voltage and the die's heat."""
    ambient = b.sint16(chars, 2) / F.lit(128.0)
    volts = F.lit(IR_VOLTS_PER_COUNT) * b.sint16(chars, 0)
    die = ambient + F.lit(ZERO_CELSIUS_K)
    off = die - F.lit(REFERENCE_K)
    sensitivity = F.lit(IR_SENSITIVITY) * b.quadratic(*IR_SENSITIVITY_POLY, off)
    seen = b.quadratic(*IR_SEEBECK_POLY, volts - b.quadratic(*IR_OFFSET_POLY, off))
    target = F.pow(F.pow(die, F.lit(4.0)) + seen / sensitivity, F.lit(0.25))
    return {"ambient": ambient, "target": target - F.lit(ZERO_CELSIUS_K)}


def infrared_tmp007(chars):
    step = F.lit(TMP007_DEGREES_PER_COUNT)
    return {
        "ambient": F.shiftright(b.sint16(chars, 2), 2) * step,
        "target": F.shiftright(b.sint16(chars, 0), 2) * step,
    }


def humidity_v1(chars):
    t, h = b.uint16(chars, 0), b.uint16(chars, 2)
    part = h.bitwiseAND(F.lit(0xFFFC)) / F.lit(65536.0)
    return {
        "temperature": F.lit(-46.85) + F.lit(175.72) * (t / F.lit(65536.0)),
        "humidity": F.lit(-6.0) + F.lit(125.0) * part,
    }


def humidity_hdc1000(chars):
    t, h = b.uint16(chars, 0) / F.lit(65536.0), b.uint16(chars, 2) / F.lit(65536.0)
    return {"temperature": F.lit(-40.0) + F.lit(165.0) * t, "humidity": F.lit(100.0) * h}


def humidity_signed(chars):
    """The collector's reading of the same chip, with signed raw numbers."""
    t, h = b.sint16(chars, 0) / F.lit(65536.0), b.sint16(chars, 2) / F.lit(65536.0)
    return {"temperature": t * F.lit(165.0) - F.lit(40.0), "humidity": h * F.lit(100.0)}


def magnetometer_v1(chars):
    return {a: F.lit(1000.0) * (b.sint16(chars, 2 * i) / F.lit(32768.0)) for i, a in enumerate("xyz")}


def gyroscope_v1(chars):
    return {a: F.lit(250.0) * (b.sint16(chars, 2 * i) / F.lit(32768.0)) for i, a in enumerate("xyz")}


def barometer_v1(chars, calibration):
    """Temperature and pressure with the device's eight calibration numbers."""
    c = [b.uint16(calibration, 2 * i) for i in range(4)]
    c += [b.sint16(calibration, 2 * i) for i in range(4, 8)]
    raw = b.sint16(chars, 0).cast("double")
    warm = c[0] / F.lit(2.0**24) * raw + c[1] / F.lit(2.0**10)
    gain = c[2] / F.lit(1.0) + c[3] / F.lit(2.0**17) * raw + c[4] / F.lit(2.0**34) * raw * raw
    offset = c[5] * F.lit(2.0**14) + c[6] / F.lit(8.0) * raw + c[7] / F.lit(2.0**19) * raw * raw
    pressure = (gain * b.uint16(chars, 2) + offset) / F.lit(100.0 * 2.0**14)
    return {"temperature": warm, "pressure": pressure}


def barometer_bmp280(chars):
    return {
        "temperature": b.uint24(chars, 0) / F.lit(100.0),
        "pressure": b.uint24(chars, 3) / F.lit(100.0),
    }


def light(chars):
    raw = b.uint16(chars, 0)
    mantissa = raw.bitwiseAND(F.lit(0xFFF))
    exponent = F.shiftright(raw, 12).cast("int")
    return {"lux": F.lit(0.01) * F.call_function("shiftleft", mantissa, exponent)}


def battery(chars):
    return {"percent": b.uint8(chars, 0).cast("double")}


def keys(chars):
    return {"buttons": b.uint8(chars, 0).cast("double")}


def box_temperature(chars):
    return {"temperature": b.sint8(chars, 0) + b.uint8(chars, 1) / F.lit(100.0)}


def box_pressure(chars):
    return {"pressure": b.uint32(chars, 0) + b.uint8(chars, 4) / F.lit(100.0)}


def box_humidity(chars):
    return {"humidity": b.sint8(chars, 0).cast("double")}


def box_gas(chars):
    """Carbon dioxide in ppm and organic compounds in ppb, both unsigned 16 bit."""
    return {"eco2": b.uint16(chars, 0).cast("double"), "tvoc": b.uint16(chars, 2).cast("double")}


def box_button(chars):
    return {"state": b.sint8(chars, 0).cast("double")}


def box_tap(chars):
    return {"direction": b.uint8(chars, 0).cast("double"), "count": b.sint8(chars, 1).cast("double")}


DECODERS = {
    "movement": movement,
    "movement_acceleration": movement_acceleration,
    "movement_gyro": movement_gyro,
    "movement_magnet": movement_magnet,
    "accelerometer_v1": accelerometer_v1,
    "infrared_v1": infrared_v1,
    "infrared_tmp007": infrared_tmp007,
    "humidity_v1": humidity_v1,
    "humidity_hdc1000": humidity_hdc1000,
    "humidity_signed": humidity_signed,
    "magnetometer_v1": magnetometer_v1,
    "gyroscope_v1": gyroscope_v1,
    "barometer_v1": barometer_v1,
    "barometer_bmp280": barometer_bmp280,
    "light": light,
    "battery": battery,
    "keys": keys,
    "box_temperature": box_temperature,
    "box_pressure": box_pressure,
    "box_humidity": box_humidity,
    "box_gas": box_gas,
    "box_button": box_button,
    "box_tap": box_tap,
}

#: Decoder by device generation and characteristic.
ROUTES = {
    "v1": {
        "infrared": "infrared_v1",
        "accelerometer": "accelerometer_v1",
        "humidity": "humidity_v1",
        "magnetometer": "magnetometer_v1",
        "gyroscope": "gyroscope_v1",
        "barometer": "barometer_v1",
        "keys": "keys",
    },
    "CC2650": {
        "infrared": "infrared_tmp007",
        "movement": "movement",
        "humidity": "humidity_hdc1000",
        "barometer": "barometer_bmp280",
        "light": "light",
        "battery": "battery",
        "keys": "keys",
    },
    "box": {
        "temperature": "box_temperature",
        "pressure": "box_pressure",
        "humidity": "box_humidity",
        "gas": "box_gas",
        "button": "box_button",
        "tap": "box_tap",
        "battery": "battery",
    },
}


def decode(df, kind, data="data", **inputs):
    """Add the value columns of one payload kind."""
    imaged = df.withColumn("_image", b.image(F.col(data)))
    return imaged.withColumns(DECODERS[kind](F.col("_image"), **inputs)).drop("_image")


def decode_barometer(payloads, calibrations, device="device", data="data"):
    """First-generation pressure: every payload meets its device's calibration."""
    joined = payloads.join(calibrations, device)
    imaged = joined.withColumns(
        {"_image": b.image(F.col(data)), "_numbers": b.image(F.col("calibration"))}
    )
    values = barometer_v1(F.col("_image"), F.col("_numbers"))
    return imaged.withColumns(values).drop("calibration", "_image", "_numbers")


def device_generations(services, device="device", service="service"):
    """Generation of every device, from the services it exposes."""
    has = F.max(F.lower(F.col(service)) == F.lit(GENERATION_SERVICE))
    return services.groupBy(device).agg(F.when(has, "CC2650").otherwise("v1").alias("generation"))


def characteristic_name(code, generation):
    """Name of a characteristic code, ``unknown`` if the family has none."""
    def names(table):
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    box = F.try_element_at(names(BOX_CHARACTERISTICS), F.lower(code))
    tag = F.try_element_at(names(TAG_CHARACTERISTICS), F.lower(code))
    return F.coalesce(F.when(generation == "box", F.coalesce(box, tag)).otherwise(tag), F.lit("unknown"))


def decode_all(payloads, data="data", firmware=None, calibration=None):
    """Decode a mixed table (generation, characteristic code, data) in one scan.

    ``readings`` maps value names to numbers; payloads without a decoder keep
    their bytes as hex text, unknown characteristics are tagged as such.
    ``firmware`` and ``calibration`` name columns with the device's revision
    text and its sixteen calibration bytes.  Without a firmware a
    first-generation accelerometer has the scale of the later ones; without
    a calibration its barometer has no readings.
    """
    inputs = {}
    if firmware is not None:
        inputs["accelerometer_v1"] = {"firmware": F.col(firmware)}
    numbers = F.lit(None).cast("binary") if calibration is None else F.col(calibration)
    inputs["barometer_v1"] = {"calibration": F.col("_numbers")}
    named = payloads.withColumns(
        {
            "kind": characteristic_name(F.col("characteristic"), F.col("generation")),
            "_image": b.image(F.col(data)),
            "_numbers": b.image(numbers),
        }
    )
    readings = None
    for generation, routes in ROUTES.items():
        chosen = None
        for kind, decoder in routes.items():
            values = DECODERS[decoder](F.col("_image"), **inputs.get(decoder, {}))
            made = F.create_map(*[x for n, c in values.items() for x in (F.lit(n), c)])
            same = F.col("kind") == kind
            chosen = F.when(same, made) if chosen is None else chosen.when(same, made)
        family = F.col("generation") == generation
        readings = F.when(family, chosen) if readings is None else readings.when(family, chosen)
    # Values past the end of a short payload are left out.  The filter also keeps
    # the long choice out of one generated method too large for the JVM to compile.
    readings = F.map_filter(readings, lambda _, value: value.isNotNull())
    return named.withColumns({"readings": readings, "raw": F.lower(F.hex(F.col(data)))}).drop("_image", "_numbers")
