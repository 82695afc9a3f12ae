"""Identifiers, names and text formats of device data."""

from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
BASE_UUID_TAIL = "00001000800000805F9B34FB"
BASE_UUID_SUFFIX = "-0000-1000-8000-00805f9b34fb"

# Bits of a characteristic's property mask and their names, lowest bit first.
PROPERTY_NAMES = (
    (1, "BROADCAST"),
    (2, "READ"),
    (4, "WRITE NO RESPONSE"),
    (8, "WRITE"),
    (16, "NOTIFY"),
    (32, "INDICATE"),
    (64, "WRITE SIGNED"),
    (128, "EXTENDED PROPERTIES"),
)
# ------------------------------------------------------------ end fixed values


def uuid_from_text(text):
    """Canonical UUID of a 32-digit or short hex text; NULL if it is neither."""
    digits = F.replace(text, F.lit("-"), F.lit(""))
    short = F.concat(F.lpad(digits, 8, "0"), F.lit(BASE_UUID_TAIL))
    full = F.lower(F.when(F.length(digits) <= 8, short).otherwise(digits))
    grouped = F.regexp_replace(
        full, r"^(\w{8})(\w{4})(\w{4})(\w{4})(\w{12})$", "$1-$2-$3-$4-$5"
    )
    return F.when(full.rlike("^[0-9a-f]{32}$"), grouped)


def uuid_from_int(number):
    """Canonical UUID of a short assigned number; NULL outside 32 bits."""
    n = number.cast("long")
    text = uuid_from_text(F.hex(n))
    return F.when((n >= 0) & (n <= F.lit(0xFFFFFFFF)), text)


def require_uuid(text):
    """Like ``uuid_from_text`` but a malformed text is an error."""
    parsed = uuid_from_text(text)
    complaint = F.concat(F.lit("UUID must be 16 bytes, got "), text)
    return F.when(parsed.isNull() & text.isNotNull(), F.raise_error(complaint).cast("string")).otherwise(parsed)


def short_uuid(uuid):
    """Display form: assigned numbers lose the base and their leading zeros."""
    head = F.substring(uuid, 1, 8)
    trimmed = F.when(head.startswith("0000"), F.substring(head, 5, 4)).otherwise(head)
    return F.when(F.endswith(uuid, F.lit(BASE_UUID_SUFFIX)), trimmed).otherwise(uuid)


def property_names(mask):
    """Names of the set bits, each followed by a blank."""
    pairs = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(n).alias("name")) for b, n in PROPERTY_NAMES])
    chosen = F.filter(pairs, lambda p: mask.cast("int").bitwiseAND(p["bit"]) != 0)
    return F.array_join(F.transform(chosen, lambda p: F.concat(p["name"], F.lit(" "))), "")


def identifier(text):
    """Camel-case identifier of a description."""
    words = F.split(F.translate(text, "()-", "   "), " ")
    rest = F.transform(
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))),
    )
    return F.concat(F.lower(F.get(words, F.lit(0))), F.array_join(rest, ""))


def hex_number(text):
    """Number written in hex, with or without 0x; NULL if it is not one."""
    digits = F.regexp_replace(F.trim(text), "^0[xX]", "")
    number = F.conv(digits, 16, 10).cast("long")
    return F.when(digits.rlike("^[0-9a-fA-F]{1,15}$"), number)


def last_component(text):
    return F.element_at(F.split(text, r"\."), -1)


def name_text(data):
    """A device name: UTF-8 if valid, else printable characters and question marks."""
    valid = F.try_validate_utf8(data.cast("string"))
    letters = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(data), F.lit(1))),
        lambda i: F.call_function("substring", data, i, F.lit(1)),
    )
    plain = F.array_join(
        F.transform(
            letters,
            lambda b: F.when(F.hex(b).between("20", "7F"), b.cast("string")).otherwise("?"),
        ),
        "",
    )
    return F.when(F.length(data) == 0, F.lit("")).otherwise(F.coalesce(valid, plain))


def mac_text(data):
    """Six bytes as lower-case hex pairs with colons."""
    return F.lower(F.regexp_replace(F.hex(F.substring(data, 1, 6)), "(?<=..)(..)(?=(?:..)*$)", ":$1"))


def is_mac(text):
    """An address has six groups between colons."""
    return F.size(F.split(text, ":")) == 6


def integer_text(column):
    """``%d``: the fraction is cut off."""
    return column.cast("long").cast("string")


def fixed_text(column, decimals):
    return F.format_string(f"%.{decimals}f", column.cast("double"))
