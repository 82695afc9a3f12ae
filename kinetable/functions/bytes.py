"""Integers at byte offsets of a payload, little-endian, and back.

Spark cannot cast binary to numbers.  A payload is turned into its image, a text
with one character per byte, once per row; numbers are then read from the
characters' codes, inside generated code.  Offsets past the end give NULL.
"""

from pyspark.sql import functions as F


def image(data):
    """Text with one character per byte of a binary column."""
    return F.decode(data, "ISO-8859-1")


def uint(chars, offset, width):
    """Unsigned little-endian integer of ``width`` bytes."""
    number = None
    for i in range(width):
        byte = F.ascii(F.substring(chars, offset + i + 1, 1)).cast("long")
        byte = F.shiftleft(byte, 8 * i) if i else byte
        number = byte if number is None else number + byte
    return F.when(F.length(chars) >= offset + width, number)


def sint(chars, offset, width):
    """Signed little-endian integer of ``width`` bytes; the shifts copy the sign."""
    unused = 64 - 8 * width
    return F.shiftright(F.shiftleft(uint(chars, offset, width), unused), unused)


def uint8(chars, offset=0):
    return uint(chars, offset, 1)


def sint8(chars, offset=0):
    return sint(chars, offset, 1)


def uint16(chars, offset=0):
    return uint(chars, offset, 2)


def sint16(chars, offset=0):
    return sint(chars, offset, 2)


def uint24(chars, offset=0):
    return uint(chars, offset, 3)


def uint32(chars, offset=0):
    return uint(chars, offset, 4)


def signed_hex8(text):
    """Signed 8-bit number written as two hex digits."""
    v = F.conv(text, 16, 10).cast("long")
    return F.when(v >= 128, v - 256).otherwise(v)


def to_bytes(number, width):
    """Little-endian bytes of an integer; negative numbers in two's complement."""
    parts = [
        F.unhex(F.lpad(F.hex(F.shiftright(number.cast("long"), 8 * i).bitwiseAND(F.lit(255))), 2, "0"))
        for i in range(width)
    ]
    return F.concat(*parts) if width > 1 else parts[0]


def reversed_hex(data, width):
    """Hex text of a fixed-width binary with its bytes in reverse order."""
    return F.concat(*[F.hex(F.substring(data, i + 1, 1)) for i in reversed(range(width))])


def quadratic(c0, c1, c2, x):
    return F.lit(c0) + F.lit(c1) * x + F.lit(c2) * x * x
