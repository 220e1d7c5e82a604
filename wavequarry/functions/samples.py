"""Range-strict sample conversion and channel shapes as Catalyst expressions.

Rules of conversion: integers widen by shifting left and narrow by an
arithmetic shift right; unsigned is signed plus half the range; floats are
clamped to [-1, 1], scaled by the largest positive integer and truncated; an
integer becomes a float by division by that number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> (bits, signed, floating)
TYPES = {
    "i8": (8, True, False), "i16": (16, True, False), "i24": (24, True, False), "i32": (32, True, False), "i64": (64, True, False),
    "u8": (8, False, False), "u16": (16, False, False), "u24": (24, False, False), "u32": (32, False, False), "u64": (64, False, False),
    "f32": (32, True, True), "f64": (64, True, True),
}
#: Spark has no unsigned types: each is kept in the next wider one.
SPARK_TYPES = {
    "i8": "tinyint", "i16": "smallint", "i24": "int", "i32": "int", "i64": "bigint", "u8": "smallint", "u16": "int",
    "u24": "int", "u32": "bigint", "u64": "decimal(20,0)", "f32": "float", "f64": "double",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scale(value: Column, source: str, target: str) -> Column:
    """``value`` of type ``source`` as type ``target``, by numerical range."""
    (a, a_signed, a_float), (b, b_signed, b_float) = TYPES[source], TYPES[target]
    if source == target:
        return value
    if a_float and b_float:
        return value.cast(SPARK_TYPES[target])
    wide = "decimal(38,0)" if 64 in (a, b) and not (a_signed and b_signed) else "long"
    if a_float:
        clamped = F.greatest(F.least(value.cast("double"), F.lit(1.0)), F.lit(-1.0))
        # 2**63 - 1 is no double: the product is brought back into range before the cast
        signed = F.least(clamped * F.lit(float(2 ** (b - 1) - 1)), F.lit(9.223372036854775e18)).cast("long")
        if b_signed:
            return signed.cast(SPARK_TYPES[target])
        out = signed.cast("decimal(38,0)") + F.lit(2**63).cast("decimal(38,0)") if b == 64 else signed + F.lit(2 ** (b - 1))
        return out.cast(SPARK_TYPES[target])
    signed = value.cast(wide) if a_signed else (value.cast("decimal(38,0)") - F.lit(2**63).cast("decimal(38,0)") if a == 64 else value.cast("long") - F.lit(2 ** (a - 1)))
    if b_float:
        return (signed.cast("double") / F.lit(float(2 ** (a - 1) - 1))).cast(SPARK_TYPES[target])
    signed = signed.cast("long")
    moved = F.shiftleft(signed, b - a) if b >= a else F.shiftright(signed, a - b)
    if not b_signed:
        moved = moved.cast("decimal(38,0)") + F.lit(2**63).cast("decimal(38,0)") if b == 64 else moved + F.lit(2 ** (b - 1))
    return moved.cast(SPARK_TYPES[target])


def scale_all(values: Column, source: str, target: str) -> Column:
    """Array form of ``scale``; a null array stays null."""
    return F.transform(values, lambda x: scale(x, source, target))


def frames(values: Column, channels: int) -> Column:
    """Interleaved samples as an array of frames; a part of a frame at the end is left out."""
    n = F.floor(F.size(values) / channels).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(values, k * channels + 1, channels))).otherwise(F.slice(F.array(values), 1, 0))


def interleave(channels: Column) -> Column:
    """Arrays by channel as one interleaved array."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(channels[0]) - 1), lambda k: F.transform(channels, lambda c: F.get(c, k))))


def deinterleave(values: Column, channels: int) -> Column:
    """Interleaved samples as arrays by channel."""

    def only(c: int) -> Column:
        return F.filter(values, lambda _, i: i % channels == c)

    return F.array(*map(only, range(channels)))


def mean(frame: Column) -> Column:
    """All channels of a frame as one value."""
    return F.aggregate(frame, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(frame)


def integer_mean(frame: Column) -> Column:
    """Integer mean of a frame, truncated toward zero."""
    total = F.aggregate(frame, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return F.signum(total).cast("long") * F.floor(F.abs(total) / F.size(frame)).cast("long")


def to_stereo(frame: Column, gains: Column | None = None) -> Column:
    """(l, r) of a frame: one channel is doubled; more than two need gains, [left, right] by channel."""
    pair = F.when(F.size(frame) == 1, F.array(frame[0], frame[0])).when(F.size(frame) == 2, frame)
    return pair if gains is None else F.coalesce(pair, downmix(frame, gains))


def downmix(frame: Column, gains: Column) -> Column:
    """One weighted sum of the channels for each row of ``gains``."""
    return F.transform(gains, lambda row: F.aggregate(F.zip_with(frame, row, lambda x, g: x.cast("double") * g), F.lit(0.0), lambda a, x: a + x))


def flac_fit(value: Column, bits: int) -> Column:
    """A 32-bit sample at ``bits`` bits, by arithmetic shift."""
    return F.shiftright(value.cast("int"), 32 - bits)


def pad_block(values: Column, size: int) -> Column:
    """``values`` with zeros up to a multiple of ``size``."""
    return F.concat(values, F.array_repeat(F.lit(0), F.pmod(F.lit(size) - F.pmod(F.size(values), F.lit(size)), F.lit(size)).cast("int")))


# ---- ITU-T G.711, closed form ----


def _segment(value: Column, first: int, count: int) -> Column:
    """The segment of a magnitude whose segment 0 ends before ``first``."""
    out = F.lit(count - 1)
    for k in range(count - 2, -1, -1):
        out = F.when(value < first << k, F.lit(k)).otherwise(out)
    return out


def mulaw_encode(sample: Column) -> Column:
    """16-bit sample -> 8-bit code."""
    value = sample.cast("long")
    size = F.least(F.abs(value), F.lit(32635)) + 132
    segment = _segment(size, 256, 8)
    low = F.pmod(F.floor(size / F.pow(F.lit(2.0), segment + 3)).cast("long"), F.lit(16))
    return (255 - (F.when(value < 0, F.lit(128)).otherwise(F.lit(0)) + segment * 16 + low)).cast("int")


def mulaw_decode(code: Column) -> Column:
    """8-bit code -> 16-bit sample."""
    bits = 255 - code.cast("long")
    segment = F.floor(F.pmod(bits, F.lit(128)) / 16).cast("long")
    size = ((F.pmod(bits, F.lit(16)) * 8 + 132) * F.pow(F.lit(2.0), segment)).cast("long") - 132
    return F.when(bits >= 128, -size).otherwise(size).cast("int")


def alaw_encode(sample: Column) -> Column:
    """16-bit sample -> 8-bit code, even bits inverted."""
    value = F.shiftright(sample.cast("long"), 3)
    size = F.when(value >= 0, value).otherwise(-value - 1)
    segment = _segment(size, 32, 8)
    shift = F.greatest(segment, F.lit(1))
    low = F.pmod(F.floor(size / F.pow(F.lit(2.0), shift)).cast("long"), F.lit(16))
    plain = segment * 16 + low
    return F.when(value >= 0, plain.bitwiseXOR(F.lit(0xD5))).otherwise(plain.bitwiseXOR(F.lit(0x55))).cast("int")


def alaw_decode(code: Column) -> Column:
    """8-bit code -> 16-bit sample."""
    bits = code.cast("long").bitwiseXOR(F.lit(0x55).cast("long"))
    segment = F.floor(F.pmod(bits, F.lit(128)) / 16).cast("long")
    base = F.pmod(bits, F.lit(16)) * 16 + F.when(segment == 0, F.lit(8)).otherwise(F.lit(264))
    size = (base * F.pow(F.lit(2.0), F.greatest(segment - 1, F.lit(0)))).cast("long")
    return F.when(bits >= 128, size).otherwise(-size).cast("int")
