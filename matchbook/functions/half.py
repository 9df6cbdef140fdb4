"""IEEE half precision as Column expressions: 16 bits per number, round half to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchbook.functions.vectors import doubles

#: Least exponent of a normal half, bits of its fraction, and the pattern of infinity.
LEAST_EXPONENT, FRACTION, INFINITE = -14, 10, 0x7C00


def half_bits(x: Column) -> Column:
    """Bit pattern (0 to 65535) of a finite double; values past the range become infinite."""
    size = F.abs(x)
    exponent = F.greatest(F.coalesce(F.floor(F.log2(size)), F.lit(LEAST_EXPONENT)), F.lit(LEAST_EXPONENT)).cast("int")
    # Steps of 2**(exponent - FRACTION). A fraction that rounds up carries into the exponent by itself.
    steps = F.rint(size * F.pow(F.lit(2.0), FRACTION - exponent)).cast("int")
    bits = (exponent - LEAST_EXPONENT) * (1 << FRACTION) + steps
    return F.least(bits, F.lit(INFINITE)) + F.when(x < 0, 1 << 15).otherwise(0)


def half_value(bits: Column) -> Column:
    """The double of a bit pattern."""
    exponent = F.shiftright(bits, FRACTION).bitwiseAND(31)
    fraction = bits.bitwiseAND((1 << FRACTION) - 1).cast("double")
    normal = (fraction + float(1 << FRACTION)) * F.pow(F.lit(2.0), (exponent - 25).cast("double"))
    size = F.when(exponent == 0, fraction * 2.0**-24).when(exponent == 31, F.lit(float("inf"))).otherwise(normal)
    return F.when(bits >= 1 << 15, -size).otherwise(size)


def half_codes(vec: Column) -> Column:
    """A vector as an array of 16-bit integers (two bytes a number in a Parquet or Arrow column)."""
    return F.transform(doubles(vec), lambda x: F.when(half_bits(x) >= 1 << 15, half_bits(x) - (1 << 16)).otherwise(half_bits(x)).cast("smallint"))


def half_decoded(codes: Column) -> Column:
    return F.transform(codes, lambda c: half_value(c.cast("int").bitwiseAND(0xFFFF)))
