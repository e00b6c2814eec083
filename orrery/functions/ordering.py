"""Order-preserving integers for floating-point columns, in native expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the IEEE 754 double format.
MANTISSA_BITS = 52
EXPONENT_BIAS = 1023
TWO_52 = 4503599627370496


def ordered_bits(value: Column) -> Column:
    """A bigint whose order is that of the finite double ``value``.

    For a value >= 0 it is the number's IEEE bit pattern, for one below zero the complement of the pattern of its
    magnitude. Null, NaN and infinite values give null. The pattern is computed with exact scalings by powers of
    two, so the expression stays inside generated code.
    """
    v = value.cast("double")
    a = F.abs(v)
    guess = F.floor(F.log2(a))
    low = F.pow(F.lit(2.0), guess)
    exponent = F.when(a < low, guess - 1).when(a >= low * 2, guess + 1).otherwise(guess)
    exponent = F.least(F.greatest(exponent, F.lit(-1022)), F.lit(1023))
    scaled = a / F.pow(F.lit(2.0), exponent)
    normal = (exponent + EXPONENT_BIAS).cast("bigint") * F.lit(TWO_52) + ((scaled - 1.0) * float(TWO_52)).cast("bigint")
    # below 2**-1022 the pattern is the value in units of 2**-1074, which takes two exact steps
    small = (a * float(2.0**537) * float(2.0**537)).cast("bigint")
    bits = F.when(a == 0, F.lit(0).cast("bigint")).when(a < float(2.0**-1022), small).otherwise(normal)
    return F.when(v.isNull() | F.isnan(v) | (a == float("inf")), F.lit(None).cast("bigint")).when(v < 0, -bits - 1).otherwise(bits)


def from_ordered_bits(key: Column) -> Column:
    """The double whose ``ordered_bits`` is ``key``."""
    bits = F.when(key < 0, -(key + 1)).otherwise(key)
    exponent = F.shiftright(bits, MANTISSA_BITS)
    fraction = (bits.bitwiseAND(F.lit(TWO_52 - 1))).cast("double")
    normal = (fraction / float(TWO_52) + 1.0) * F.pow(F.lit(2.0), exponent - EXPONENT_BIAS)
    size = F.when(exponent == 0, fraction * F.lit(5e-324)).otherwise(normal)
    return F.when(key < 0, -size).otherwise(size)
