"""Vectors in a byte a component, and back."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: bytes for half of the range from -1 to 1.
_HALF = 127.5


def u8_codes(vector: Column) -> Column:
    """Each component, held between -1 and 1, as a code from 0 to 255: array<int>. All in single precision."""
    one, half = F.lit(1.0).cast("float"), F.lit(_HALF).cast("float")
    code = lambda x: F.floor((F.least(F.greatest(x.cast("float"), -one), one) + one) * half).cast("int")
    return F.transform(vector, code)


def u8_values(codes: Column) -> Column:
    """The components that codes stand for: array<float>."""
    step, one = F.lit(1 / _HALF).cast("float"), F.lit(1.0).cast("float")
    return F.transform(codes, lambda c: c.cast("float") * step - one)
