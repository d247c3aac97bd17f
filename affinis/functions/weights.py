"""Weights of rare matches, cosine, bit vectors: Column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear(r: Column) -> Column:
    return 1 + r


def proportional(r: Column) -> Column:
    return 2 * r


def quadratic(r: Column) -> Column:
    return 1 + r * r


def sigmoid(r: Column, slope: float = 10.0) -> Column:
    """A logistic curve from 1 at rarity 0 to 2 at rarity 1."""
    import math

    low, high = 1 / (1 + math.exp(slope / 2)), 1 / (1 + math.exp(-slope / 2))
    return 1 + (1 / (1 + F.exp(-slope * (r - 0.5))) - low) / (high - low)


def rarity(frequency: Column, most: Column) -> Column:
    return 1 - F.least(frequency / most, F.lit(1.0))


def mask(value: Column, width: int) -> Column:
    """The lowest ``width`` bits of a long."""
    return value.bitwiseAND(F.lit((1 << width) - 1))


def part(value: Column, high: int, low: int) -> Column:
    """Bits high..low of a long."""
    return mask(F.shiftrightunsigned(value, low), high - low + 1)


def reduction(op: str, value: Column, width: int) -> Column:
    """Reduces a bit vector to one bit: and, or, xor and their negations."""
    full = F.lit((1 << width) - 1)
    plain = {"and": value == full, "or": value != 0, "xor": F.bit_count(value) % 2 == 1}
    return (~plain[op[1:]] if op[0] == "n" else plain[op]).cast("int")
