"""64-bit hashes held as signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hamming(a: Column, b: Column) -> Column:
    """The number of bits in which two longs differ; null if either is."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def band_bounds(bands: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each of ``bands`` bands of a 64-bit value."""
    edges = [b * 64 // bands for b in range(bands + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def band(value: Column, first: int, bits: int) -> Column:
    """The bits of a band as an unsigned number; all 64 bits are the value itself."""
    if bits == 64:
        return value
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def pack(flags: Column) -> Column:
    """An array of at most 64 booleans as a long, the first the lowest bit."""
    at = F.sequence(F.lit(0), F.size(flags) - 1)
    bits = F.transform(at, lambda i: F.when(F.get(flags, i), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(flags) > 0, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))).otherwise(F.lit(0).cast("long"))


def valid_hash(text: Column) -> Column:
    """The 32 bytes that a string names in hex, as lower-case hex; null if it doesn't name 32 bytes.

    The string is read in pairs of characters from its start. A pair that is no byte in hex is passed over (a plus
    sign before one digit counts as a byte), as is a last character that stands alone.
    """
    pairs = F.regexp_extract_all(text, F.lit("(?s)(..)"), F.lit(1))
    known = F.filter(pairs, lambda x: x.rlike(r"\A[0-9A-Fa-f+][0-9A-Fa-f]\z"))
    return F.when(F.size(known) == 32, F.lower(F.translate(F.array_join(known, ""), "+", "0")))
