"""64-bit FNV-1a as JVM expressions; products are taken in 32-bit halves, since ANSI arithmetic refuses overflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET = 0xCBF29CE484222325 - (1 << 64)
LOW = 0xFFFFFFFF
#: The prime is 2**40 + 435.
_REST = 435


def _step(h: Column, byte: Column) -> Column:
    low = h.bitwiseXOR(byte).bitwiseAND(F.lit(LOW))
    product = low * _REST
    high = (F.shiftrightunsigned(h, 32) * _REST + F.shiftrightunsigned(product, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(LOW))
    return F.shiftleft(high, 32).bitwiseOR(product.bitwiseAND(F.lit(LOW)))


def over_text(text: Column, h: Column | None = None) -> Column:
    """FNV-1a over the UTF-8 bytes of a text."""
    digits = F.hex(text.cast("binary"))
    one = lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    start = F.lit(OFFSET).cast("long") if h is None else h
    return F.when(F.length(digits) == 0, start).otherwise(F.aggregate(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), start, lambda a, i: _step(a, one(i))))


def over_long(value: Column, h: Column) -> Column:
    """Goes on with the eight bytes of a long, lowest first."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(7)), h, lambda a, i: _step(a, F.call_function("shiftrightunsigned", value, i * 8).bitwiseAND(F.lit(255))))


def base_signature(event_type: Column, domain: Column) -> Column:
    """Of type, a zero byte, domain, a zero byte."""
    zero = F.lit("\0")
    return over_text(F.concat(event_type, zero, domain, zero))


def lineage_signature(depth: int, base: Column, contributors: Column) -> Column:
    """Of depth, base, then the contributors' signatures in unsigned order."""
    lowest = F.lit(-(1 << 63)).cast("long")
    ordered = F.transform(F.array_sort(F.transform(contributors, lambda s: s.bitwiseXOR(lowest))), lambda s: s.bitwiseXOR(lowest))
    head = over_long(base, over_long(F.lit(depth).cast("long"), F.lit(OFFSET).cast("long")))
    return F.aggregate(ordered, head, lambda a, s: over_long(s, a))


def hexed(signature: Column) -> Column:
    return F.lower(F.lpad(F.hex(signature), 16, "0"))
