"""Stable identifiers from text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over characters, eight hex digits."""
    h = F.aggregate(
        F.filter(_codes(text), lambda c: c > 0), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    )
    return F.lpad(F.lower(F.hex(h)), 8, "0")


def djb2(text: Column) -> Column:
    """32-bit djb2 (xor form) over characters, base 36."""
    h = F.aggregate(
        F.filter(_codes(text), lambda c: c > 0), F.lit(5381).cast("long"), lambda h, c: (h * 33).bitwiseXOR(c).bitwiseAND(F.lit(0xFFFFFFFF))
    )
    return F.lower(F.conv(h.cast("string"), 10, 36))


def external_id(name: Column, first_page: Column, last_page: Column) -> Column:
    return F.concat(F.lit("pdf:"), fnv1a(name), F.lit("#p"), first_page, F.lit("-"), last_page)
