"""Checksums of byte columns, as stored beside pages and overflowing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(value: Column) -> Column:
    """SHA-256 as lowercase hex."""
    return F.sha2(value, 256)


def crc(value: Column) -> Column:
    """CRC-32, unsigned."""
    return F.crc32(value)


def intact(value: Column, expected: Column) -> Column:
    """Whether a value still has its digest; null where there is no value."""
    return digest(value) == expected
