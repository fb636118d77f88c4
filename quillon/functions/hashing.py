"""A hash that any SQL engine can repeat: the first eight hex digits of md5('seed:tag:i')."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(i: str | Column, tag: str, seed: int = 0) -> Column:
    i = F.col(i) if isinstance(i, str) else i
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{tag}:"), i.cast("string"))), 1, 8), 16, 10).cast("bigint")


def uniform(i: str | Column, tag: str, seed: int = 0) -> Column:
    """In [0, 1)."""
    return hash32(i, tag, seed) / F.lit(float(1 << 32))


def bucket(i: str | Column, width: int, seed: int = 0) -> Column:
    return F.pmod(hash32(i, "b", seed), F.lit(width)).cast("int")


def sign(i: str | Column, seed: int = 0) -> Column:
    return (2 * F.pmod(hash32(i, "s", seed), F.lit(2)) - 1).cast("int")
