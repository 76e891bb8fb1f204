"""Deterministic draws: the first 32 bits of an md5 over a tag and a key, the same in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(tag: str, key: str | Column) -> Column:
    """An integer in [0, 2^32) for each key."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat_ws("|", F.lit(tag), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def bucket(tag: str, key: str | Column, n: int) -> Column:
    return (draw(tag, key) % n).cast("long")
