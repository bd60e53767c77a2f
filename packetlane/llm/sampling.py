"""Bounded samples of labelled rows to fit a model on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARTS = 1_000_000


def crc_mod(column: Column, divisor: int) -> Column:
    return F.crc32(column.cast("string").cast("binary")) % F.lit(divisor)


def about(rows: DataFrame, key: str, most: int, n: int | None = None) -> DataFrame:
    """About `most` of the rows, chosen by a hash of the key (all, if there are fewer); the same ones each time."""
    n = rows.count() if n is None else n
    share = PARTS if n <= most else int(PARTS * most / n)
    return rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(PARTS)) < share)
