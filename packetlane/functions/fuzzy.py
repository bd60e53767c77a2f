"""Ratcliff-Obershelp similarity, which has no built-in form, as a vectorised UDF."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: str | None, b: str | None) -> float:
    return SequenceMatcher(None, a or "", b or "").ratio()


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The order of the two matters."""
    memo: dict = {}
    return pd.Series([memo[k] if (k := (x, y)) in memo else memo.setdefault(k, ratio(x, y)) for x, y in zip(a, b, strict=True)], dtype=float)


def ratio_possible(a: Column, b: Column, least: float) -> Column:
    """A bound on the ratio from lengths alone; filter by it before the UDF."""
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))
