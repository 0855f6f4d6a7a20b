"""Logarithms and powers of e as the C library gives them, bit for bit.

Ranks hang on the last bit of a score. Spark computes these functions with StrictMath, whose last bit is another one for two to four
arguments in a hundred; DuckDB and Python call the C library.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


@F.pandas_udf(ArrayType(DoubleType()))
def ln(xs: pd.Series) -> pd.Series:
    """Of each value of a list: lists keep rows that are dealt by a key from being dealt again after Python."""
    return xs.map(lambda x: [math.log(v) for v in x])


@F.pandas_udf(DoubleType())
def log10(x: pd.Series) -> pd.Series:
    return x.map(math.log10)


@F.pandas_udf(DoubleType())
def exp(x: pd.Series) -> pd.Series:
    return x.map(math.exp)
