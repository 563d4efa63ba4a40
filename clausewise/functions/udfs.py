"""The two functions Spark has no built-in for, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode NFC form (used on file names and paths only)."""
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


@F.pandas_udf(T.DoubleType())
def match_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two short strings."""
    return pd.Series(
        [None if a is None or b is None else SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)],
        dtype="float64",
    )
