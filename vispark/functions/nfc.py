"""Unicode normal form C, which Spark has no built-in for: an Arrow function, over whole batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Texts in normal form C; nulls stay."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")
