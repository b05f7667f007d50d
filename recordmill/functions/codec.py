"""zlib columns.  Spark has no deflate expression, so these are Arrow-batched."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def compress(data: Column | str, level: int = 9) -> Column:
    @F.pandas_udf("binary")
    def pack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else zlib.compress(bytes(v), level))

    return pack(data)


def inflate(data: Column | str) -> Column:
    @F.pandas_udf("binary")
    def unpack(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else zlib.decompress(bytes(v)))

    return unpack(data)
