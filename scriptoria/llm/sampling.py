"""A repeatable sample whose size is bounded before anything reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 30


def hash_sample(df: DataFrame, by: list[str], rows: int, of: int, seed: str) -> DataFrame:
    """About ``rows`` of the ``of`` rows of ``df``, chosen by a hash of the columns ``by``; all of them if there are fewer.

    A filter, not a sort: tasks send only chosen rows, so what the driver gets does not grow with their number.
    """
    if of <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(SCALE)) < int(SCALE * rows / of))
