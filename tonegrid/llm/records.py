"""Token sequences as records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def once(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key's row once, where rows that come twice have the same contents; works for columns of any type.

    Rows of a key meet in one partition, sorted, and all but the first are dropped; null is a key value of its own.
    """
    keys = list(keys)
    return df.withColumn("_once_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))).where("_once_n = 1").drop("_once_n")


def key_hash(keys: Sequence[str]) -> Column:
    """A 64-bit name of a key; a null is told apart from other values and from nulls of other columns."""
    return F.xxhash64(*[c for k in keys for c in (F.col(k).isNull(), F.col(k))])


def salts(df: DataFrame, share: int = 1) -> int:
    """Into how many groups a hot key is split: as many as a shuffle has partitions, divided by `share`, but 16 at least."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // share)
