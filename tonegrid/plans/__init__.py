"""Queries over the driver's tables, one function for each name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonegrid.plans import effects, music, restored, sets, sound, streams


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": sound.p3_found, **music.QUERIES, **sets.QUERIES, **effects.QUERIES, **streams.QUERIES, **restored.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"p3_found": sound.P3_SQL, **music.SQL, **sets.SQL, **effects.SQL, **streams.SQL, **restored.SQL}
