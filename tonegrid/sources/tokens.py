"""Token sequences as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "score_id bigint, seq_id int, ids array<int>, ids_encoded boolean, programs array<struct<program:int,is_drum:boolean>>"


def save_tokens(sequences: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes score_id, seq_id, ids, ids_encoded and programs, as far as there are such columns, a JSON object a line."""
    own = [c.split()[0] for c in SCHEMA.split(", ")]
    sequences.select(*[c for c in own if c in sequences.columns]).write.mode(mode).option("ignoreNullFields", "false").json(path)


def load_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Reads what save_tokens() wrote; the schema is given, nothing is inferred. Damaged lines have nulls in all columns."""
    return spark.read.schema(SCHEMA).json(path)
