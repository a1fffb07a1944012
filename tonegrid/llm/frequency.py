"""How often each distinct term occurs, and in how many records (p1)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.llm.records import key_hash, salts

#: Distinct terms that one task holds; at more it hands on its counts and begins anew, which changes no sum.
HELD = 500_000


class LastSeen:
    """Counters of terms over records that come one after the other: occurrences, records, and the last record seen.

    Since a record's terms are counted before the next record's, comparing with the last record is enough; no set of records is kept.
    """

    def __init__(self):
        self.place: dict[str, int] = {}
        self.times = self.records = self.last = np.empty(0, np.int64)

    def add(self, terms: pa.Array, record: np.ndarray) -> None:
        """terms without nulls, and the number of each one's record; numbers never fall, also from call to call."""
        coded = terms.dictionary_encode()
        place = np.array([self.place.setdefault(t, len(self.place)) for t in coded.dictionary.to_pylist()], np.int64)
        grow = len(self.place) - len(self.times)
        self.times, self.records = (np.concatenate([x, np.zeros(grow, np.int64)]) for x in (self.times, self.records))
        self.last = np.concatenate([self.last, np.full(grow, -1, np.int64)])
        if not len(place):
            return
        code = place[coded.indices.to_numpy(zero_copy_only=False)]
        order = np.argsort(code, kind="stable")
        code, record = code[order], record[order]
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        before = np.empty_like(record)
        before[1:] = record[:-1]
        before[starts] = self.last[code[starts]]
        new = np.add.reduceat((before != record).astype(np.int64), starts)
        ends = np.append(starts[1:], len(code))
        at = code[starts]
        self.times[at] += ends - starts
        self.records[at] += new
        self.last[at] = record[ends - 1]

    def rows(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(self.place), pa.string()), pa.array(self.times), pa.array(self.records)], ["term", "occurrences", "records"])


def of_lists(df: DataFrame, terms: str) -> DataFrame:
    """(term, occurrences, records) of a column of term lists, a row being a record; each record must come once.

    Counted where the rows are, so that a term of a third of all records costs one row a task; the sums are made after a shuffle of counts.
    Null terms are left out. The row whose term is null has in `records` the number of rows whose list is neither null nor empty.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = LastSeen(), 0
        for batch in it:
            lists = batch.column(0)
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            record = np.repeat(np.arange(rows, rows + len(lengths)), lengths)
            flat = lists.flatten()
            if flat.null_count:
                there = flat.is_valid()
                record, flat = record[there.to_numpy(zero_copy_only=False)], flat.filter(there)
            seen.add(flat, record)
            rows += len(lengths)
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([int((lengths > 0).sum())], pa.int64())], ["term", "occurrences", "records"])
            if len(seen.place) > HELD:
                yield seen.rows()
                seen = LastSeen()
        yield seen.rows()

    counts = df.select(terms).mapInArrow(batches, "term string, occurrences bigint, records bigint")
    return counts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def of_rows(df: DataFrame, record: Sequence[str], position: str, term: str) -> DataFrame:
    """(term, occurrences, records) of rows that each hold one term at a position of a record; rows that come twice count once.

    Rows are partitioned by term (and, for hot terms, by a hash of the record) and ordered by record; each row is compared with the
    row before it, which holds the last record seen. Rows with a null term are left out; null record columns are values of their own.
    """
    salt = F.pmod(key_hash(record), F.lit(salts(df))).cast("int")
    d = df.where(F.col(term).isNotNull()).select(F.col(term).alias("term"), salt.alias("_salt"), F.struct(*record).alias("_record"), F.col(position).alias("_at"))
    seen = Window.partitionBy("term", "_salt").orderBy("_record", "_at")
    d = d.withColumn("_same", F.lag("_record").over(seen).eqNullSafe(F.col("_record")) & (F.row_number().over(seen) > 1))
    d = d.withColumn("_twice", F.col("_same") & F.lag("_at").over(seen).eqNullSafe(F.col("_at")))
    per = d.groupBy("term", "_salt").agg(F.sum((~F.col("_twice")).cast("bigint")).alias("occurrences"), F.sum((~F.col("_same")).cast("bigint")).alias("records"))
    return per.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, total: DataFrame, rare_below: int, common_above: float) -> DataFrame:
    """Adds `mark` to counts: 'rare' for a term in fewer than rare_below records, else 'common' for one in more than the share
    common_above of the records of its field, else 'useful'. total: (field, n_records), one row for each field of `counts`."""
    d = counts.join(total, "field")  # broadcast if its size is small, as it is with few fields
    few, many = F.col("records") < rare_below, F.col("records") > F.col("n_records") * F.lit(common_above)
    return d.withColumn("mark", F.when(few, "rare").when(many, "common").otherwise("useful"))
