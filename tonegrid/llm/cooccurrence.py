"""Ids that occur together in a record (p2)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.llm.hashing import flat
from tonegrid.llm.records import key_hash, salts

#: Up to so many distinct ids in a task, pairs are counted in a square matrix; beyond it, as sorted lists.
DENSE = 2048
#: Pairs that a task holds in lists before it hands them on.
HELD = 4_000_000


class PairCounts:
    """Weighted counts of the pairs (a <= b) of ids of distinct baskets; the pair (a, a) counts the id itself."""

    def __init__(self):
        self.names = np.empty(0, np.int64)
        self.square = np.zeros((0, 0), np.int64)
        self.lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> None:
        """ids: the sorted distinct ids of each basket, one after the other."""
        names = np.union1d(self.names, ids)
        if len(names) <= DENSE:
            if len(names) > len(self.names):
                wider = np.zeros((len(names), len(names)), np.int64)
                at = np.searchsorted(names, self.names)
                wider[np.ix_(at, at)] = self.square
                self.names, self.square = names, wider
            there = np.zeros((len(weight), len(names)), np.float64)
            there[np.repeat(np.arange(len(weight)), np.diff(offsets)), np.searchsorted(names, ids)] = 1
            self.square += np.rint((there * weight[:, None]).T @ there).astype(np.int64)
            return
        for i, w in enumerate(weight):
            own = ids[offsets[i] : offsets[i + 1]]
            a, b = np.triu_indices(len(own))
            self.lists.append((own[a], own[b], np.full(len(a), w)))
            self.held += len(a)
            if self.held > HELD:
                self._fold()

    def _fold(self) -> None:
        a, b, n = (np.concatenate(x) for x in zip(*self.lists))
        order = np.lexsort((b, a))
        a, b, n = a[order], b[order], n[order]
        starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        self.lists = [(a[starts], b[starts], np.add.reduceat(n, starts))]
        self.held = len(starts)

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        a, b = np.nonzero(np.triu(self.square))
        yield self.names[a], self.names[b], self.square[a, b]
        if self.lists:
            self._fold()
            yield self.lists[0]
        self.__init__()


def pair_counts(df: DataFrame, record: Sequence[str], ids: str) -> DataFrame:
    """(id_a, id_b, n): in how many records two ids stand together; id_a < id_b. Rows with id_a = id_b have the records of one id, the
    row with both null the number of records.

    Each record's ids become a basket: its distinct ids, sorted. Equal baskets meet (a hot one in salts() groups, so that it isn't one task) and are collapsed into one
    with a weight; pairs are enumerated once for each distinct basket, and weights are summed within the task before the shuffle.
    Rows that come twice with the same record columns count once. Null or empty ids make no record; null ids in a list are left out.
    """
    basket = F.array_sort(F.array_distinct(F.filter(ids, lambda x: x.isNotNull())))
    d = df.where(F.size(ids) > 0).select(key_hash(record).alias("_r"), basket.alias("_ids"))
    d = d.select(F.xxhash64("_ids").alias("_h"), "_r", "_ids", F.xxhash64(F.lit(7), "_ids").alias("_h2"))  # equal baskets: 128 bits
    d = d.repartition(F.col("_h"), F.pmod("_r", F.lit(salts(df, 8)))).sortWithinPartitions("_h", "_h2", "_r")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, records, last = PairCounts(), 0, (None, None, None)
        for whole in it:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                h, r, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
                new = np.concatenate([[(h[0], h2[0], r[0]) != last], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1]) | (r[1:] != r[:-1])])
                last = h[-1], h2[-1], r[-1]
                kept = np.flatnonzero(new)  # each record once
                if not len(kept):
                    continue
                records += len(kept)
                values, offsets = flat(batch.column(2))
                h, h2 = h[kept], h2[kept]
                starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]))
                weight = np.diff(np.append(starts, len(kept)))
                rows = kept[starts]
                lengths = offsets[rows + 1] - offsets[rows]
                ends = np.cumsum(lengths)
                pick = np.repeat(offsets[rows] - (ends - lengths), lengths) + np.arange(ends[-1])
                counts.add(values[pick].astype(np.int64), np.concatenate([[0], ends]), weight.astype(np.int64))
                if counts.held > HELD // 2:
                    yield from (made(*x) for x in counts.rows())
        yield from (made(*x) for x in counts.rows())
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int32()), pa.array([None], pa.int32()), pa.array([records], pa.int64())], ["id_a", "id_b", "n"])

    def made(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n.astype(np.int64))], ["id_a", "id_b", "n"])

    return d.mapInArrow(batches, "id_a int, id_b int, n bigint").groupBy("id_a", "id_b").agg(F.sum("n").alias("n"))


def scored(counts: DataFrame) -> DataFrame:
    """(id_a, id_b, n_ab, n_a, n_b, n_records, lift, conviction) of each pair of pair_counts().

    lift: n_ab * n_records / (n_a * n_b). conviction of id_a => id_b: (1 - n_b / n_records) / (1 - n_ab / n_a), null where n_ab = n_a.
    """
    one = counts.where("id_a = id_b").select(F.col("id_a").alias("id"), "n")
    total = counts.where("id_a is null").select(F.col("n").alias("n_records"))
    pairs = counts.where("id_a < id_b").select("id_a", "id_b", F.col("n").alias("n_ab"))
    pairs = pairs.join(one.toDF("id_a", "n_a"), "id_a").join(one.toDF("id_b", "n_b"), "id_b")
    pairs = pairs.withColumn("n_records", total.scalar())  # a single row
    lift = F.col("n_ab") * F.col("n_records") / (F.col("n_a") * F.col("n_b"))
    left = 1 - F.col("n_ab") / F.col("n_a")
    return pairs.withColumn("lift", lift).withColumn("conviction", F.when(left > 0, (1 - F.col("n_b") / F.col("n_records")) / left))
