"""Cutting oversized sequences at natural boundaries (p4)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tonegrid.llm.hashing import flat

#: Segments on either side of a boundary whose contents are compared.
BLOCKS = 4


def cohesion(ids: np.ndarray, cuts: np.ndarray, blocks: int = BLOCKS) -> np.ndarray:
    """The depth of the similarity valley at each cut: how far the cosine similarity of the `blocks` segments before and after the cut
    lies below the nearest peaks on either side. A cut is the position of the first id of a segment."""
    if not len(cuts):
        return np.empty(0)
    names, code = np.unique(ids, return_inverse=True)
    bounds = np.concatenate([[0], cuts, [len(ids)]])
    segment = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    similar = np.empty(len(cuts))
    for at in range(0, len(cuts), 256):  # a window of segments at a time
        low, high = max(0, at + 1 - blocks), min(len(bounds) - 1, at + 256 + blocks)
        own = slice(bounds[low], bounds[high])
        counts = np.zeros((high - low + 1, len(names)), np.float32)
        np.add.at(counts, (segment[own] - low + 1, code[own]), 1)
        sums = np.cumsum(counts, axis=0)
        for i in range(at, min(at + 256, len(cuts))):
            mid = i + 1 - low
            left = sums[mid] - sums[max(0, mid - blocks)]
            right = sums[min(mid + blocks, high - low)] - sums[mid]
            norm = np.sqrt((left @ left) * (right @ right))
            similar[i] = left @ right / norm if norm else 0
    depth = np.zeros(len(cuts))
    for side in (1, -1):
        x = similar[::side]
        peak = x.copy()
        for i in range(1, len(x)):  # climb while similarity rises away from the cut
            peak[i] = max(x[i], peak[i - 1]) if x[i - 1] >= x[i] else x[i]
        depth += (peak - x)[::side]
    return depth


def pieces(n: int, most: int, overlap: int, cuts: np.ndarray, depth: np.ndarray | None = None) -> list[tuple[int, int]]:
    """First and last position of each piece of n ids. A piece ends right before the deepest of the cuts that leave it more than
    `overlap` and at most `most` ids, the last of equally deep ones; without one it has `most` ids. The rest is one piece once it fits.
    With depths, cuts are looked for in the upper half of what is in reach first, so that a piece advances by half of what it could, or more."""
    out, start = [], 0
    while n - start > most:
        low, high = np.searchsorted(cuts, [start + overlap + 1, start + most + 1])
        if low == high:
            end = start + most
        elif depth is None:
            end = int(cuts[high - 1])
        else:
            upper = int(np.searchsorted(cuts, start + overlap + (most - overlap + 1) // 2))
            low = upper if upper < high else low
            own = depth[low:high]
            end = int(cuts[high - 1 - int(np.argmax(own[::-1]))])
        out.append((start, end - 1))
        start = end - overlap
    return [*out, (start, n - 1)]


def split_oversized(
    df: DataFrame, record: Sequence[str], ids: str, configs: Sequence[tuple[str, int, int]], boundary: int, by_cohesion: bool = True
) -> DataFrame:
    """(config_name, *record, piece_no, first_pos, last_pos): the pieces of each list longer than a configuration's limit.

    configs: (name, largest length, overlap), overlap below the length. A list may be cut before any id `boundary`. by_cohesion: valleys
    of lexical cohesion tell the cuts apart and the deepest in reach is taken; else all cuts are equally deep, and the last in reach is.
    A list is cut where it is read, without a shuffle; only the positions of the pieces are shuffled, to drop those of rows that
    came twice. Null and short lists give no rows; null ids are ids like others.
    """
    for name, most, overlap in configs:
        if not 0 <= overlap < most:
            raise ValueError(f"{name}: the overlap must be less than the length")
    record = list(record)
    names = [f"r{i}" for i in range(len(record))]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            values, offsets = flat(batch.column(len(record)))
            of, config, first, last, number = [], [], [], [], []
            for row in range(batch.num_rows):
                own = values[offsets[row] : offsets[row + 1]]
                cuts = depth = None
                for name, most, overlap in configs:
                    if len(own) <= most:
                        continue
                    if cuts is None:
                        cuts = np.flatnonzero(own == boundary)
                        cuts = cuts[cuts > 0]
                        depth = cohesion(own, cuts) if by_cohesion else None
                    made = pieces(len(own), most, overlap, cuts, depth)
                    of += [row] * len(made)
                    config += [name] * len(made)
                    number += range(1, len(made) + 1)
                    first += [a for a, _ in made]
                    last += [b for _, b in made]
            rows = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(config, pa.string()), *[batch.column(i).take(rows) for i in range(len(record))], *[pa.array(x, pa.int32()) for x in (number, first, last)]],
                ["config_name", *names, "piece_no", "first_pos", "last_pos"],
            )

    least = min((most for _, most, _ in configs), default=0)
    types = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, record))
    made = df.where(f"size({ids}) > {least}").select(*record, ids).mapInArrow(batches, f"config_name string, {types}, piece_no int, first_pos int, last_pos int")
    return made.toDF("config_name", *record, "piece_no", "first_pos", "last_pos").distinct()
