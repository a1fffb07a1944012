"""Filling containers of a fixed capacity with items (p6)."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.llm.records import key_hash

#: Items that are packed together: rows are drawn from so many items, and each such lot leaves at most about one row partly filled.
LOT = 2048


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Karmarkar-Karp: the container 0..k-1 of each item so that the k sums are nearly equal.

    Partial partitions (at first one for each item) are merged two at a time, those with the largest spread first, the fullest
    containers of one with the emptiest of the other. A partition holds only its containers in use, sorted by falling sums.
    """
    n = len(sizes)
    parent = np.arange(n)  # an item's container is that of its root
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    parts = {i: (np.array([s], np.int64), np.array([i])) for i, s in enumerate(sizes)}
    fresh = n
    while len(heap) > 1:
        _, x = heapq.heappop(heap)
        _, y = heapq.heappop(heap)
        (a, ra), (b, rb) = parts.pop(x), parts.pop(y)
        over = max(0, len(a) + len(b) - k)  # the emptiest `over` of a take the emptiest `over` of b, the other way round
        if over:
            parent[rb[len(b) - over :][::-1]] = ra[len(a) - over :]
            a = a.copy()
            a[len(a) - over :] += b[len(b) - over :][::-1]
            b, rb = b[: len(b) - over], rb[: len(rb) - over]
        sums, roots = np.concatenate([a, b]), np.concatenate([ra, rb])
        order = np.argsort(-sums, kind="stable")
        parts[fresh] = sums, roots = sums[order], roots[order]
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), fresh))
        fresh += 1
    while True:
        up = parent[parent]
        if (up == parent).all():
            break
        parent = up
    return np.unique(parent, return_inverse=True)[1]


def level(sizes: np.ndarray, box: np.ndarray, k: int, capacity: int) -> np.ndarray:
    """Brings containers above the capacity below it, where an item of theirs may change places with a smaller one, or with none, of a
    container that has room for the difference. Each time, the change that leaves the least room is taken."""
    box = box.copy()
    sums = np.bincount(box, weights=sizes, minlength=k).astype(np.int64)
    none = np.arange(len(sizes), len(sizes) + k)  # an empty place in each container
    size_at, box_at = np.concatenate([sizes, np.zeros(k, np.int64)]), np.concatenate([box, np.arange(k)])
    for over in np.argsort(-sums, kind="stable"):
        if sums[over] <= capacity:
            break
        excess, best = sums[over] - capacity, None
        room = capacity - sums[box_at]
        for x in np.flatnonzero(box == over):
            more = sizes[x] - size_at
            left = np.where((more >= excess) & (more <= room), room - more, capacity + 1)
            y = int(np.argmin(left))
            if left[y] <= capacity and (best is None or left[y] < best[0]):
                best = left[y], x, y
        if best:
            _, x, y = best
            other = box_at[y]
            more = sizes[x] - size_at[y]
            box[x] = box_at[x] = other
            if y < len(sizes):
                box[y] = box_at[y] = over
            sums[over] -= more
            sums[other] += more
    return box


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Items by falling size, each into the container with the least room that holds it."""
    box, room, n = np.zeros(len(sizes), np.int64), [], 0  # room: (places left, container), sorted
    for i in np.argsort(-sizes, kind="stable"):
        at = bisect_left(room, (int(sizes[i]), -1))
        left, own = room.pop(at) if at < len(room) else (capacity, n)
        n += own == n
        box[i] = own
        insort(room, (left - int(sizes[i]), own))
    return box


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A container for each item, none above the capacity: by partition(), or by best_fit() where that needs fewer containers."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    return min(partition(sizes, capacity), best_fit(sizes, capacity), key=lambda box: box.max())


def partition(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """A container for each item, none above the capacity; sizes between 1 and capacity.

    Differencing with as few containers as the sum allows, then level(). If some still exceed the capacity, their items and those of
    the emptiest containers are partitioned again, with more containers whenever that helped too little.
    """
    out = np.zeros(len(sizes), np.int64)
    rest, names, fresh = np.arange(len(sizes)), None, 0
    k = -(-int(sizes.sum()) // capacity)
    while len(rest):
        k = min(k, len(rest))
        box = level(sizes[rest], differencing(sizes[rest], k), k, capacity)
        names = np.concatenate([names, np.arange(fresh, fresh + k - len(names))]) if names is not None else np.arange(k)
        fresh = max(fresh, int(names.max()) + 1)
        out[rest] = names[box]
        sums = np.bincount(out, weights=sizes, minlength=fresh)
        over = np.flatnonzero(sums > capacity)
        if not len(over):
            break
        emptiest = np.argsort(sums, kind="stable")[: len(over) + 2]
        names = np.union1d(over, emptiest)
        rest = np.flatnonzero(np.isin(out, names))
        k = len(names) + max(1, -(-int((sums[over] - capacity).sum()) // capacity))
    return np.unique(out, return_inverse=True)[1]


def fill_rows(df: DataFrame, record: Sequence[str], size: str, configs: Sequence[tuple[str, int]], lots: int) -> DataFrame:
    """(config_name, *record, piece_no, first_pos, n_ids, row_id, row_ids, padding): where the ids of each record go.

    configs: (name, capacity). A record longer than the capacity is cut: it fills whole rows, and what is left of it is an item like
    others; no other record is split. Items are dealt to `lots` lots by a hash (see LOT), each lot is packed on its own, and row_id
    is unique in its configuration. row_ids and padding are the filled and the free places of the row.
    Sizes that are null or below 1 take no place. Each record must come once; a hot record is one row here, however long it is.
    """
    record = list(record)
    names = [f"r{i}" for i in range(len(record))]
    items = df.where(f"{size} > 0").select(*[F.col(c).alias(n) for c, n in zip(record, names)], F.col(size).cast("bigint").alias("n"))
    each = F.array(*[F.struct(F.lit(name).alias("config"), F.lit(capacity).alias("capacity")) for name, capacity in configs])
    items = items.withColumn("lot", F.pmod(key_hash(names), F.lit(lots))).withColumn("c", F.explode(each)).select("c.*", "lot", *names, "n")

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", *names], ascending=False, ignore_index=True)
        capacity = int(pdf["capacity"].iloc[0])
        n = pdf["n"].to_numpy(np.int64)
        whole, left = n // capacity, n % capacity
        per = whole + (left > 0)
        at = np.repeat(np.arange(len(n)), per)
        number = np.arange(len(at)) - np.repeat(np.cumsum(per) - per, per)
        first = number * capacity
        size = np.minimum(n[at] - first, capacity)
        full = size == capacity
        row = np.empty(len(at), np.int64)
        row[full] = np.arange(full.sum())
        row[~full] = full.sum() + pack(size[~full], capacity)
        out = pdf[["config", *names]].iloc[at].reset_index(drop=True)
        filled = np.bincount(row, weights=size).astype(np.int64)[row] if len(row) else row
        return out.assign(piece_no=number + 1, first_pos=first, n_ids=size, row_id=row * lots + int(pdf["lot"].iloc[0]), row_ids=filled, padding=capacity - filled)

    kinds = [df.schema[c].dataType.simpleString() for c in record]
    schema = "config string, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds)) + ", piece_no bigint, first_pos bigint, n_ids bigint, row_id bigint, row_ids bigint, padding bigint"
    return items.groupBy("config", "lot").applyInPandas(rows, schema).toDF("config_name", *record, "piece_no", "first_pos", "n_ids", "row_id", "row_ids", "padding")
