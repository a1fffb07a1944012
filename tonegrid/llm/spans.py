"""Long exact spans shared between records (p5)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonegrid.llm.hashing import flat, run_hashes, signed
from tonegrid.llm.records import key_hash

#: Rows that are hashed at a time.
ROWS = 1000


def _records(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    for at in range(0, batch.num_rows, ROWS):
        part = batch.slice(at, ROWS)
        values, offsets = flat(part.column(1))
        yield values, offsets, part


def _inside(offsets: np.ndarray, k: int, total: int) -> np.ndarray:
    """Whether the k ids from each position on lie in one record."""
    left = np.repeat(offsets[1:], np.diff(offsets))[: max(0, total - k + 1)]
    return np.arange(len(left)) + k <= left


def _anchors(h: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
    """Positions of the least hash of each `width` consecutive positions that lie inside one record: the last one of equal ones."""
    n = len(h) - width + 1
    if n < 1:
        return np.empty(0, np.int64)
    ok = inside[:n] & inside[width - 1 :]  # the first and the last run inside a record, and no record begins between them
    least, span = h.copy(), 1
    while span < width:  # minima of windows, doubling
        step = min(span, width - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    starts = np.flatnonzero(ok[:n])
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    chosen = []
    for at in range(0, len(starts), 1 << 16):
        s = starts[at : at + (1 << 16)]
        equal = view[s] == least[s, None]
        chosen.append(s + width - 1 - np.argmax(equal[:, ::-1], axis=1))
    return np.unique(np.concatenate(chosen)) if chosen else np.empty(0, np.int64)


def _packed(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The ids of each record in as few bytes each as its largest takes; the first byte says how many."""
    out = []
    for a, b in zip(offsets, offsets[1:]):
        own = values[a:b]
        size = 4 if own.min() < 0 or own.max() > 65535 else 2 if own.max() > 255 else 1
        out.append(bytes([size]) + own.astype(f"<{'i' if size == 4 else 'u'}{size}").tobytes())
    return out


def _unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    own = [np.frombuffer(p, f"<{'i' if p[0] == 4 else 'u'}{p[0]}", offset=1).astype(np.int32) for p in packed]
    return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])


SEEN = "route bigint, h bigint, h2 int, rec bigint, pos int, resolved boolean"


def _seen(h: np.ndarray, h2: np.ndarray, rec: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    """Rows of SEEN for one batch: hashes that already stand in two records of the batch are resolved here. They send one row to where
    their hash is decided, and their occurrences to where their record is; so a passage of a third of all records isn't one task."""
    order = np.lexsort((rec, h2, h))
    h, h2, rec, pos = h[order], h2[order], rec[order], pos[order]
    starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])])) if len(h) else np.empty(0, np.int64)
    ends = np.append(starts[1:], len(h))
    several = rec[starts] != rec[ends - 1] if len(h) else np.empty(0, bool)
    resolved = np.repeat(several, ends - starts)
    envoy = starts[several]
    take = np.concatenate([np.arange(len(h)), envoy])
    done = np.concatenate([resolved, np.zeros(len(envoy), bool)])
    where = np.where(done, rec[take], h[take])
    return pa.RecordBatch.from_arrays([pa.array(where), pa.array(h[take]), pa.array(h2[take]), pa.array(rec[take]), pa.array(pos[take]), pa.array(done)], SEEN.replace(",", "").split()[::2])


def _shared(seen: DataFrame) -> DataFrame:
    """(rec, pos) of the rows of SEEN whose hash stands in another record too.

    Rows meet by hash, sorted; while a group passes, only the rows of its first record are held, until a second record shows up.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple = ()
        owner, shared = 0, False
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in it:
            h, h2, rec, pos, done = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
            out_rec, out_pos = [rec[done]], [pos[done]]
            h, h2, rec, pos = (x[~done] for x in (h, h2, rec, pos))
            if len(h):
                starts = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]))
                ends = np.append(starts[1:], len(h))
                low, high = np.minimum.reduceat(rec, starts), np.maximum.reduceat(rec, starts)
                several = low != high
                if (h[0], h2[0]) == group:  # goes on from the batch before
                    if shared or several[0] or rec[0] != owner:
                        several[0] = True
                        for r, p in held:
                            out_rec.append(r)
                            out_pos.append(p)
                        held = []
                        shared = True
                else:
                    held, shared = [], False
                pick = np.repeat(several, ends - starts)
                out_rec.append(rec[pick])
                out_pos.append(pos[pick])
                tail = (h[-1], h2[-1])
                if len(starts) > 1 or tail != group:
                    if tail != group:
                        held = []
                    group, shared, owner = tail, bool(several[-1]), rec[-1]
                if not shared:
                    held.append((rec[starts[-1] :], pos[starts[-1] :]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_rec)), pa.array(np.concatenate(out_pos))], ["rec", "pos"])

    met = seen.repartition("route").sortWithinPartitions("h", "h2")
    return met.mapInArrow(batches, "rec bigint, pos int")


def shared_spans(df: DataFrame, record: Sequence[str], ids: str, least: int = 40) -> DataFrame:
    """(*record, first_pos, last_pos): the maximal unbroken stretches of each record covered by spans of `least` or more consecutive ids
    that stand, verbatim, in another record too.

    A span of `least` ids is shared exactly where its window of `least` ids is. Not all windows are shuffled: of each window, the half-length run
    with the least hash is its anchor, the same one wherever the window stands. Anchors that stand in one record only rule out all
    windows they stand for; the windows of the others are compared by 96 bits of hash. Both comparisons pass hashes on in sorted order
    and gather no group, and hashes that are common already within a batch are settled there.
    Rows that come twice with equal record columns are one record, also where a span occurs twice in it. Null ids equal each other.
    Records that are null, empty or shorter than `least` share nothing.
    """
    record = list(record)
    k = (least + 1) // 2
    width = least - k + 1
    d = df.where(F.size(ids) >= least).select(key_hash(record).alias("rec"), F.col(ids).alias("ids"), *record)

    def anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for values, offsets, part in _records(batch):
                h = run_hashes(values, k, 1)
                at = _anchors(h, _inside(offsets, k, len(values)), width)
                row = np.searchsorted(offsets, at, "right") - 1
                rec = part.column(0).to_numpy(zero_copy_only=False)[row]
                yield _seen(signed(h[at]), np.zeros(len(at), np.int32), rec, (at - offsets[row]).astype(np.int32))

    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for values, offsets, part in _records(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_packed(values, offsets), pa.binary())], ["rec", "ids"])

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                values, offsets = _unpacked(part.column(1).to_pylist())
                pos, starts = flat(part.column(2))
                n = np.diff(offsets)
                per = np.diff(starts)
                base, size = np.repeat(offsets[:-1], per), np.repeat(n, per)
                first, last = np.maximum(pos + k - least, 0), np.minimum(pos, size - least)
                edge = np.zeros(len(values) + 1, np.int64)
                np.add.at(edge, base + first, 1)
                np.add.at(edge, base + last + 1, -1)
                at = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
                h, h2 = (run_hashes(values, least, s) for s in (3, 5))
                row = np.searchsorted(offsets, at, "right") - 1
                rec = part.column(0).to_numpy(zero_copy_only=False)[row]
                yield _seen(signed(h[at]), signed(h2[at]).astype(np.int32), rec, (at - offsets[row]).astype(np.int32))

    found = _shared(d.select("rec", "ids").mapInArrow(anchors, SEEN))
    found = found.groupBy("rec").agg(F.collect_set("pos").alias("anchors"))  # at most the record's own positions
    likely = d.select("rec", "ids").mapInArrow(packed, "rec bigint, ids binary").join(found, "rec")
    shared = _shared(likely.mapInArrow(windows, SEEN))
    along = Window.partitionBy("rec").orderBy("pos")
    shared = shared.withColumn("_before", F.lag("pos").over(along))
    shared = shared.withColumn("_run", F.sum(F.when(F.col("pos") <= F.col("_before") + least, 0).otherwise(1)).over(along))
    spans = shared.groupBy("rec", "_run").agg(F.min("pos").alias("first_pos"), (F.max("pos") + least - 1).cast("int").alias("last_pos"))
    names = d.select("rec", *record).distinct()
    return spans.join(names, "rec").select(*record, "first_pos", "last_pos")


def coverage(df: DataFrame, spans: DataFrame, record: Sequence[str], ids: str) -> DataFrame:
    """(*record, n_ids, n_shared, share): how much of each record stands in its spans; every record once, n_shared 0 without spans."""
    record = list(record)
    sizes = df.where(F.size(ids) >= 0).groupBy(*record).agg(F.max(F.size(ids)).alias("n_ids"))
    held = spans.groupBy(*record).agg(F.sum(F.col("last_pos") - F.col("first_pos") + 1).alias("n_shared"))
    d = sizes.join(held, record, "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    return d.withColumn("share", F.when(F.col("n_ids") > 0, F.col("n_shared") / F.col("n_ids")).otherwise(0.0))
