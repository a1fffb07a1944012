"""Records that share most of their content (p7)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonegrid.llm.graycode import FAN, GrayIndex
from tonegrid.llm.hashing import flat, mix, run_hashes, signed
from tonegrid.session import materialize

#: Bands of a signature and least hashes in a band: two sets of similarity 0.6 share a band with probability 1 - (1 - 0.6^3)^36 = 0.99984.
BANDS, ROWS = 36, 3
#: Bits in which the fingerprints of two members of a band may differ; of 108 bits, sets of similarity 0.6 differ in 21.6 on average, and in
#: more than 44 with probability 0.0000003; unrelated sets differ in 54 on average, and 97 % of them in more than 44.
LIMIT = 44
#: Members of a band that are compared in one go; a band with more is split into blocks of so many, and pairs of blocks are spread over the tasks.
BLOCK = 4096
#: Runs that are hashed at a time.
CHUNK = 1 << 16


def _sets(values: np.ndarray, offsets: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row's runs of k ids (k of the row; it goes into the hash), and how many each row has."""
    rows, hashes = [], []
    n = np.diff(offsets)
    for length in np.unique(k):
        h = run_hashes(values, int(length), int(length))
        if not len(h):
            continue
        row = np.repeat(np.arange(len(n)), n)[: len(h)]
        inside = (np.arange(len(h)) + length <= offsets[1:][row]) & (k[row] == length)
        rows.append(row[inside])
        hashes.append(h[inside])
    row = np.concatenate(rows) if rows else np.empty(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(n))


def _classes(h: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit names of each set, both equal for equal sets."""
    ends = np.cumsum(sizes)
    out = []
    for seed in (9, 13):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(h, seed), dtype=np.uint64)])
        out.append(mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64), seed + 2))
    return out


def _signature(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, BANDS) hashes, each of ROWS least values under different multiplications, and (rows, 2) words of a fingerprint, which has a bit of
    each least value; rows without elements are left out."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    small = (h >> np.uint64(32)).astype(np.uint32)
    seeds = mix(np.arange(2 * BANDS * ROWS), 77)
    factor = (seeds[::2] | np.uint64(1)).astype(np.uint32)
    plus = seeds[1::2].astype(np.uint32)
    out = np.empty((len(sizes), BANDS), np.uint64)
    bits = np.zeros((len(sizes), 2), np.uint64)
    for band in range(BANDS):
        code = np.full(len(sizes), band, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            least = np.minimum.reduceat(small * factor[i] + plus[i], starts).astype(np.uint64)
            code = mix(code ^ least, 5)
            bits[:, i // 64] |= (mix(least, 6) >> np.uint64(63)) << np.uint64(i % 64)
        out[:, band] = code
    return out, bits


def _pieces(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The rows of a batch, some at a time, with values and offsets of the list column `at`."""
    lengths = batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    cut = np.flatnonzero(np.diff(np.cumsum(lengths) // CHUNK, prepend=-1))
    for a, b in zip(cut, [*cut[1:], batch.num_rows]):
        part = batch.slice(a, b - a)
        yield part, *flat(part.column(at))


def gathered(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """(*keys, ids): the values of each key in order, as one array of INT; repeated rows count once, nulls in any of the columns are left out.

    The rows are sorted by the shuffle and pass by in order, so no array grows in the JVM; Python holds the values of one key, as 32-bit numbers.
    """
    keys = list(keys)
    d = rows.select(*keys, F.col(order).cast("bigint").alias("_o"), F.col(value).cast("int").alias("_v")).dropna()
    d = d.repartition(*keys).sortWithinPartitions(*keys, "_o", "_v")
    types = ", ".join(f"k{i} {rows.schema[c].dataType.simpleString()}" for i, c in enumerate(keys))

    def made(columns: list[list], held: list[list[np.ndarray]]) -> pa.RecordBatch:
        lists = [np.concatenate(parts) for parts in held]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).astype(np.int32)))
        return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, kinds)], ids], [*[f"k{i}" for i in range(len(keys))], "ids"])

    kinds: list[pa.DataType] = []

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []  # the row before, and the values of its key so far
        for batch in it:
            kinds[:] = [batch.column(i).type for i in range(len(keys))]
            own = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(keys) + 2)]
            same = [x[1:] == x[:-1] for x in own]
            new = np.concatenate([[last is None or any(x[0] != y for x, y in zip(own[: len(keys)], last))], ~np.logical_and.reduce(same[: len(keys)])])
            again = np.concatenate([[not new[0] and all(x[0] == y for x, y in zip(own, last))], np.logical_and.reduce(same)])
            last = [x[-1] for x in own]
            starts = np.flatnonzero(new)
            parts = [part[~twice] for part, twice in zip(np.split(own[-1], starts), np.split(again, starts))]
            if held:
                held[-1][1].append(parts[0])
            held += [([x[at] for x in own[: len(keys)]], [part]) for at, part in zip(starts, parts[1:])]
            if len(held) > 1:
                yield made([list(c) for c in zip(*[k for k, _ in held[:-1]])], [p for _, p in held[:-1]])
                held = held[-1:]
        if held:
            yield made([list(c) for c in zip(*[k for k, _ in held])], [p for _, p in held])

    return d.mapInArrow(batches, f"{types}, ids array<int>").toDF(*keys, "ids")


_MEMBER = "kind string, score_id bigint, idx int, n int, f0 bigint, f1 bigint"
_FOUND = "kind string, score_a bigint, idx_a int, score_b bigint, idx_b int, band bigint, block int, n int, f0 bigint, f1 bigint"


class _Members:
    """Some members of bands, as columns: kind, score_id, idx, n, f0, f1."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, first: int = 0):
        self.columns = [batch.column(first + i) for i in range(6)]
        self.n = self.columns[3].to_numpy().astype(np.int64)
        self.bits = np.stack([self.columns[i].to_numpy().view(np.uint64) for i in (4, 5)], axis=1)

    def found(self, x: np.ndarray, y: np.ndarray, ratio: tuple[int, int], other: _Members | None = None) -> pa.RecordBatch:
        """The pairs at places x (here) and y (there) whose sizes allow the similarity; the lesser name first, each pair once."""
        other, (up, down) = other or self, ratio
        a, b = self.n[x], other.n[y]
        kept = np.minimum(a, b) * down >= np.maximum(a, b) * up
        x, y = pa.array(x[kept]), pa.array(y[kept])
        kind, s, i, t, j = self.columns[0].take(x), *[c.take(x) for c in self.columns[1:3]], *[c.take(y) for c in other.columns[1:3]]
        s, i, t, j = (c.to_numpy() for c in (s, i, t, j))
        turn = (s > t) | ((s == t) & (i > j))
        return _found([kind, np.where(turn, t, s), np.where(turn, j, i), np.where(turn, s, t), np.where(turn, i, j)], len(s))

    def deferred(self, band: int, block: int) -> pa.RecordBatch:
        k = len(self.n)
        return _found([*self.columns[:3], None, None, np.full(k, band), np.full(k, block, np.int32), *self.columns[3:]], k)


def _found(columns: list, n: int) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    names = [x.split() for x in _FOUND.split(", ")]
    columns = columns + [None] * (len(names) - len(columns))
    made = [pa.nulls(n, kinds[t]) if c is None else pa.array(c, kinds[t]) if isinstance(c, np.ndarray) else c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c, (_, t) in zip(columns, names)]
    return pa.RecordBatch.from_arrays(made, [name for name, _ in names])


def _small_pairs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs inside groups of at most FAN rows."""
    first = np.repeat(starts, ends - starts)
    at = np.arange(len(first)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts) + first
    last = np.repeat(ends, ends - starts)
    x, y = [], []
    for step in range(1, FAN):
        inside = at + step < last
        x.append(at[inside])
        y.append(at[inside] + step)
    return np.concatenate(x), np.concatenate(y)


def _in_bands(bands: DataFrame, ratio: tuple[int, int]) -> DataFrame:
    """(kind, score_a, idx_a, score_b, idx_b): pairs of members of a band whose fingerprints are within LIMIT and whose sizes allow the similarity.

    bands: band and the columns of a member, each member once a band. Members pass by sorted by band. A band of up to BLOCK members is compared as it
    passes: through its GrayIndex, or, if it has no more than one leaf of it, directly. Of a larger one no pair is formed there: its members are
    handed on in blocks, and each pair of blocks is a task's work of its own.
    """

    def passing(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        blocks: dict[int, int] = {}  # the band that is being handed on, and how many blocks it has so far

        def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            band = rows.column(0).to_numpy()
            members = _Members(rows, 1)
            starts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]])) if len(band) else np.empty(0, np.int64)
            ends = np.append(starts[1:], len(band)).astype(np.int64)
            sizes = ends - starts
            few = (sizes > 1) & (sizes <= FAN)
            if few.any():
                x, y = _small_pairs(starts[few], ends[few])
                near = np.bitwise_count(members.bits[x] ^ members.bits[y]).sum(axis=1) <= LIMIT
                yield members.found(x[near], y[near], ratio)
            for a, b in zip(starts[sizes > FAN], ends[sizes > FAN]):
                for x, y in GrayIndex(members.bits[a:b]).pairs(LIMIT):
                    yield members.found(x + a, y + a, ratio)

        def ready(rows: pa.Table, end: bool) -> Iterator[pa.RecordBatch | pa.Table]:
            """What can be said of the rows so far; the last item is the table that is still held."""
            band = rows.column(0).to_numpy()
            while len(band):
                starts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
                sizes = np.diff(np.append(starts, len(band)))
                whole = end or len(starts) > 1  # whether the first band is complete
                if band[0] in blocks or sizes[0] > BLOCK:
                    if not whole and sizes[0] < BLOCK:
                        break
                    if band[0] not in blocks:
                        blocks.clear()
                    number, cut = blocks.get(band[0], 0), min(int(sizes[0]), BLOCK)
                    yield _Members(rows.slice(0, cut).combine_chunks(), 1).deferred(int(band[0]), number)
                    blocks[band[0]] = number + 1
                elif whole:
                    large = np.flatnonzero(sizes > BLOCK)
                    upto = large[0] if len(large) else len(starts) if end else len(starts) - 1
                    cut = len(band) if upto == len(starts) else int(starts[upto])
                    yield from compared(rows.slice(0, cut))
                else:
                    break
                rows, band = rows.slice(cut), band[cut:]
            yield rows

        for batch in it:
            rows = pa.Table.from_batches([batch])
            if held is not None and held.num_rows:
                rows = pa.concat_tables([held, rows])
            for made in ready(rows, False):
                if isinstance(made, pa.Table):
                    held = made
                else:
                    yield made
        if held is not None:
            for made in ready(held, True):
                if isinstance(made, pa.RecordBatch):
                    yield made

    def across(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of blocks: rows sorted by (band, i, j, block), a block being i or j."""
        held: list[pa.RecordBatch] = []

        def compared() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).combine_chunks()
            block = rows.column(3).to_numpy()
            i, j = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
            one = _Members(rows.filter(pa.array(block == i)).combine_chunks(), 4)
            if i == j:
                for x, y in GrayIndex(one.bits).pairs(LIMIT):
                    yield one.found(x, y, ratio)
                return
            two = _Members(rows.filter(pa.array(block == j)).combine_chunks(), 4)
            if len(one.n) and len(two.n):
                for x, y in GrayIndex(two.bits).pairs(LIMIT, one.bits):
                    yield one.found(x, y, ratio, two)

        key = None
        for batch in it:
            own = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
            for a, b in zip(starts, np.append(starts[1:], len(own))):
                if held and key != tuple(own[a]):
                    yield from compared()
                    held.clear()
                key = tuple(own[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from compared()

    names = ["kind", "score_id", "idx", "n", "f0", "f1"]
    met = bands.select("band", *names).repartition("band").sortWithinPartitions("band", "kind", "score_id", "idx")
    found = materialize(met.mapInArrow(passing, _FOUND))
    hot = found.where("band is not null").select("band", "block", "kind", F.col("score_a").alias("score_id"), F.col("idx_a").alias("idx"), "n", "f0", "f1")
    last = hot.groupBy("band").agg(F.max("block").alias("_last"))
    hot = hot.join(last, "band").withColumn("_other", F.explode(F.sequence(F.lit(0), "_last")))
    hot = hot.select("band", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", *names)
    hot = hot.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "block").mapInArrow(across, _FOUND)
    pair = ["kind", "score_a", "idx_a", "score_b", "idx_b"]
    return found.where("band is null").select(*pair).union(hot.select(*pair)).distinct()


def similar_classes(items: DataFrame, threshold: tuple[int, int] = (3, 5)) -> tuple[DataFrame, DataFrame]:
    """Classes of items with equal sets of runs, and the pairs of classes whose sets have a Jaccard similarity of at least threshold (numerator,
    denominator): members (kind, score_id, idx, class_score, class_idx), every item with a run once, its class being named after its least
    member; and alike (kind, score_a, idx_a, score_b, idx_b), pairs of class names, the lesser first.

    items: kind STRING, k INT (length of a run), score_id BIGINT, idx INT, ids ARRAY<INT>; rows of equal kind, score_id and idx are
    copies and count once. Items without a run have no class. Null ids in a list equal each other; items with a null in their key are left out.

    Only classes are compared, so copies make no work. Least-hash signatures bring classes that share a band together; inside a band, the
    fingerprints, which hold a bit of each least hash, are searched by an index in Gray order, and every pair within its limit is then
    compared exactly by the two whole sets. A pair is missed only if no band agrees: with probability 0.00016 at a similarity of 0.6, less than
    0.000001 from 0.75 on; or if the fingerprints of one of its bands differ too much, with probability 0.0000003 at 0.6. No partner is dropped.
    """
    up, down = threshold

    def signatures(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, values, offsets in _pieces(batch, 4):
                h, sizes = _sets(values, offsets, part.column(1).to_numpy(zero_copy_only=False))
                there = np.flatnonzero(sizes)
                if not len(there):
                    continue
                sizes = sizes[there]
                rows = pa.array(there)
                bands, bits = _signature(h, sizes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(there) * BANDS + 1, BANDS, dtype=np.int32)), pa.array(signed(bands.ravel())))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i).take(rows) for i in (0, 2, 3)], *[pa.array(signed(c)) for c in _classes(h, sizes)], pa.array(sizes.astype(np.int32)), lists, *[pa.array(signed(np.ascontiguousarray(bits[:, i]))) for i in (0, 1)]],
                    ["kind", "score_id", "idx", "c0", "c1", "n", "bands", "f0", "f1"],
                )

    def whole_sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part, values, offsets in _pieces(batch, 4):
                h, sizes = _sets(values, offsets, part.column(1).to_numpy(zero_copy_only=False))
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(signed(h)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), sets], ["kind", "score_id", "idx", "runs"])

    items = items.select("kind", "k", "score_id", "idx", "ids").where("kind is not null and k is not null and score_id is not null and idx is not null")
    named = materialize(items.mapInArrow(signatures, "kind string, score_id bigint, idx int, c0 bigint, c1 bigint, n int, bands array<bigint>, f0 bigint, f1 bigint"))
    same = ["kind", "c0", "c1", "n"]  # 128 bits of hash and the size
    least = F.min(F.struct("score_id", "idx")).alias("m")
    classes = named.groupBy(*same).agg(least, *[F.first(c).alias(c) for c in ("bands", "f0", "f1")])  # equal sets have equal signatures
    bands = classes.select(F.explode("bands").alias("band"), "kind", "m.score_id", "m.idx", "n", "f0", "f1")
    candidates = materialize(_in_bands(bands, threshold))

    wanted = candidates.select("kind", F.col("score_a").alias("score_id"), F.col("idx_a").alias("idx")).union(candidates.select("kind", "score_b", "idx_b")).distinct()
    sets = items.join(wanted, ["kind", "score_id", "idx"], "left_semi").select("kind", "k", "score_id", "idx", "ids").mapInArrow(whole_sets, "kind string, score_id bigint, idx int, runs array<bigint>").dropDuplicates(["kind", "score_id", "idx"])
    sets = materialize(sets)
    alike = candidates.join(sets.toDF("kind", "score_a", "idx_a", "runs_a"), ["kind", "score_a", "idx_a"]).join(sets.toDF("kind", "score_b", "idx_b", "runs_b"), ["kind", "score_b", "idx_b"])
    both = F.size(F.array_intersect("runs_a", "runs_b"))
    alike = alike.where(both * (up + down) >= (F.size("runs_a") + F.size("runs_b")) * up)  # both / union >= up / down
    members = named.select(*same, "score_id", "idx").distinct().join(named.groupBy(*same).agg(least), same)
    return (
        members.select("kind", "score_id", "idx", F.col("m.score_id").alias("class_score"), F.col("m.idx").alias("class_idx")),
        alike.select("kind", "score_a", "idx_a", "score_b", "idx_b"),
    )


def linked(items: DataFrame, threshold: tuple[int, int] = (3, 5)) -> DataFrame:
    """(kind, score_id, idx, class_score, class_idx, n_copies, n_links): every item with a run once, with the class of the items that have the same
    runs, how many those are (itself included), and with how many other items it is similar. No pair of copies is formed; see similar_classes()."""
    members, alike = similar_classes(items, threshold)
    name = ["kind", "class_score", "class_idx"]
    sizes = members.groupBy(*name).agg(F.count("*").alias("n_copies"))
    ways = alike.toDF("kind", "class_score", "class_idx", "to_score", "to_idx").union(alike.select("kind", "score_b", "idx_b", "score_a", "idx_a"))
    more = ways.join(sizes.toDF("kind", "to_score", "to_idx", "n"), ["kind", "to_score", "to_idx"]).groupBy(*name).agg(F.sum("n").alias("_more"))
    per = sizes.join(more, name, "left").select(*name, "n_copies", (F.col("n_copies") - 1 + F.coalesce("_more", F.lit(0))).alias("n_links"))
    return members.join(per, name).select("kind", "score_id", "idx", "class_score", "class_idx", "n_copies", "n_links")


def similar_pairs(items: DataFrame, threshold: tuple[int, int] = (3, 5)) -> DataFrame:
    """(kind, score_a, idx_a, score_b, idx_b): all pairs of items of a kind whose sets of runs have a Jaccard similarity of at least
    threshold; (score_a, idx_a) < (score_b, idx_b). The classes of similar_classes(), expanded: m copies give m * (m - 1) / 2 rows."""
    members, alike = similar_classes(items, threshold)
    first = members.select("kind", F.col("class_score").alias("score_a"), F.col("class_idx").alias("idx_a"), F.struct("score_id", "idx").alias("x"))
    second = members.select("kind", F.col("class_score").alias("score_b"), F.col("class_idx").alias("idx_b"), F.struct("score_id", "idx").alias("y"))
    across = alike.join(first, ["kind", "score_a", "idx_a"]).join(second, ["kind", "score_b", "idx_b"])
    within = first.join(second.toDF("kind", "score_a", "idx_a", "y"), ["kind", "score_a", "idx_a"]).where("x < y")
    pairs = across.select("kind", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).union(within.select("kind", "x", "y"))
    return pairs.select("kind", F.col("x.score_id").alias("score_a"), F.col("x.idx").alias("idx_a"), F.col("y.score_id").alias("score_b"), F.col("y.idx").alias("idx_b"))
