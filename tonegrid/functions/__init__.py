"""Column functions of the musical grid; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def resampled(ticks: Column, tpq: Column, target: int) -> Column:
    """Ticks on a grid of `target` a quarter, rounded half to even."""
    return F.rint(ticks * F.lit(target) / tpq).cast("bigint")


def nearest(x: Column, values: list[float]) -> Column:
    """The value nearest to x; of two at equal distance the upper one. `values` rise and are few."""
    out = F.lit(values[-1])
    for low, high in reversed(list(zip(values, values[1:]))):
        out = F.when(x * 2 < F.lit(low + high), F.lit(low)).otherwise(out)
    return out


def velocity_bin(v: Column, values: list[int]) -> Column:
    """A velocity of the table: nearest by arithmetic where the table is evenly spaced by 4, else by comparison."""
    if [b - a for a, b in zip(values, values[1:])] == [4] * (len(values) - 1) and values[0] == 3:
        return (4 * F.greatest(F.lit(1), F.floor((v + 3) / 4)) - 1).cast("bigint")
    return nearest(v, values).cast("bigint")


def nearest_bin(x: Column, values: list[int]) -> Column:
    """nearest() for whole numbers in tables of any length: a search in an array literal of the table."""
    table = F.array(*[F.lit(int(v)).cast("bigint") for v in values])
    x = x.cast("bigint")
    return F.aggregate(table, table[0], lambda best, v: F.when(F.abs(v - x) <= F.abs(best - x), v).otherwise(best))


def span_name(n: Column, spans: list[tuple[int, str]]) -> Column:
    """The value of a duration or shift of n positions; of several names of equal length the first. Null for other lengths."""
    names: dict[int, str] = {}
    for length, name in spans:
        names.setdefault(length, name)
    table = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    return table[n.cast("int")]


def greedy(n: Column, lengths: list[int]) -> Column:
    """n as the array of the largest lengths that still fit, one after the other; what is below the least length is dropped."""
    table = sorted(set(lengths), reverse=True)
    top, out = table[0], F.array().cast("array<bigint>")
    n = n.cast("bigint")
    times = F.floor(n / F.lit(top)).cast("int")
    start = F.struct(F.array_repeat(F.lit(top).cast("bigint"), times).alias("out"), (n - times * F.lit(top)).alias("left"))
    rest = F.array(*[F.lit(x).cast("bigint") for x in table[1:]])
    step = lambda acc, v: F.struct(F.when(acc["left"] >= v, F.concat(acc["out"], F.array(v))).otherwise(acc["out"]).alias("out"), F.when(acc["left"] >= v, acc["left"] - v).otherwise(acc["left"]).alias("left"))
    return F.when(n > 0, F.aggregate(rest, start, step)["out"]).otherwise(out)


def uniform(seed: int, *columns: Column | str) -> Column:
    """A number in [0, 1) that depends on seed and columns alone: the first 32 bits of their md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
