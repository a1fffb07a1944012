"""Pairing of note-ons with note-offs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Events of a track that are folded together before their sums are carried on.
BLOCK = 1 << 16


#: Stands for null in a key column while events are grouped, as null keys form their own group.
NONE = -(1 << 31)


def note_events(raw: DataFrame) -> DataFrame:
    """Note events: score_id, track_idx, channel, pitch, ord, tick, velocity, on (1 for a note-on with velocity above 0, -1 for a note-off).

    Rows without ord, tick or pitch and rows of other types aren't note events and are left out.
    A null velocity of a NoteOn counts as 0, that is, as a note-off. Rows that come twice aren't removed here.
    """
    velocity = F.coalesce(F.col("velocity"), F.lit(0))
    on = F.when((F.col("event_type") == "NoteOn") & (velocity > 0), 1).otherwise(-1)
    e = raw.where(F.col("event_type").isin("NoteOn", "NoteOff") & F.col("ord").isNotNull() & F.col("tick").isNotNull() & F.col("pitch").isNotNull())
    return e.select("score_id", "track_idx", "channel", "pitch", "ord", "tick", velocity.alias("velocity"), on.alias("on"))


def pair_notes(raw: DataFrame, block: int = BLOCK, velocity: bool = True) -> DataFrame:
    """Pairs note-ons and note-offs of the same score, track, channel and pitch, first with first in ord order.

    A note-off with no open note-on is ignored; a note-on without a note-off lasts one tick, as does one closed at its own tick.
    The queue needs no fold: with +1 for an on and -1 for an off, an off is idle exactly where the running sum reaches a new
    minimum below 0, and the n-th on belongs to the n-th off that isn't idle. The sums run within blocks of `block` positions;
    of each block only its sum, its minimum and its number of ons go on to the next, and only notes that end in another block
    than theirs are shuffled again, so that one hot key isn't one task.

    Result: score_id, track_idx, channel, pitch, ord, tick, duration (>= 1), velocity (null unless asked for) of each note-on once.
    Null key columns form their own group. Repeated rows of (score_id, track_idx, ord) count once.
    """
    keys = ["score_id", "track_idx", "channel", "pitch"]
    e = note_events(raw) if velocity else note_events(raw).withColumn("velocity", F.lit(None).cast("int"))
    e = e.select(*[F.coalesce(F.col(k), F.lit(NONE)).alias(k) for k in keys], "ord", "tick", "velocity", "on")
    e = e.withColumn("_b", F.floor(F.col("ord") / F.lit(block)))
    by_block = Window.partitionBy(*keys, "_b").orderBy("ord")
    e = e.withColumn("_last", F.lag("ord").over(by_block)).where("_last is null or _last < ord").drop("_last")
    upto, above = by_block.rowsBetween(Window.unboundedPreceding, 0), by_block.rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_sum", F.sum("on").over(upto)).withColumn("_ons", F.sum((F.col("on") > 0).cast("int")).over(upto))
    e = e.withColumn("_min", F.min("_sum").over(upto)).withColumn("_past", F.min("_sum").over(above))

    tail = e.groupBy(*keys, "_b").agg(F.max_by("_sum", "ord").alias("_sum"), F.max("_ons").alias("_ons"), F.min("_sum").alias("_min"), F.max(F.struct("tick", "velocity")).alias("_x"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    tail = tail.withColumn("_s0", F.sum("_sum").over(earlier)).withColumn("_o0", F.sum("_ons").over(earlier))
    tail = tail.withColumn("_m0", F.min(F.coalesce("_s0", F.lit(0)) + F.col("_min")).over(earlier))
    # _x is there so that both sides need the same columns and one shuffle of the events serves both
    tail = tail.where("_s0 is not null and _x.tick is not null" + " and _x.velocity is not null" * velocity).select(*keys, "_b", "_s0", "_o0", "_m0")
    e = e.join(tail, [*keys, "_b"], "left")
    s0, o0, m0 = F.coalesce("_s0", F.lit(0)), F.coalesce("_o0", F.lit(0)), F.least(F.lit(0), F.coalesce("_m0", F.lit(0)))
    lowest, past = F.least(m0, s0 + F.col("_min")), F.least(m0, F.coalesce(s0 + F.col("_past"), F.lit(0)))
    ons = o0 + F.col("_ons")
    is_on = F.col("on") > 0
    e = e.where(is_on | (lowest == past))
    e = e.withColumn("_k", F.when(is_on, ons).otherwise(ons - (s0 + F.col("_sum")) + lowest))

    def paired(d: DataFrame, by: list[str]) -> DataFrame:
        return d.groupBy(*by).agg(F.max("_on_ord").alias("_on_ord"), F.max("_on_tick").alias("_on_tick"), F.max("_on_velocity").alias("_on_velocity"), F.max("_off").alias("_off"))

    e = e.select(*keys, "_b", "_k", *[F.when(is_on, F.col(c)).alias(f"_on_{c}") for c in ("ord", "tick", "velocity")], F.when(~is_on, F.col("tick")).alias("_off"))
    local = paired(e, [*keys, "_b", "_k"])
    closed = F.col("_on_tick").isNotNull() & F.col("_off").isNotNull()
    notes = local.where(closed).drop("_b", "_k").unionByName(paired(local.where(~closed), [*keys, "_k"]).where("_on_tick is not null").drop("_k"))
    return notes.select(
        *[F.when(F.col(k) != NONE, F.col(k)).alias(k) for k in keys], F.col("_on_ord").alias("ord"), F.col("_on_tick").alias("tick"),
        F.greatest(F.lit(1), F.coalesce(F.col("_off") - F.col("_on_tick"), F.lit(1))).alias("duration"), F.col("_on_velocity").alias("velocity"),
    )
