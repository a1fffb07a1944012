"""From a folder of MIDI files to a folder of token sequences or of training pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonegrid.config import DEFAULT, GridConfig
from tonegrid.operators import grammar, pipeline, preprocess, score, structure
from tonegrid.operators.pipeline import Switches
from tonegrid.sources import smf
from tonegrid.sources.tokens import save_tokens


def scores_of(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw events with score_id, and (score_id, path, tpq, error) of each file). A score's id is a hash of its path, the same on every run; files that can't be read
    have no events and keep their error. Two paths of one id would mix their events, so they raise an error."""
    name = F.xxhash64("path")
    files = events.groupBy("path").agg(F.max("tpq").alias("tpq"), F.max("error").alias("error")).select(name.alias("score_id"), "path", "tpq", "error")
    twice = files.groupBy("score_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError("two paths have the same id")
    return events.where("event_type is not null").withColumn("score_id", name).withColumn("loaded_at", F.lit(0)), files


def filtered(files: DataFrame, valid: Column | None = None) -> DataFrame:
    """The files that could be read and, with `valid`, those for which it holds. Nothing is deleted."""
    good = files.where("error is null and tpq > 0")
    return good if valid is None else good.where(valid)


def prepared_files(raw: DataFrame, files: DataFrame, switches: Switches = Switches(), config: GridConfig = DEFAULT) -> pipeline.Prepared:
    """pipeline.prepare() of the files of a folder; programs and drums of a track are those of its own events."""
    programs = score.programs(raw)
    tracks = programs.select("score_id", "track_idx", "program", (F.col("program") < 0).alias("is_drum"))
    return pipeline.prepare(
        score.notes(raw), files.select("score_id", "tpq"), tracks, score.time_signatures(raw), score.tempos(raw), score.pedals(raw), score.pitch_bends(raw), switches, config
    )


def tokenize_dataset(spark: SparkSession, folder: str, out: str, encode: Callable, vocab: DataFrame, switches: Switches = Switches(), valid: Column | None = None, pattern: str = "*.mid", config: GridConfig = DEFAULT) -> DataFrame:
    """Writes the ids of all files of a folder as JSON lines to `out`, and returns (score_id, path, error) of all files, so that a sequence's file is known.

    encode: an encoder of stream, called with the prepared scores and switches; vocab: (token, id). A sequence is a track, or with one stream a score (seq_id 0), and holds
    the programs of its tracks. Tokens that aren't in vocab have no id. Files with errors, and those for which `valid` doesn't hold, write nothing. An existing folder isn't
    written over: Spark raises an error.
    """
    raw, files = scores_of(smf.read_scores(spark, folder, pattern))
    good = filtered(files, valid)
    prepared = prepared_files(raw.join(good.select("score_id"), "score_id", "left_semi"), good, switches, config)
    keys = ["score_id"] if switches.one_stream else ["score_id", "track_idx"]
    made = grammar.sequences(grammar.token_ids(encode(prepared, switches, config), vocab, keys), keys)
    own = pipeline.program_rows(prepared).groupBy(*keys).agg(F.array_sort(F.collect_set(F.struct("program", "is_drum"))).alias("programs"))
    made = made.join(own, keys)
    save_tokens(made.select("score_id", (F.lit(0) if switches.one_stream else F.col("track_idx")).alias("seq_id"), F.col("ids"), F.lit(False).alias("ids_encoded"), "programs"), out)
    return files.select("score_id", "path", "error")


def split_for_training(notes: DataFrame, tokens: DataFrame, most: int, overlap: int = 1, least: int | None = None, per_track: bool = False, bar: int = 4 * DEFAULT.tpb) -> DataFrame:
    """The notes of each training piece, rebased to its start: score_id (or score, 'score-track'), piece, is_first, is_last, and the note's columns.

    tokens: (score_id, track_idx, bar, n), how many tokens each bar has; pieces are consecutive bars of at most `most` tokens, neighbours sharing `overlap` bars
    (structure.split_by_density). per_track: every track is a score of its own. Pieces without notes vanish; a last one of fewer than `least` tokens is dropped.
    """
    d, t = notes, tokens
    if per_track:
        name = F.concat_ws("-", "score_id", "track_idx")
        d, t = d.withColumn("score_id", name), t.withColumn("score_id", name)
    t = t.groupBy("score_id", "bar").agg(F.sum("n").alias("n"))
    every = t.groupBy("score_id").agg(F.max("bar").alias("last")).select("score_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last").cast("bigint"))).alias("bar"))
    counts = every.join(t, ["score_id", "bar"], "left").select("score_id", "bar", F.coalesce("n", F.lit(0)).alias("n"))
    pieces = structure.split_by_density(counts, most, overlap, least)
    last = pieces.groupBy("score_id").agg(F.max("piece").alias("_last"))
    pieces = pieces.join(last, "score_id").select("score_id", "piece", (F.col("piece") == 0).alias("is_first"), (F.col("piece") == F.col("_last")).alias("is_last"), "first_bar", F.explode(F.sequence("first_bar", "last_bar")).alias("bar"))
    d = d.withColumn("bar", F.floor(F.col("time") / bar)).join(pieces, ["score_id", "bar"])
    return d.withColumn("time", F.col("time") - F.col("first_bar") * bar).drop("bar", "first_bar")


def tokens_of_bars(notes: DataFrame, per_note: int = 3, bar: int = 4 * DEFAULT.tpb) -> DataFrame:
    """(score_id, track_idx, bar, n): per_note tokens for each note, by the bar that it starts in."""
    return notes.groupBy(*preprocess.TRACK, F.floor(F.col("time") / bar).alias("bar")).agg((F.count("*") * per_note).alias("n"))
