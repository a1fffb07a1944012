"""The pN_ queries of this folder, over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonegrid.llm import bpe, chunking, cooccurrence, frequency, mixing, mojibake, neardup, packing, spans
from tonegrid.llm.records import once
from tonegrid.session import materialize, table

RECORD = ["score_id", "seq_id"]


def _configs(spark: SparkSession, sf_dir: str) -> list[tuple[str, int, int]]:
    """The configurations: a table of parameters, of fixed size."""
    return [tuple(r) for r in table(spark, sf_dir, "collator_configs").select("config_name", "max_seq_len", "overlap_len").collect()]


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(field, term, occurrences, records, mark) of all terms of token_events (field event) and token_file.tokens (field tokens)."""
    events = table(spark, sf_dir, "token_events").where("type is not null and value is not null").withColumn("term", F.concat_ws("_", "type", "value"))
    sequences = once(table(spark, sf_dir, "token_file").where("size(tokens) > 0").select(*RECORD, "tokens"), RECORD)
    of_tokens = materialize(frequency.of_lists(sequences, "tokens"))  # read for the terms and for their records' number
    counts = frequency.of_rows(events, RECORD, "ord", "term").withColumn("field", F.lit("event"))
    counts = counts.unionByName(of_tokens.where("term is not null").withColumn("field", F.lit("tokens")))
    total = events.select(*RECORD).distinct().agg(F.count("*").alias("n_records")).withColumn("field", F.lit("event"))
    total = total.unionByName(of_tokens.where("term is null").select(F.col("records").alias("n_records")).withColumn("field", F.lit("tokens")))
    return frequency.marked(counts, total, 3, 0.8).select("field", "term", "occurrences", "records", "mark")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in too few or too many records."""
    return p1_terms(spark, sf_dir).where("mark <> 'useful'").select("field", "term", "mark")


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of ids that stand in one record, with counts, lift and conviction."""
    sequences = table(spark, sf_dir, "token_file").where("size(ids) > 0 and not coalesce(ids_encoded, false)")
    return cooccurrence.scored(materialize(cooccurrence.pair_counts(sequences, RECORD, "ids")))  # read for pairs, ids and records


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs in at least 5 records and a 200th of all, eight times as often as chance gives."""
    pairs = p2_pairs(spark, sf_dir).where("n_ab >= 5 and 200 * n_ab >= n_records and n_ab * n_records >= 8 * n_a * n_b")
    return pairs.select("id_a", "id_b")


def _pieces(spark: SparkSession, sf_dir: str, by_cohesion: bool) -> DataFrame:
    bars = [r.id for r in table(spark, sf_dir, "vocab").where("token = 'Bar_None'").select("id").distinct().collect()]
    if len(bars) != 1:
        raise ValueError(f"vocab has {len(bars)} ids of Bar_None, not one")
    bar = bars[0]
    return chunking.split_oversized(table(spark, sf_dir, "token_file"), RECORD, "ids", _configs(spark, sf_dir), bar, by_cohesion)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of oversized records, each the longest that ends before a bar: all bar starts count as equally deep valleys."""
    return _pieces(spark, sf_dir, False)


def p4_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of oversized records, each ending at the deepest valley of lexical cohesion among the bar starts in reach."""
    return _pieces(spark, sf_dir, True)


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p4_cohesion, for each record cut: its ids, and that its pieces begin at 0, end with it, are within the limit, overlap as prescribed, and advance by half of
    what the limit allows wherever a cut is chosen (n_bad counts the pieces that don't)."""
    pieces = materialize(p4_cohesion(spark, sf_dir)).join(table(spark, sf_dir, "collator_configs").select("config_name", F.col("max_seq_len").alias("m"), F.col("overlap_len").alias("o")), "config_name")
    sizes = table(spark, sf_dir, "token_file").where("size(ids) > 0").groupBy(*RECORD).agg(F.max(F.size("ids")).alias("n_ids"))
    along = Window.partitionBy("config_name", *RECORD).orderBy("piece_no")
    d = pieces.join(sizes, RECORD).withColumn("before", F.lag("last_pos").over(along)).withColumn("after", F.lead("first_pos").over(along))
    length = F.col("last_pos") - F.col("first_pos") + 1
    bad = (length > F.col("m")) | ~F.coalesce(F.col("first_pos") == F.col("before") + 1 - F.col("o"), F.col("first_pos") == 0) | (F.col("after").isNull() & (F.col("last_pos") != F.col("n_ids") - 1))
    bad = bad | (F.col("after").isNotNull() & (length <= F.col("o")))
    return d.groupBy("config_name", *RECORD).agg(F.max("n_ids").alias("n_ids"), F.sum(bad.cast("bigint")).alias("n_bad"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of 40 or more ids that stand in another record too."""
    return spans.shared_spans(table(spark, sf_dir, "token_file"), RECORD, "ids", 40)


def p5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each record is shared."""
    return spans.coverage(table(spark, sf_dir, "token_file"), p5_found(spark, sf_dir), RECORD, "ids")


def p6_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each record or piece, for each configuration, with the row's padding."""
    sizes = materialize(table(spark, sf_dir, "token_file").where("size(ids) > 0").groupBy(*RECORD).agg(F.max(F.size("ids")).alias("n")))
    lots = max(1, -(-sizes.count() // packing.LOT))
    return packing.fill_rows(sizes, RECORD, "n", [(name, most) for name, most, _ in _configs(spark, sf_dir)], lots)


def p6_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of p6_rows, for each configuration: records and ids, ids without a place, rows above the capacity, records split without need, and whether
    there are at most 1 % more rows than the ids need."""
    configs = F.array(*[F.struct(F.lit(name).alias("config_name"), F.lit(most).alias("max_seq_len")) for name, most, _ in _configs(spark, sf_dir)])
    rows = materialize(p6_rows(spark, sf_dir))
    sizes = table(spark, sf_dir, "token_file").where("size(ids) > 0").groupBy(*RECORD).agg(F.max(F.size("ids")).alias("n"))
    placed = rows.groupBy("config_name", *RECORD).agg(F.sum("n_ids").alias("placed"), F.count("*").alias("n_pieces"))
    whole = sizes.withColumn("c", F.explode(configs)).select("c.*", *RECORD, "n").join(placed, ["config_name", *RECORD], "left")
    whole = whole.groupBy("config_name", "max_seq_len").agg(
        F.count("*").alias("n_records"), F.sum("n").alias("n_ids"), F.sum(F.col("n") - F.coalesce("placed", F.lit(0))).alias("n_lost"), F.sum((F.col("n_pieces") > F.ceil(F.col("n") / F.col("max_seq_len"))).cast("bigint")).alias("n_split")
    )
    full = rows.groupBy("config_name", "row_id").agg(F.sum("n_ids").alias("filled"), F.max(F.col("row_ids") + F.col("padding")).alias("capacity"))
    full = full.groupBy("config_name").agg(F.count("*").alias("n_rows"), F.sum((F.col("filled") > F.col("capacity")).cast("bigint")).alias("n_over"))
    least = F.ceil(F.col("n_ids") / F.col("max_seq_len"))
    return whole.join(full, "config_name").select("config_name", "n_records", "n_ids", "n_lost", "n_over", "n_split", (F.col("n_rows") <= F.ceil(least * 1.01)).alias("tight"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that fill at least one whole row by themselves."""
    full = p6_rows(spark, sf_dir).where("padding = 0 and n_ids = row_ids")
    return full.select("config_name", *RECORD).distinct()


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences with runs of 6 ids and tracks with runs of 5 pitches. The tracks are gathered once, into a table that is small, a number a note-on."""
    sequences = table(spark, sf_dir, "token_file").where("size(ids) >= 6").select(F.lit("sequence").alias("kind"), F.lit(6).alias("k"), "score_id", F.col("seq_id").alias("idx"), "ids")
    ons = table(spark, sf_dir, "raw_events").where("event_type = 'NoteOn' and velocity > 0 and pitch is not null and ord is not null")
    tracks = materialize(neardup.gathered(ons, ["score_id", "track_idx"], "ord", "pitch").where("size(ids) >= 5"))
    return sequences.union(tracks.select(F.lit("track").alias("kind"), F.lit(5).alias("k"), "score_id", F.col("track_idx").alias("idx"), "ids"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sequences (runs of 6 ids) and of tracks (runs of 5 pitches) that share at least 60 % of their runs."""
    return neardup.similar_pairs(_runs(spark, sf_dir))


def p7_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sequence and track that has a run, with its class of copies and its number of similar ones."""
    return neardup.linked(_runs(spark, sf_dir))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each document by byte_bpe_50k."""
    return bpe.encode(table(spark, sf_dir, "documents"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's tokens, target, repetitions, and the share that it has in the mixture drawn."""
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources too small for their target: those that the first round of filling clamps."""
    return mixing.source_plan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).where("short").select("source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture: documents and how often each is in it."""
    return mixing.mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ciphers, restored) of the decisions with garbled text."""
    return mojibake.repair(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with at least one garbled character."""
    return p10_restored(spark, sf_dir).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p2_found, p2_pairs, p4_found, p4_cohesion, p4_kept, p5_found, p5_coverage, p6_found, p6_rows, p6_kept, p7_found, p7_linked, p8_ids, p9_found, p9_shares, p9_mix, p10_found, p10_restored)}


def oracle_sql() -> dict[str, str]:
    from tonegrid.llm.oracle import SQL

    return SQL
