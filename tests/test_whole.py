"""Queries that do the whole job, over small tables written for each test."""

import datetime

import pytest

import __spark_entry__ as entry
from tonegrid.operators import events

RAW = "score_id bigint, track_idx int, ord bigint, tick bigint, event_type string, channel int, pitch int, velocity int, controller int, value int, program int, usec_per_quarter int, numerator int, denominator int, key int, scale int, text binary, loaded_at timestamp"
AT = datetime.datetime(2023, 1, 1)


@pytest.fixture
def tables(spark, tmp_path):
    """Writes raw_events, scores and tracks. notes: (score_id, track_idx, tick, duration, pitch); programs: {(score_id, track_idx): program, -1 for drums}."""

    def write(notes, programs, signatures=()):
        rows, order = [], {}
        for s, t, tick, kind, pitch, velocity in sorted(
            [(s, t, tick, "NoteOn", p, 99) for s, t, tick, _, p in notes] + [(s, t, tick + d, "NoteOff", p, 0) for s, t, tick, d, p in notes], key=lambda r: (r[0], r[1], r[2], r[3])
        ):
            order[s, t] = order.get((s, t), -1) + 1
            rows.append((s, t, order[s, t], tick, kind, 0, pitch, velocity, *[None] * 9, AT))
        rows += [(s, 0, 1000 + i, tick, "TimeSignature", *[None] * 7, n, d, *[None] * 3, AT) for i, (s, tick, n, d) in enumerate(signatures)]
        spark.createDataFrame(rows, RAW).write.parquet(f"{tmp_path}/raw_events.parquet")
        spark.createDataFrame([(s, None, 1, 8, AT) for s in sorted({s for s, _ in programs})], "score_id bigint, path string, format smallint, tpq int, loaded_at timestamp").write.parquet(f"{tmp_path}/scores.parquet")
        spark.createDataFrame([(s, t, max(p, 0), p < 0, None) for (s, t), p in programs.items()], "score_id bigint, track_idx int, program int, is_drum boolean, name string").write.parquet(f"{tmp_path}/tracks.parquet")
        return str(tmp_path)

    return write


def test_all_classes_are_merged(spark, tables):
    programs = {(1, 0): 0, (1, 1): 9, (1, 2): 24, (1, 3): 44, (1, 4): 60, (1, 5): 41, (1, 6): -1}
    sf = tables([(1, t, 8 * t, 4, 60) for _, t in programs], programs)
    got = {r.track_idx: (r["class"], r.program) for r in entry.queries()["merge_per_class_all"](spark, sf).collect()}
    assert got == {0: (0, 0), 1: (1, 8), 2: (3, 24), 3: (5, 40), 4: (7, 56), 5: (5, 40), 6: (16, -1)}


def test_errors_are_counted_over_all_tokens(spark, tables):
    notes = [(1, 0, 8 * i, 4, 60) for i in range(60) for _ in range(2)] + [(1, 1, 8 * i, 4, 60) for i in range(60)]
    sf = tables(notes, {(1, 0): 0, (1, 1): 9})
    rows = {r.track_idx: (r.n_rows, r.n_errors) for r in entry.queries()["cpword_errors_all"](spark, sf).collect()}
    bars, onsets = 15, 60
    assert rows == {0: (bars + onsets + 120, 60), 1: (bars + onsets + 60, 0)}
    assert sorted(map(tuple, entry.queries()["midilike_errors_all"](spark, sf).collect())) == [(1, 0, 0, 0), (1, 1, 0, 0)]


def test_damaged_tokens_have_errors(spark):
    lines = ["NoteOn_60", "NoteOff_60", "NoteOff_60", "NoteOn_61", "DrumOff_61", "DrumOn_40"]
    d = spark.createDataFrame([(1, 0, i, x) for i, x in enumerate(lines)], "score_id bigint, track_idx int, ord bigint, token string")
    assert [tuple(r) for r in events.midilike_errors(d).collect()] == [(1, 0, 2, 2)]


def test_marks_of_records_without_tokens(spark, tmp_path):
    rows = [(1, 0, [4, 10, 42], None, False, AT), (1, 1, [1500, 4, 10], None, True, AT), (1, 2, [4, 99], ["Bar_None", "TimeShift_x"], None, AT), (1, 2, [4, 99], ["Bar_None", "TimeShift_x"], None, AT + datetime.timedelta(1)), (1, 3, None, None, None, AT)]
    spark.createDataFrame(rows, "score_id bigint, seq_id int, ids array<int>, tokens array<string>, ids_encoded boolean, loaded_at timestamp").write.parquet(f"{tmp_path}/token_file.parquet")
    spark.createDataFrame([("Bar_None", 4), ("Position_0", 10), ("Pitch_21", 42)], "token string, id int").write.parquet(f"{tmp_path}/vocab.parquet")
    got = sorted(map(tuple, entry.queries()["structure_marks_all"](spark, str(tmp_path)).collect()))
    assert got == [(1, 0, 0, "bar"), (1, 0, 1, "beat"), (1, 0, 1, "time"), (1, 0, 2, "note"), (1, 1, 1, "bar"), (1, 1, 2, "beat"), (1, 1, 2, "time"), (1, 2, 0, "bar"), (1, 2, 1, "time")]


def test_the_whole_vocabulary_is_merged(spark, tmp_path):
    names = [(f"T_{i}", i) for i in range(150)] + [(f"<extra_id_{i}>", 200 + i) for i in (0, 1, 3)]
    spark.createDataFrame(names, "token string, id int").write.parquet(f"{tmp_path}/vocab.parquet")
    spark.createDataFrame([(["T_149", "new", None],)], "tokens array<string>").write.parquet(f"{tmp_path}/token_file.parquet")
    assert sorted(map(tuple, entry.queries()["merge_vocab_all"](spark, str(tmp_path)).collect())) == sorted([*names, ("new", 204)])
    assert sorted(map(tuple, entry.queries()["sentinel_discovery_all"](spark, str(tmp_path)).collect())) == [("<extra_id_0>", 200), ("<extra_id_1>", 201)]


def test_scores_without_supported_signature_have_bars(spark, tables):
    notes = [(s, 0, 8 * i, 4, 60) for s in (1, 2, 3) for i in range(9)]
    sf = tables(notes, {(s, 0): 0 for s in (1, 2, 3)}, [(2, 0, 7, 16), (3, 0, 3, 4)])
    rows = {q: entry.queries()[q](spark, sf).collect() for q in ("bars_ticks", "beats_ticks", "notes_per_bar", "segment_bars", "remi_signatures_encode")}
    assert sorted((r.score_id, r.tick, r.num, r.den) for r in rows["bars_ticks"]) == [(s, t, 4, 4) for s in (1, 2) for t in (0, 32, 64)] + [(3, t, 3, 4) for t in (0, 24, 48)]
    assert [sum(r.score_id == s for r in rows["beats_ticks"]) for s in (1, 2, 3)] == [8, 8, 8]
    assert sorted((r.score_id, r.bar, r.n_notes) for r in rows["notes_per_bar"]) == [(s, b, n) for s in (1, 2) for b, n in enumerate((4, 4, 1))] + [(3, b, 3) for b in range(3)]
    assert sorted((r.score_id, r.start_tick, r.end_tick) for r in rows["segment_bars"] if r.score_id < 3) == [(s, t, t + 32) for s in (1, 2) for t in (0, 32)]
    assert [sum(r.score_id == s and r.token == "Pitch_60" for r in rows["remi_signatures_encode"]) for s in (1, 2, 3)] == [9, 9, 9]
