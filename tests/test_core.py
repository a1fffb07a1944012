"""Operators of the core against brute force, golden values and round trips."""

import random
from collections import Counter, defaultdict, deque
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tonegrid.config import DEFAULT, GridConfig, type_graph, vocabulary
from tonegrid.functions import greedy, nearest, nearest_bin, span_name, velocity_bin
from tonegrid.operators import collate, controls, corrupt, grammar, grid, harmony, preprocess, score, structure
from tonegrid.operators.intervals import periods_and_gaps
from tonegrid.operators.notes import pair_notes

RAW = "score_id bigint, track_idx int, ord bigint, tick bigint, event_type string, channel int, pitch int, velocity int"
NOTES = "score_id bigint, track_idx int, program int, is_drum boolean, time bigint, duration bigint, pitch int, velocity bigint"


def brute_runs(intervals):
    out = []
    for a, b in sorted(x for x in intervals if x[0] is not None and x[1] is not None and x[0] < x[1]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [("period", a, b) for a, b in out] + [("gap", x[1], y[0]) for x, y in zip(out, out[1:])]


@pytest.mark.parametrize("shard", [4, 16, 1 << 16])
def test_periods_and_gaps(spark, shard):
    rnd = random.Random(shard)
    by = defaultdict(list)
    for e in [None, *range(30)]:
        for _ in range(rnd.randrange(12)):
            a = rnd.randrange(-40, 60)
            by[e].append((a, a + rnd.choice([0, 1, 2, 3, 8, 33])))
    by[1] += [(None, 3), (4, None), (9, 2)]
    by["hot"] = [(i, i + 3) for i in range(0, 400, 4)]
    by["wide"] = [(-(1 << 40), 1 << 40), (5, 9), (1 << 40, (1 << 40) + 3), ((1 << 41), (1 << 42)), ((1 << 41) + 77, (1 << 42) + 999)]
    by["nested"] = [(0, 100), (3, 50), (8, 200), (64, 128), (203, 260), (201, 202)]
    rows = [(None if e is None else str(e), a, b, 1, 1) for e, l in by.items() for a, b in l] * 2
    df = spark.createDataFrame(rows, "who string, a bigint, b bigint, _b int, kind int")
    got = Counter(map(tuple, periods_and_gaps(df, ["who"], "a", "b", shard).collect()))
    assert got == Counter((None if e is None else str(e), *r) for e, l in by.items() for r in brute_runs(l))
    assert periods_and_gaps(df.limit(0), ["who"], "a", "b").count() == 0


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_pair_notes(spark, block):
    rnd = random.Random(block)
    rows, exp = [], Counter()
    for s, c in [(1, 0), (1, None), (None, 2)]:
        tick, queue, order = 0, defaultdict(deque), 0
        for _ in range(150):
            tick += rnd.randrange(3)
            order += rnd.randrange(1, 3)
            pitch, kind = rnd.choice([60, 61]), rnd.choice(["on", "off", "on0"])
            rows.append((s, 0, order, tick, "NoteOff" if kind == "off" else "NoteOn", c, pitch, {"on": 90, "off": None, "on0": 0}[kind]))
            if kind == "on":
                queue[pitch].append((order, tick))
            elif queue[pitch]:
                o, t = queue[pitch].popleft()
                exp[s, 0, c, pitch, o, t, max(1, tick - t), 90] += 1
        for pitch, q in queue.items():
            for o, t in q:
                exp[s, 0, c, pitch, o, t, 1, 90] += 1
    rows += [(1, 0, 900, None, "NoteOn", 0, 60, 3), (1, 0, None, 5, "NoteOn", 0, 60, 3), (1, 0, 901, 5, "NoteOn", 0, None, 3), (1, 0, 902, 7, "Tempo", None, None, None)]
    df = spark.createDataFrame(rows * 2, RAW).withColumn("_k", F.lit(1)).withColumn("on", F.lit(1))
    assert Counter(map(tuple, pair_notes(df, block).collect())) == exp
    assert pair_notes(df.limit(0)).count() == 0


def test_tables():
    assert DEFAULT.velocities == [4 * i - 1 for i in range(1, 33)]
    assert len(DEFAULT.durations) == 64 and [n for n, _ in DEFAULT.durations] == [*range(1, 33), *range(34, 97, 2)]
    assert DEFAULT.default_tempo == 121.29 and DEFAULT.tempos[-1] == 250
    assert [len(vocabulary(g)[0]) for g in ("remi", "tsd", "midilike", "structured")] == [284, 315, 402, 316]
    assert vocabulary("remi")[0].index("Position_0") == 190 and vocabulary("remi")[0].index("PitchDrum_27") == 222
    assert GridConfig.from_json(DEFAULT.to_json()) == DEFAULT
    assert replace(DEFAULT, special_tokens=("PAD", "EOS_a_b")).specials == ["PAD_None", "EOS-a_b"]
    assert ("Duration", "Bar") in type_graph("remi") and ("EOS", "BOS") not in type_graph("remi")
    for bad in ({"pitch_range": (90, 20)}, {"num_velocities": 0}, {"time_signatures": ((4, 3),)}, {"special_tokens": ("BOS",)}, {"rest_res": ((0, 1, 16),)}):
        with pytest.raises(ValueError):
            replace(DEFAULT, **bad)


def test_column_functions(spark):
    d = spark.range(0, 400).withColumn("x", F.col("id"))
    names = [n for n, _ in DEFAULT.durations]
    rows = d.select("x", velocity_bin(F.col("x"), DEFAULT.velocities).alias("v"), nearest_bin(F.col("x"), names).alias("d"), greedy(F.col("x"), names).alias("g"), span_name(F.col("x"), DEFAULT.durations).alias("s"), nearest(F.col("x"), [0, 10, 30]).alias("n")).collect()
    up = lambda x, table: min(table, key=lambda t: (abs(t - x), -t))
    for r in rows:
        if 1 <= r.x <= 127:
            assert r.v == up(r.x, DEFAULT.velocities)
        assert r.d == up(r.x, names) and r.n == up(r.x, [0, 10, 30])
        assert sum(r.g) == r.x and all(g in names for g in r.g) and r.g == sorted(r.g, reverse=True)
    assert rows[12].s == "1.4.8" and rows[33].s is None and rows[96].s == "12.0.4"


@pytest.fixture
def example(spark):
    """Two notes of the worked example, on the grid."""
    notes = spark.createDataFrame([(1, 0, 0, 480, 60, 100), (1, 0, 720, 240, 64, 80)], "score_id bigint, track_idx int, time bigint, duration bigint, pitch int, velocity int")
    return preprocess.preprocess(notes, spark.createDataFrame([(1, 480)], "score_id bigint, tpq int"), spark.createDataFrame([(1, 0, 0, False)], "score_id bigint, track_idx int, program int, is_drum boolean"))


GOLDEN = {
    "remi": "Bar_None Position_0 Pitch_60 Velocity_99 Duration_1.0.8 Position_12 Pitch_64 Velocity_79 Duration_0.4.8",
    "tsd": "Pitch_60 Velocity_99 Duration_1.0.8 TimeShift_1.4.8 Pitch_64 Velocity_79 Duration_0.4.8",
    "midilike": "NoteOn_60 Velocity_99 TimeShift_1.0.8 NoteOff_60 TimeShift_0.4.8 NoteOn_64 Velocity_79 TimeShift_0.4.8 NoteOff_64",
    "structured": "TimeShift_0.0.1 Pitch_60 Velocity_99 Duration_1.0.8 TimeShift_1.4.8 Pitch_64 Velocity_79 Duration_0.4.8",
    "mmm": "Track_Start Program_0 Bar_None Position_0 Pitch_60 Velocity_99 Duration_1.0.8 Position_12 Pitch_64 Velocity_79 Duration_0.4.8 Track_End",
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_tokens(example, name):
    assert " ".join(r.token for r in grammar.ENCODERS[name](example).orderBy("ord").collect()) == GOLDEN[name]


def test_golden_words(example):
    rows = lambda d, *c: [tuple(r[x] for x in c) for r in d.orderBy("ord").collect()]
    assert rows(grammar.encode_octuple(example), "pitch", "position", "bar", "velocity", "duration") == [("Pitch_60", "Position_0", "Bar_0", "Velocity_99", "Duration_1.0.8"), ("Pitch_64", "Position_12", "Bar_0", "Velocity_79", "Duration_0.4.8")]
    assert rows(grammar.encode_cpword(example), "family", "position", "pitch") == [("Family_Metric", "Bar_None", "Ignore_None"), ("Family_Metric", "Position_0", "Ignore_None"), ("Family_Note", "Ignore_None", "Pitch_60"), ("Family_Metric", "Position_12", "Ignore_None"), ("Family_Note", "Ignore_None", "Pitch_64")]
    assert [r[0] for r in rows(grammar.encode_mumidi(example), "token")] == ["Bar_None", "Position_0", "Program_0", "Pitch_60", "Position_12", "Program_0", "Pitch_64"]


@pytest.fixture(scope="module")
def random_notes(spark):
    rnd = random.Random(2)
    rows, lengths = [], [n for n, _ in DEFAULT.durations]
    for s in range(6):
        for t in range(3):
            drum = t == 2
            for _ in range(rnd.randrange(1, 60)):
                rows.append((s, t, -1 if drum else 8 * t, drum, rnd.randrange(0, 1500) // 4 * 4, rnd.choice(lengths), rnd.randrange(30, 80), rnd.choice(DEFAULT.velocities)))
    return spark.createDataFrame(sorted(set(rows)), NOTES).cache()


@pytest.mark.parametrize("name, decode", [("remi", grammar.decode_remi), ("tsd", grammar.decode_tsd), ("octuple", grammar.decode_octuple), ("cpword", grammar.decode_cpword)])
def test_round_trips(random_notes, name, decode):
    back = decode(grammar.ENCODERS[name](random_notes))
    columns = ["score_id", "track_idx", "is_drum", "time", "duration", "pitch", "velocity"]
    assert Counter(map(tuple, back.select(*columns).collect())) == Counter(map(tuple, random_notes.select(*columns).collect()))


def test_round_trip_mumidi(random_notes):
    columns = ["score_id", "program", "is_drum", "time", "duration", "pitch", "velocity"]
    assert Counter(map(tuple, grammar.decode_mumidi(grammar.encode_mumidi(random_notes)).select(*columns).collect())) == Counter(map(tuple, random_notes.select(*columns).collect()))


def test_round_trip_midilike(random_notes):
    """Notes of a pitch that overlap are paired first with first, so onsets, and the ends as a whole, come back."""
    back = grammar.decode_midilike(grammar.encode_midilike(random_notes)).collect()
    notes = random_notes.collect()
    assert Counter((r.score_id, r.track_idx, r.pitch, r.time) for r in back) == Counter((r.score_id, r.track_idx, r.pitch, r.time) for r in notes)
    assert Counter((r.score_id, r.track_idx, r.pitch, r.time + r.duration) for r in back) == Counter((r.score_id, r.track_idx, r.pitch, r.time + r.duration) for r in notes)


def test_empty_and_null_scores(spark, random_notes):
    empty = random_notes.limit(0)
    for name, encode in grammar.ENCODERS.items():
        assert encode(empty).count() == 0, name
    raw = spark.createDataFrame([(1, 0, 0, 5, "NoteOn", 0, 60, 80), (None, None, None, None, None, None, None, None)], RAW)
    notes = score.notes(raw)
    tracks = spark.createDataFrame([], "score_id bigint, track_idx int, program int, is_drum boolean")
    assert preprocess.preprocess(notes, spark.createDataFrame([(1, 0)], "score_id bigint, tpq int"), tracks).count() == 0
    assert preprocess.preprocess(notes, spark.createDataFrame([(1, 8)], "score_id bigint, tpq int"), tracks).collect()[0].program == 0


@pytest.mark.parametrize("onsets, end, expected", [([0, 1920, 3840, 5760], None, [0, 1920, 3840, 5760]), ([1, 1921, 3841], None, [0, 1920, 3840]), ([0, 1920, 3840, 7679], None, [0, 1920, 3840, 5760])])
def test_bars(spark, onsets, end, expected):
    notes = spark.createDataFrame([(1, t) for t in onsets], "score_id bigint, time bigint")
    signature = spark.createDataFrame([(1, 0, 4, 4)], "score_id bigint, time bigint, num int, den int")
    tpq = spark.createDataFrame([(1, 480)], "score_id bigint, tpq int")
    bars = grid.bars(signature, tpq, grid.last_onset(notes))
    assert [r.tick for r in bars.orderBy("bar").collect()] == expected
    per = {r.bar: r.n_notes for r in grid.notes_per_bar(notes, bars).collect()}
    assert sum(per.values()) == len(onsets) and len(per) == len(expected)


def test_signatures(spark):
    tpq = spark.createDataFrame([(1, 480), (2, 480)], "score_id bigint, tpq int")
    s = spark.createDataFrame([(1, 0, 4, 4), (1, 100, 4, 4), (1, 2000, 3, 4), (1, 3900, 2, 4), (2, 500, 6, 8)], "score_id bigint, time bigint, num int, den int")
    got = sorted(map(tuple, preprocess.normalize_signatures(s, tpq).collect()))
    assert got == [(1, 0, 4, 4), (1, 3840, 3, 4), (1, 5280, 2, 4), (2, 0, 4, 4), (2, 1920, 6, 8)]
    assert sorted(map(tuple, preprocess.sections(preprocess.normalize_signatures(s, tpq), tpq).collect())) == [(1, 0, None, 480), (2, 0, 1920, 480), (2, 1920, None, 240)]


def test_sentinels(spark):
    d = spark.createDataFrame([(1, i, 10 + i, m) for i, m in enumerate([0, 1, 1, 0, 1, 0])], "k int, pos bigint, id int, noise int")
    ids = lambda x: [r.id for r in corrupt.to_sentinels(d, ["k"], 9000, x).orderBy("ord").collect()]
    assert ids(1) == [10, 9000, 13, 9001, 15]
    assert ids(0) == [9000, 11, 12, 9001, 14, 9002]


def test_noise(spark):
    d = spark.createDataFrame([(i, 1000) for i in range(5)] + [(9, 1), (10, 2)], "k int, n bigint")
    rows = corrupt.noise_mask(d, ["k"], "n", 0.3, 3.0).collect()
    by = defaultdict(dict)
    for r in rows:
        by[r.k][r.pos] = r.noise
    assert set(by) == {0, 1, 2, 3, 4, 10} and by[10] == {0: 0, 1: 1}
    for k in range(5):
        mask = [by[k][i] for i in range(1000)]
        assert sum(mask) == 300 and mask[0] == 0
        assert sum(a < b for a, b in zip(mask, mask[1:])) == 100
    assert sorted(rows) == sorted(corrupt.noise_mask(d.repartition(3), ["k"], "n", 0.3, 3.0).collect())


def test_corrupted_sides_reconstruct(spark):
    df = spark.createDataFrame([(1, list(range(100, 160)))], "k int, ids array<int>")
    got = defaultdict(list)
    for r in corrupt.span_corruption(df, ["k"], "ids", 0.3, 3.0, 9000).orderBy("ord").collect():
        got[r.side].append(r.id)
    assert sorted(x for side in got.values() for x in side if x < 9000) == list(range(100, 160))


def test_density_split(spark):
    counts = spark.createDataFrame([(1, i, n) for i, n in enumerate([30, 30, 30, 120, 10, 10, 90, 20])], "score_id bigint, bar bigint, n bigint")
    got = [(r.first_bar, r.last_bar) for r in structure.split_by_density(counts, 100, 0, 25).orderBy("piece").collect()]
    assert got == [(0, 2), (3, 3), (4, 5), (6, 6)]
    assert [(r.first_bar, r.last_bar) for r in structure.split_by_density(counts.where("bar < 3"), 70, 1, 0).orderBy("piece").collect()] == [(0, 1), (1, 2)]


def test_offsets_and_augmentation(spark):
    assert structure.offset_tuples([-2, 1], [5], []) == [(-2, 0, 0.0), (1, 0, 0.0), (0, 5, 0.0)]
    assert len(structure.offset_tuples([-2, 1, 2], [-4, 5], [-0.5, 1.0], True)) == 4 * 3 * 3 - 1
    notes = spark.createDataFrame([(1, 0, 0, False, 0, 4, 60, 125), (1, 1, -1, True, 0, 4, 40, 3), (2, 0, 0, False, 0, 4, 127, 9)], NOTES)
    got = {(r.score_id, r.track_idx): (r.pitch, r.duration, r.velocity) for r in structure.augment(notes, [(2, 5, -0.5)], 8).collect()}
    assert got == {(1, 0): (62, 1, 127), (1, 1): (40, 4, 8)}


def test_collation(spark):
    d = spark.createDataFrame([(1, [5, 6, 7]), (1, [8]), (1, []), (1, None)], "b int, ids array<int>")
    got = {tuple(r.ids): r for r in collate.collate(d, ["b"], "ids", 0).collect()}
    assert set(got) == {(5, 6, 7), (8,)}
    assert got[8,].input_ids == [8, 0, 0] and got[8,].attention_mask == [1, 0, 0] and got[8,].labels == [8, -100, -100]
    left = {tuple(r.ids): r for r in collate.collate(d, ["b"], "ids", 0, left=True, shift=True, multiple=4).collect()}
    assert left[5, 6, 7].input_ids == [0, 5, 6, 7] and left[5, 6, 7].labels == [-100, -100, 6, 7]


def test_bos_eos(spark):
    d = spark.createDataFrame([([5, 6, 7],), ([5, 6],), ([],)], "ids array<int>")
    assert sorted(r.x for r in d.select(collate.bos_eos(F.col("ids"), 4, 0, 2).alias("x")).collect()) == [[0, 2], [0, 5, 6], [0, 5, 6, 2]]


def test_chords(spark):
    rows = [(1, 0, 0, False, t, 8, p, 99) for t, ps in ((0, (60, 64, 67)), (8, (57, 60, 64)), (16, (60, 61, 62)), (24, (60, 64))) for p in ps]
    notes = spark.createDataFrame(rows, NOTES)
    assert {(r.time, r.chord) for r in harmony.chords(notes, 8).collect()} == {(0, "C:maj"), (8, "A:min")}
    assert {(r.time, r.chord) for r in harmony.chords_within(notes, 8).collect()} == {(0, "C:maj"), (8, "A:min")}
    assert {r.chord for r in harmony.chords(notes, 8, unknown=True).collect()} == {"C:maj", "A:min", "C:ukn3"}


def test_rests(spark):
    notes = spark.createDataFrame([(1, 0, 0, False, 0, 8, 60, 99), (1, 0, 0, False, 12, 4, 64, 79), (1, 0, 0, False, 14, 2, 65, 79)], NOTES)
    got = " ".join(r.token for r in harmony.encode_tsd_rests(notes).orderBy("ord").collect())
    assert got == "Pitch_60 Velocity_99 Duration_1.0.8 Rest_0.4.8 Pitch_64 Velocity_79 Duration_0.4.8 TimeShift_0.2.8 Pitch_65 Velocity_79 Duration_0.2.8"


def test_repetition(spark):
    rows = [(1, 0, 0, False, b * 32 + t, 4, 60, 99) for b in range(3) for t in (0, 8)] + [(1, 1, 0, False, b * 32 + b * 8, 4, 60 + b, 99) for b in range(3)]
    got = {r.track_idx: r.repetition for r in controls.track_repetition(spark.createDataFrame(rows, NOTES), 32).collect()}
    assert got == {0: 9, 1: 0}


def test_overlaps_and_duplicates(spark):
    d = spark.createDataFrame([(1, 0, 0, False, 0, 9, 60, 1), (1, 0, 0, False, 0, 4, 60, 2), (1, 0, 0, False, 2, 4, 60, 3), (1, 0, 0, False, 3, 4, 61, 3)], NOTES)
    assert preprocess.drop_duplicates(d).count() == 3 and preprocess.drop_duplicates(d, True).count() == 4
    got = sorted((r.time, r.duration, r.pitch) for r in preprocess.fix_overlaps(preprocess.drop_duplicates(d)).collect())
    assert got == [(0, 2, 60), (2, 4, 60), (3, 4, 61)]
