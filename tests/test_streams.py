"""Whole sequences against a plain state machine, and data sets of files."""

import random

import pytest

from tonegrid.config import DEFAULT
from tonegrid.operators import grammar, pipeline, stream
from tonegrid.operators.pipeline import Switches
from tonegrid.sources import dataset, smf, tokens

TPQ = 8
SIGNS = [(0, 4, 4), (64, 3, 4), (112, 6, 8)]


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(1)
    notes = sorted({(t, d, p, v) for t, d, p, v in ((rnd.randrange(0, 160, 2) + rnd.choice([0, 60]), rnd.choice([2, 4, 8]), rnd.randrange(40, 80), 99) for _ in range(40))})
    made = {
        "notes": spark.createDataFrame([(1, 0, t, d, p, v) for t, d, p, v in notes], "score_id bigint, track_idx int, time bigint, duration bigint, pitch int, velocity int"),
        "scores_tpq": spark.createDataFrame([(1, TPQ)], "score_id bigint, tpq int"),
        "tracks": spark.createDataFrame([(1, 0, 5, False)], "score_id bigint, track_idx int, program int, is_drum boolean"),
        "signatures": spark.createDataFrame([(1, *s) for s in SIGNS], "score_id bigint, time bigint, num int, den int"),
        "tempos": spark.createDataFrame([(1, 0, 500000), (1, 70, 250000)], "score_id bigint, time bigint, usec int"),
        "pedals": spark.createDataFrame([(1, 0, 4, 20)], "score_id bigint, track_idx int, time bigint, duration bigint"),
        "bends": spark.createDataFrame([(1, 0, 0, 33, 100)], "score_id bigint, track_idx int, ord bigint, time bigint, value int"),
    }
    return made


def fold(prepared, rests, bars):
    """The tokens of one track, one item after the other: bars for REMI, else shifts."""
    s = {r.score_id: (r.tpq, [tuple(x) for x in r.s]) for r in prepared.sections.collect()}[1]
    tpq, sections = s
    events = [(r.time, 0, 0, ("TimeSig", f"{r.num}/{r.den}"), r.time) for r in prepared.signatures.collect()]
    events += [(r.time, 0, 1, ("Tempo", f"{r.tempo:g}"), r.time) for r in prepared.tempos.collect()]
    for r in prepared.pedals.collect():
        events += [(r.time, 1, 0, ("Pedal", "0"), r.time), (r.time + r.duration, 1, 0, ("PedalOff", "0"), r.time + r.duration)]
    events += [(r.time, 1, 1, ("PitchBend", str(r.value)), r.time) for r in prepared.bends.collect()]
    names = {}
    for n, name in DEFAULT.durations:
        names.setdefault(n, name)
    for r in sorted(prepared.notes.collect(), key=lambda r: (r.time, r.duration, r.pitch, r.velocity)):
        events.append((r.time, 1, 3, ("Note", (r.pitch, r.velocity, names[r.duration // r.step])), r.time + r.duration))
    events = sorted(events, key=lambda e: e[:3])
    sign, change, bar_then = (4, 4), 0, 0
    for t, _, n, d in sections[:1]:
        sign = (n, d)
    step = lambda: max(1, tpq * 4 // sign[1] // 8)
    long = lambda: tpq * 4 // sign[1] * sign[0]

    def greedy(n, table):
        out, own = [], {}
        for k, name in table:
            own.setdefault(k, name)
        for k in sorted(own, reverse=True):
            while n >= k:
                out.append((k, own[k]))
                n -= k
        return out

    out, bar, last, end = [], -1, (-1 if bars else 0), 0
    for time, _, _, (kind, value), reach in events:
        if time != last:
            said = last
            if rests and time - end >= step():
                said = end
                for k, name in greedy((time - end) // step(), DEFAULT.rests):
                    out.append(f"Rest_{name}")
                    said += k * step()
                bar = max(bar, bar_then + (said - change) // long()) if bars else bar
            if bars:
                upto = bar_then + (time - change) // long()
                while bar < upto:
                    bar += 1
                    out.append("Bar_None")
                    if not (kind == "TimeSig" and bar == upto):
                        out.append(f"TimeSig_{sign[0]}/{sign[1]}")
                if kind != "TimeSig":
                    out.append(f"Position_{(time - change - (upto - bar_then) * long()) // step()}")
            else:
                out += [f"TimeShift_{name}" for _, name in greedy((time - said) // step(), DEFAULT.durations)]
            last = time
        if kind == "TimeSig":
            bar_then, change = bar_then + (time - change) // long(), time
            sign = tuple(map(int, value.split("/")))
            last -= bars
        out += [f"Pitch_{value[0]}", f"Velocity_{value[1]}", f"Duration_{value[2]}"] if kind == "Note" else [f"{kind}_{value}"]
        end = max(end, reach)
    return out


@pytest.mark.parametrize("rests", [False, True])
def test_against_a_state_machine(tables, rests):
    w = Switches(signatures=True, tempos=True, pedals=True, bends=True, rests=rests)
    p = pipeline.prepare(**tables, switches=w)
    for encode, bars in ((stream.encode_remi, 1), (stream.encode_tsd, 0)):
        got = [r.token for r in encode(p, w).orderBy("ord").collect()]
        assert got == fold(p, rests, bars)


def test_empty_scores(tables):
    w = Switches(signatures=True, tempos=True, pedals=True, bends=True, rests=True)
    p = pipeline.prepare(**{k: v.where("score_id < 0") for k, v in tables.items()}, switches=w)
    assert stream.encode_remi(p, w).count() == 0


def test_switches():
    with pytest.raises(ValueError):
        Switches(one_stream=True)


def test_tokenize_a_folder(spark, tmp_path):
    note = lambda tick, on: dict(event_type="NoteOn" if on else "NoteOff", channel=0, pitch=60, velocity=100 if on else 0, tick=tick)
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "a.mid").write_bytes(smf.compose(0, 480, [[note(0, 1), note(480, 0), note(960, 1), note(1200, 0)]]))
    (tmp_path / "in" / "b.mid").write_bytes(b"junk")
    files = dataset.tokenize_dataset(spark, str(tmp_path / "in"), str(tmp_path / "out"), stream.encode_remi, grammar.vocabulary_rows(spark, "remi"))
    by = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert by["a.mid"].error is None and by["b.mid"].error
    rows = tokens.load_tokens(spark, str(tmp_path / "out")).collect()
    assert [(r.score_id, r.seq_id) for r in rows] == [(by["a.mid"].score_id, 0)] and rows[0].programs[0].program == 0
    names = {r.id: r.token for r in grammar.vocabulary_rows(spark, "remi").collect()}
    assert [names[i] for i in rows[0].ids] == "Bar_None Position_0 Pitch_60 Velocity_99 Duration_1.0.8 Position_16 Pitch_60 Velocity_99 Duration_0.4.8".split()


def test_training_pieces(spark):
    notes = spark.createDataFrame([(1, t % 2, 32 * b + 4 * t, 4, 60, 99) for b in range(9) if b != 4 for t in range(3)], "score_id bigint, track_idx int, time bigint, duration bigint, pitch int, velocity int")
    got = dataset.split_for_training(notes, dataset.tokens_of_bars(notes), 30, 1, 9).collect()
    pieces = sorted({(r.piece, r.is_first, r.is_last) for r in got})
    assert [p[0] for p in pieces] == list(range(len(pieces))) and pieces[0][1] and pieces[-1][2] and not any(p[1] for p in pieces[1:])
    assert all(3 * sum(r.piece == p for r in got) <= 30 for p, _, _ in pieces) and min(r.time for r in got) == 0
    own = dataset.split_for_training(notes, dataset.tokens_of_bars(notes), 30, 0, 1, per_track=True)
    assert own.count() == notes.count() and {r.score_id for r in own.select("score_id").distinct().collect()} == {"1-0", "1-1"}
