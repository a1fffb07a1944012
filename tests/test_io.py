"""Files, streams, and the registry of queries."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tonegrid.sources import smf, tokens
from tonegrid.streaming import encode

REPO = Path(__file__).parent.parent
EVENTS = [
    dict(track_idx=0, ord=0, tick=0, event_type="TrackName", text=b"Lead"), dict(track_idx=0, ord=1, tick=0, event_type="Tempo", usec_per_quarter=500000),
    dict(track_idx=0, ord=2, tick=0, event_type="TimeSignature", numerator=6, denominator=8), dict(track_idx=0, ord=3, tick=0, event_type="KeySignature", key=-3, scale=1),
    dict(track_idx=0, ord=4, tick=10, event_type="NoteOn", channel=0, pitch=60, velocity=90), dict(track_idx=0, ord=5, tick=10, event_type="NoteOn", channel=0, pitch=64, velocity=80),
    dict(track_idx=0, ord=6, tick=300, event_type="NoteOff", channel=0, pitch=60, velocity=0), dict(track_idx=0, ord=7, tick=300, event_type="PitchBend", channel=0, value=12345),
    dict(track_idx=0, ord=8, tick=20000, event_type="ControlChange", channel=0, controller=64, value=127), dict(track_idx=0, ord=9, tick=20000, event_type="SysEx", value=0xF0, text=b"\x01\x02\xf7"),
    dict(track_idx=0, ord=10, tick=20001, event_type="EndOfTrack"), dict(track_idx=1, ord=0, tick=0, event_type="ProgramChange", channel=9, program=5), dict(track_idx=1, ord=1, tick=4, event_type="OtherMeta", value=6, text=b"x"),
    dict(track_idx=1, ord=2, tick=4, event_type="OtherChannel", channel=9, controller=0xD, value=7), dict(track_idx=1, ord=3, tick=4, event_type="OtherChannel", channel=9, controller=0xA, pitch=3, value=7),
]


@pytest.mark.parametrize("value", [0, 1, 127, 128, 16383, 16384, (1 << 28) - 1])
def test_numbers(value):
    data = smf.number_bytes(value)
    assert smf.number(data + b"\x01", 0) == (value, len(data))


def test_known_bytes():
    data = b"MThd" + bytes([0, 0, 0, 6, 0, 0, 0, 1, 1, 224]) + b"MTrk" + bytes([0, 0, 0, 12, 0, 0x90, 60, 64, 0x81, 0x00, 60, 0, 0, 0xFF, 0x2F, 0])
    form, tpq, events = smf.parse(data)
    assert (form, tpq) == (0, 480)
    assert [(e["event_type"], e["tick"]) for e in events] == [("NoteOn", 0), ("NoteOff", 128), ("EndOfTrack", 128)]


@pytest.mark.parametrize("data", [b"", b"RIFF" + bytes(20), b"MThd" + bytes([0, 0, 0, 2]) + bytes(8), b"MThd" + bytes([0, 0, 0, 6, 0, 0, 0, 1, 1, 224]) + b"MTrk" + bytes([0, 0, 0, 9, 0]), b"MThd" + bytes([0, 0, 0, 6, 0, 0, 0, 1, 1, 224]) + b"MTrk" + bytes([0, 0, 0, 2, 0, 60])])
def test_bad_files(data):
    with pytest.raises(smf.BadFile):
        smf.parse(data)


def test_files(spark, tmp_path):
    events = spark.createDataFrame([("a.mid", 480, *[e.get(c) for c in smf.COLUMNS]) for e in EVENTS], f"path string, tpq int, {smf.EVENT}")
    for r in smf.write_events(events).collect():
        (tmp_path / r.path).write_bytes(bytes(r.content))
    (tmp_path / "b.mid").write_bytes(b"junk")
    (tmp_path / "c.txt").write_bytes(b"junk")
    got = smf.read_scores(spark, str(tmp_path)).cache()
    assert got.where("error is not null").count() == 1
    good = got.where("error is null")
    assert good.first().format == 1
    key = lambda r: (r.track_idx, r.ord)
    assert [tuple(r) for r in sorted(good.select(*smf.COLUMNS).collect(), key=key)] == [tuple(r) for r in sorted(events.select(*smf.COLUMNS).collect(), key=key)]
    assert smf.read_events(spark.createDataFrame([], "path string, content binary")).count() == 0


def test_token_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, [1, 2], None, [(0, False)]), (1, 1, None, True, None)], tokens.SCHEMA)
    tokens.save_tokens(df, str(tmp_path / "t"))
    assert sorted(map(tuple, tokens.load_tokens(spark, str(tmp_path / "t")).collect())) == sorted(map(tuple, df.collect()))


def test_streams(spark, tmp_path):
    schema = "score_id bigint, track_idx int, ord bigint, tick bigint, event_type string, channel int, pitch int, velocity int, loaded_at timestamp"
    rows = [(1, 0, 0, 5, "NoteOn", 0, 60, 9), (1, 0, 1, 6, "NoteOn", 0, 60, 9), (1, 0, 2, 9, "NoteOff", 0, 60, 0), (1, 0, 3, 30, "NoteOn", 0, 60, 0)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema.rsplit(",", 1)[0]).withColumn("loaded_at", F.lit("2024-01-01 00:00:00").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    for name, df, mode in (("pairs", encode.pair_stream(encode.distinct_stream(stream)), "append"), ("acts", encode.activity(stream), "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert sorted((r.tick, r.duration) for r in spark.table("pairs").collect()) == [(5, 4), (6, 24)]
    assert {(r.event_type, r.n) for r in spark.table("acts").collect()} == {("NoteOn", 3), ("NoteOff", 1)}


def test_library_without_the_subpackage():
    """All but one import in the registry does without the subpackage of training-data operators."""
    for path in (REPO / "tonegrid").rglob("*.py"):
        if path.parent.name != "llm":
            assert "tonegrid.llm" not in path.read_text(), path
    code = "import sys; sys.modules['tonegrid.llm'] = None; import __spark_entry__ as e; assert 'p3_found' in e.queries() and not any(q.startswith('p1_') for q in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
