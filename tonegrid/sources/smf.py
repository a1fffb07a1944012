"""Standard MIDI files: bytes to raw events and back.

Reading is a mapInPandas pass over Spark's binaryFile source, one file at a time; a file that can't be read gives one row with its error, so a job
over many files doesn't stop. Delta times and lengths are variable-length numbers of seven bits a byte; a missing status byte repeats the last one.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "track_idx int, ord bigint, tick bigint, event_type string, channel int, pitch int, velocity int, controller int, value int, program int, usec_per_quarter int, numerator int, denominator int, key int, scale int, text binary"
FILE = "path string, format int, tpq int, error string"
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
#: What the high half of a status byte means, and the fields of its data bytes.
CHANNEL = {0x8: ("NoteOff", ("pitch", "velocity")), 0x9: ("NoteOn", ("pitch", "velocity")), 0xA: ("OtherChannel", ("pitch", "value")), 0xB: ("ControlChange", ("controller", "value")), 0xC: ("ProgramChange", ("program",)), 0xD: ("OtherChannel", ("value",)), 0xE: ("PitchBend", ("low", "high"))}


class BadFile(ValueError):
    """The bytes aren't a standard MIDI file."""


def number(data: bytes, at: int) -> tuple[int, int]:
    """A variable-length number and the place after it."""
    value = 0
    for i in range(4):
        if at + i >= len(data):
            raise BadFile("a number runs past the end")
        value = value << 7 | data[at + i] & 0x7F
        if data[at + i] < 0x80:
            return value, at + i + 1
    raise BadFile("a number of more than four bytes")


def number_bytes(value: int) -> bytes:
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def _meta(kind: int, data: bytes) -> dict:
    if kind == 0x51 and len(data) == 3:
        return {"event_type": "Tempo", "usec_per_quarter": int.from_bytes(data)}
    if kind == 0x58 and len(data) >= 2:
        return {"event_type": "TimeSignature", "numerator": data[0], "denominator": 1 << data[1]}
    if kind == 0x59 and len(data) == 2:
        return {"event_type": "KeySignature", "key": struct.unpack("b", data[:1])[0], "scale": data[1]}
    if kind == 0x03:
        return {"event_type": "TrackName", "text": data}
    if kind == 0x2F:
        return {"event_type": "EndOfTrack"}
    return {"event_type": "OtherMeta", "value": kind, "text": data}


def parse(data: bytes) -> tuple[int, int, list[dict]]:
    """Format, ticks of a quarter, and the events of all tracks in order."""
    if len(data) < 14 or data[:4] != b"MThd":
        raise BadFile("no header")
    size, form, _, tpq = struct.unpack(">IHHH", data[4:14])
    if size < 6:
        raise BadFile("a header of fewer than 6 bytes")
    at, track, events = 8 + size, 0, []
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8])
        body, at = data[at + 8 : at + 8 + size], at + 8 + size
        if len(body) < size:
            raise BadFile("a track is cut off")
        if name == b"MTrk":
            events += _track(body, track)
            track += 1
    return form, tpq, events


def _track(body: bytes, track: int) -> Iterator[dict]:
    at = tick = order = status = 0
    while at < len(body):
        delta, at = number(body, at)
        tick += delta
        if at >= len(body):
            raise BadFile("an event is cut off")
        if body[at] >= 0x80:
            status, at = body[at], at + 1
        elif status < 0x80 or status >= 0xF0:
            raise BadFile("data without a status")
        event: dict = {"track_idx": track, "ord": order, "tick": tick}
        if status == 0xFF:
            if at >= len(body):
                raise BadFile("an event is cut off")
            size, start = number(body, at + 1)
            event |= _meta(body[at], body[start : start + size])
            at = start + size
        elif status in (0xF0, 0xF7):
            size, start = number(body, at)
            event |= {"event_type": "SysEx", "value": status, "text": body[start : start + size]}
            at = start + size
        elif status >= 0xF0:
            raise BadFile(f"status {status:#x} in a file")
        else:
            kind, fields = CHANNEL[status >> 4]
            values = body[at : at + len(fields)]
            if len(values) < len(fields):
                raise BadFile("an event is cut off")
            at += len(fields)
            event |= {"event_type": kind, "channel": status & 0xF} | dict(zip(fields, values))
            if kind == "PitchBend":
                event["value"] = event.pop("low") + (event.pop("high") << 7)
            elif kind == "OtherChannel":
                event["controller"] = status >> 4
            elif kind == "NoteOn" and event["velocity"] == 0:
                event["event_type"] = "NoteOff"
        yield event
        order += 1


def _event_bytes(e) -> bytes:
    """Status (or none) and data of an event, without its delta."""
    kind = e["event_type"]
    n = lambda c: int(e[c])
    blob = lambda: bytes(e["text"] or b"")
    meta = lambda code, data: bytes([0xFF, code]) + number_bytes(len(data)) + data
    if kind in ("NoteOn", "NoteOff"):
        return bytes([(0x90 if kind == "NoteOn" else 0x80) | n("channel"), n("pitch"), 0 if e["velocity"] is None or e["velocity"] != e["velocity"] else n("velocity")])
    if kind == "ControlChange":
        return bytes([0xB0 | n("channel"), n("controller"), n("value")])
    if kind == "ProgramChange":
        return bytes([0xC0 | n("channel"), n("program")])
    if kind == "PitchBend":
        return bytes([0xE0 | n("channel"), n("value") & 0x7F, n("value") >> 7])
    if kind == "OtherChannel":
        return bytes([n("controller") << 4 | n("channel")] + ([n("pitch")] if n("controller") == 0xA else []) + [n("value")])
    if kind == "Tempo":
        return meta(0x51, n("usec_per_quarter").to_bytes(3))
    if kind == "TimeSignature":
        return meta(0x58, bytes([n("numerator"), n("denominator").bit_length() - 1, 24, 8]))
    if kind == "KeySignature":
        return meta(0x59, struct.pack("bB", n("key"), n("scale")))
    if kind == "TrackName":
        return meta(0x03, blob())
    if kind == "EndOfTrack":
        return meta(0x2F, b"")
    if kind == "SysEx":
        return bytes([n("value")]) + number_bytes(len(blob())) + blob()
    return meta(n("value"), blob())


def compose(form: int, tpq: int, tracks: list[list]) -> bytes:
    """A file of tracks, each a list of events in order of tick; deltas are made from the ticks, equal status bytes are written once."""
    out = [b"MThd", struct.pack(">IHHH", 6, form, len(tracks), tpq)]
    for events in tracks:
        body, tick, status = bytearray(), 0, 0
        for e in events:
            data = _event_bytes(e)
            body += number_bytes(int(e["tick"]) - tick)
            tick = int(e["tick"])
            body += data[1:] if data[0] == status and status < 0xF0 else data
            status = data[0]
        out += [b"MTrk", struct.pack(">I", len(body)), bytes(body)]
    return b"".join(out)


def read_events(files: DataFrame) -> DataFrame:
    """path, format, tpq, error and the event columns, from rows of path and content: an event a row, or the error of a file that can't be read."""

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    form, tpq, events = parse(bytes(content or b""))
                    head = {"path": path, "format": form, "tpq": tpq, "error": None}
                except BadFile as e:
                    events, head = [], {"path": path, "format": None, "tpq": None, "error": str(e)}
                made = [head | e for e in events or [{}]]
                yield pd.DataFrame({c: pd.Series([e.get(c) for e in made], dtype=object) for c in [*head, *COLUMNS]})

    return files.select("path", "content").mapInPandas(rows, f"{FILE}, {EVENT}")


def read_scores(spark: SparkSession, path: str, pattern: str = "*.mid") -> DataFrame:
    """The events of all files under a path."""
    return read_events(spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path))


def write_events(events: DataFrame, key: str = "path") -> DataFrame:
    """key, content: a file of the events of each key, format 1 with more than one track. A file is made whole in one task, as it is one value."""
    schema = f"{key} {events.schema[key].dataType.simpleString()}, content binary"

    def file(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["track_idx", "ord"], kind="stable")
        tracks = [own.to_dict("records") for _, own in pdf.groupby("track_idx")]
        content = compose(1 if len(tracks) > 1 else 0, int(pdf["tpq"].iloc[0]), tracks)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [content]})

    return events.where(F.col("event_type").isNotNull() & F.col("tick").isNotNull()).select(key, "tpq", *COLUMNS).groupBy(key).applyInPandas(file, schema)
