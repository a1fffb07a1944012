"""Settings of the grids and grammars, and the tables derived from them; driver-side only."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

#: The named grammars.
GRAMMARS = ("remi", "tsd", "midilike", "structured", "cpword", "octuple", "mumidi", "mmm", "pertok")


def _normal(token: str) -> str:
    """A special token as TYPE_VALUE: one underscore, further ones as dashes."""
    parts = token.split("_")
    return f"{token}_None" if len(parts) == 1 else f"{'-'.join(parts[:-1])}_{parts[-1]}"


@dataclass(frozen=True)
class GridConfig:
    """What the grids and the vocabularies of all grammars depend on."""

    pitch_range: tuple[int, int] = (21, 109)
    drum_range: tuple[int, int] = (27, 88)
    num_velocities: int = 32
    beat_res: tuple[tuple[int, int, int], ...] = ((0, 4, 8), (4, 12, 4))  # beats from, to, positions a beat
    rest_res: tuple[tuple[int, int, int], ...] = ((0, 1, 8), (1, 2, 4), (2, 12, 2))
    num_tempos: int = 32
    tempo_range: tuple[int, int] = (40, 250)
    time_signatures: tuple[tuple[int, int], ...] = ((3, 8), (12, 8), (6, 8), (5, 4), (6, 4), (3, 4), (2, 4), (1, 4), (4, 4))
    bends: tuple[int, int, int] = (-8192, 8191, 32)
    special_tokens: tuple[str, ...] = ("PAD", "BOS", "EOS", "MASK")
    max_bar_embedding: int = 60
    drop_equal_tempos: bool = True
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        for low, high in (self.pitch_range, self.drum_range):
            if not 0 <= low < high <= 127:
                raise ValueError("pitch ranges lie within 0..127, the lower bound first")
        if not 1 <= self.num_velocities <= 127:
            raise ValueError("between 1 and 127 velocities")
        if any(den & (den - 1) for _, den in self.time_signatures):
            raise ValueError("denominators of time signatures are powers of two")
        if max(r for _, _, r in self.rest_res) > max(r for _, _, r in self.beat_res):
            raise ValueError("rests can't be finer than beats")
        if "PAD" not in [t.split("_")[0] for t in self.special_tokens]:
            raise ValueError("PAD must be a special token")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> GridConfig:
        deep = lambda x: tuple(map(deep, x)) if isinstance(x, list) else x
        return cls(**{k: deep(v) for k, v in json.loads(text).items()})

    @property
    def tpb(self) -> int:
        """Positions of a beat."""
        return max(r for _, _, r in self.beat_res)

    @property
    def specials(self) -> list[str]:
        return list(dict.fromkeys(map(_normal, self.special_tokens)))

    @property
    def velocities(self) -> list[int]:
        return [i * 127 // self.num_velocities for i in range(1, self.num_velocities + 1)]

    def spans(self, resolutions: tuple[tuple[int, int, int], ...]) -> list[tuple[int, str]]:
        """(positions, value) of each duration or shift, without zero; a value is beats.positions.resolution."""
        out = [(b * self.tpb + p * self.tpb // r, f"{b}.{p}.{r}") for low, high, r in resolutions for b in range(low, high) for p in range(r)]
        last, r = resolutions[-1][1:]
        return [x for x in [*out, (last * self.tpb, f"{last}.0.{r}")] if x[0] > 0]

    @property
    def durations(self) -> list[tuple[int, str]]:
        return self.spans(self.beat_res)

    @property
    def rests(self) -> list[tuple[int, str]]:
        return self.spans(self.rest_res)

    @property
    def tempos(self) -> list[float]:
        low, high = self.tempo_range
        return [round(low + (high - low) * i / (self.num_tempos - 1), 2) for i in range(self.num_tempos)]

    @property
    def default_tempo(self) -> float:
        return min(self.tempos, key=lambda t: abs(t - 120))

    @property
    def pitch_bends(self) -> list[int]:
        low, high, n = self.bends
        return [int(low + (high - low) * i / (n - 1)) for i in range(n)]


DEFAULT = GridConfig()


def vocabulary(grammar: str, config: GridConfig = DEFAULT) -> list[list[str]]:
    """The tokens of each sub-vocabulary of a grammar, ids by position; one list for grammars of single tokens."""
    low, high = config.pitch_range
    pitch = [f"Pitch_{p}" for p in range(low, high + 1)]
    drums = [f"PitchDrum_{p}" for p in range(config.drum_range[0], config.drum_range[1] + 1)]
    velocity = [f"Velocity_{v}" for v in config.velocities]
    duration = [f"Duration_{d}" for _, d in config.durations]
    shift = [f"TimeShift_{d}" for _, d in config.durations]
    positions = 4 * config.tpb  # of a bar of four quarters
    position = [f"Position_{i}" for i in range(positions)]
    s = config.specials
    if grammar == "remi":
        return [[*s, "Bar_None", *pitch, *velocity, *duration, *position, *drums]]
    if grammar == "tsd":
        return [[*s, *pitch, *velocity, *duration, *shift, *drums]]
    if grammar == "midilike":
        on = [x.replace("Pitch", "NoteOn") for x in pitch]
        off = [x.replace("Pitch", "NoteOff") for x in pitch]
        drum_on = [x.replace("PitchDrum", "DrumOn") for x in drums]
        drum_off = [x.replace("PitchDrum", "DrumOff") for x in drums]
        return [[*s, *on, *velocity, *off, *shift, *drum_on, *drum_off]]
    if grammar == "structured":
        return [[*s, *pitch, *velocity, *duration, "TimeShift_0.0.1", *shift, *drums]]
    if grammar == "mmm":
        return [[*s, "Track_Start", "Track_End", "Bar_None", *pitch, *velocity, *duration, *position, *drums, *[f"Program_{p}" for p in range(-1, 128)]]]
    if grammar == "octuple":
        return [[*s, *pitch, *drums], [*s, *position], [*s, *[f"Bar_{i}" for i in range(config.max_bar_embedding)]], [*s, *velocity], [*s, *duration]]
    if grammar == "cpword":
        own = [*s, "Ignore_None"]
        return [[*s, "Family_Metric", "Family_Note"], [*own, "Bar_None", *position], [*own, *pitch, *drums], [*own, *velocity], [*own, *duration]]
    if grammar == "mumidi":
        first = [*s, "Bar_None", *position, *[f"Program_{p}" for p in range(-1, 128)], *pitch, *drums]
        bars = [*s, *[f"BarPosEnc_{i}" for i in range(config.max_bar_embedding)]]
        return [first, bars, [*s, "PositionPosEnc_None", *[f"PositionPosEnc_{i}" for i in range(positions)]], [*s, *velocity], [*s, *duration]]
    raise ValueError(f"no vocabulary of {grammar}")


#: Which token types may follow each, in the grammars of single tokens.
GRAPHS: dict[str, dict[str, tuple[str, ...]]] = {
    "remi": {
        "Bar": ("Position", "Bar"), "Position": ("Pitch", "PitchDrum"), "Pitch": ("Velocity",), "PitchDrum": ("Velocity",), "Velocity": ("Duration",),
        "Duration": ("Pitch", "PitchDrum", "Position", "Bar"),
    },
    "tsd": {
        "Pitch": ("Velocity",), "PitchDrum": ("Velocity",), "Velocity": ("Duration",), "Duration": ("Pitch", "PitchDrum", "TimeShift"), "TimeShift": ("Pitch", "PitchDrum", "TimeShift"),
    },
}


def type_graph(grammar: str) -> list[tuple[str, str]]:
    """(from, to) of the types that may follow one another, with the rules of BOS and EOS: BOS before all but itself, EOS after all."""
    edges = [(a, b) for a, to in GRAPHS[grammar].items() for b in to]
    types = sorted(GRAPHS[grammar])
    return edges + [("BOS", t) for t in types] + [("BOS", "EOS")] + [(t, "EOS") for t in types]
