"""Values as a client shows them: colours, levels, strings, curves and clamped inputs."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stops of the heat ramp, black to pale yellow.
HEAT = ((0, 0, 4), (66, 10, 104), (147, 38, 103), (221, 81, 58), (252, 165, 10), (252, 255, 164))
# Names of the twelve keys.
KEYS = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def heat(level: Column, channel: int) -> Column:
    """One colour channel at a level of 0 to 1, linear between the stops."""
    stops = F.array(*[F.lit(float(s[channel])) for s in HEAT])
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), level)) * (len(HEAT) - 1)
    low = F.least(F.floor(x).cast("int"), F.lit(len(HEAT) - 2))
    return F.get(stops, low) + (F.get(stops, low + 1) - F.get(stops, low)) * (x - low)


def pixel_level(db: Column, peak: Column, span: float = 70.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (db - peak + span) / span))


def gaussian(x: Column, mean: float, sd: float, total: Column, width: float) -> Column:
    """A normal curve on a histogram's scale."""
    return total * width * F.exp(-((x - mean) ** 2) / (2 * sd * sd)) / (sd * math.sqrt(2 * math.pi))


def clamped(value: Column, default: float, least: float, most: float) -> Column:
    """A number from text, within bounds; what is missing or no finite number is the default."""
    x = value.try_cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.greatest(F.lit(least), F.least(F.lit(most), x))).otherwise(F.lit(default))


def key_name(key: Column, mode: Column, strength: Column) -> Column:
    """The key as text; a dash where its strength is nothing."""
    name = F.concat_ws(" ", F.get(F.array(*[F.lit(k) for k in KEYS]), key), mode)
    return F.when(F.coalesce(strength, F.lit(0.0)) > 0, name).otherwise("-")


def tempo_text(bpm: Column) -> Column:
    return F.when((bpm > 0) & ~F.isnan(bpm), F.concat(F.round(bpm, 0).cast("int").cast("string"), F.lit(" BPM"))).otherwise("-")


def safe_name(text: Column, length: int = 60) -> Column:
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9 _-]", "_"), 1, length)
