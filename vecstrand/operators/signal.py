"""Signal analytics over waveforms in rows: framing, spectra, mel bands, self-similarity, band-stop and attribution.

Per-row arrays; formulas are Catalyst columns, Fourier transforms one Arrow pass of numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE, HOP, BANDS, FLOOR_DB = 2048, 1024, 96, -80.0


def band_edges(low: float, high: float, n: int) -> Column:
    """n + 1 edges at equal ratios."""
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda k: F.lit(low) * F.pow(F.lit(high / low), k / n))


def hz_to_mel(f: Column) -> Column:
    return 2595 * F.log10(1 + f / 700)


def mel_to_hz(m: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), m / 2595) - 1)


def hann(n: int, periodic: bool = True) -> Column:
    over = n if periodic else n - 1
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 0.5 - 0.5 * F.cos(2 * np.pi * i / over))


def decibels(energy: Column) -> Column:
    return F.greatest(10 * F.log10(F.greatest(energy, F.lit(1e-10))), F.lit(FLOOR_DB))


def frames(wave: str, size: int = SIZE, hop: int = HOP) -> Column:
    """Whole frames only; too short a wave has none."""
    m = F.floor((F.size(wave) - size) / hop).cast("int") + 1
    return F.when(F.size(wave) >= size, F.transform(F.sequence(F.lit(0), m - 1), lambda f: F.slice(wave, f * hop + 1, size))).otherwise(F.expr("cast(array() as array<array<double>>)"))


def pool(values: str, target: int) -> Column:
    """Means of contiguous slices, down to target columns by integer division; never up."""
    n = F.size(values)
    count = F.least(F.lit(target), n)
    start = lambda c: F.floor(n * c / count).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda c: F.aggregate(F.slice(values, start(c) + 1, start(c + 1) - start(c)), F.lit(0.0), lambda s, x: s + x) / (start(c + 1) - start(c)))


def stretch(value: Column, low: Column, high: Column) -> Column:
    """Contrast: low to 0, high to 1, clamped; no span gives one half."""
    return F.when(high <= low, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / F.nullif(high - low, F.lit(0.0)))))


def shared_gain(wave: str, most: float = 0.98) -> Column:
    peak = F.array_max(F.transform(wave, lambda x: F.abs(x)))
    return F.when(peak > most, most / peak).otherwise(1.0)


def windows(wave: str, size: int, count: int = 3) -> Column:
    """At most count windows spread evenly over the wave; a shorter wave is repeated to the size."""
    n = F.size(wave)
    tiled = F.array(F.slice(F.flatten(F.array_repeat(F.col(wave), F.ceil(size / n).cast("int"))), 1, size))
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.slice(wave, F.floor((n - size) * k / max(1, count - 1)).cast("int") + 1, size))
    return F.when(n < size, tiled).otherwise(F.array_distinct(spread))


def _mel_bank(rate: int, size: int, bands: int) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), bands + 2) / 2595) - 1)
    bins = np.arange(size // 2) * rate / size
    rise = (bins - points[:-2, None]) / np.maximum(points[1:-1, None] - points[:-2, None], 1e-12)
    fall = (points[2:, None] - bins) / np.maximum(points[2:, None] - points[1:-1, None], 1e-12)
    return np.maximum(0, np.minimum(rise, fall))


def mel_spectrogram(df: DataFrame, key: str, wave: str, rate: int, size: int = SIZE, hop: int = HOP, bands: int = BANDS) -> DataFrame:
    """(key, frame, band, db): long form, floored at -80 dB. A wave shorter than a frame has no rows."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank, window = _mel_bank(rate, size, bands), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
        for b in batches:
            lengths = np.array([-1 if n is None else n for n in b.column(1).value_lengths().to_pylist()])
            for n in np.unique(lengths[lengths >= size]):
                same = np.flatnonzero(lengths == n)
                for at in range(0, len(same), max(1, 2_000_000 // int(n))):
                    some = pa.array(same[at : at + max(1, 2_000_000 // int(n))])
                    x = b.column(1).take(some).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
                    framed = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop] * window
                    power = np.abs(np.fft.rfft(framed, axis=2)[:, :, : size // 2]) ** 2 / size
                    db = np.maximum(10 * np.log10(np.maximum(power @ bank.T, 1e-10)), FLOOR_DB)
                    r, f, k = (i.ravel() for i in np.indices(db.shape))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(some).take(pa.array(r)), pa.array(f), pa.array(k), pa.array(db.ravel())], ["key", "frame", "band", "db"])

    return df.select(F.col(key).alias("key"), F.col(wave).cast("array<double>").alias("w")).mapInArrow(run, f"key {kind}, frame long, band long, db double").withColumnRenamed("key", key)


#: Bins over which a band's edge fades, whatever the band's width, so that stop and solo stay complements.
TAPER = 4


def stop_gain(bins: int, rate: float, size: int, low: float, high: float, taper: int = TAPER) -> Column:
    """Gain of each bin: 0 in the band, 1 beyond its edges, in between a raised cosine of the distance in bins. A band without a bin stops nothing."""
    first, last = F.ceil(F.lit(float(low)) * size / rate), F.floor(F.lit(float(high)) * size / rate)
    away = lambda k: F.least(F.greatest(first - k, k - last, F.lit(0)), F.lit(taper + 1))
    gain = lambda k: F.when((first > last) | (last < 0) | (first >= bins), 1.0).otherwise(0.5 - 0.5 * F.cos(np.pi * away(k) / (taper + 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), gain)


def _stop_gain(size: int, rate: float, low: float, high: float, taper: int) -> np.ndarray | None:
    """As stop_gain; None where nothing is stopped."""
    bins = np.arange(size // 2 + 1)
    inside = np.flatnonzero((bins * rate / size >= low) & (bins * rate / size <= high))
    if not len(inside):
        return None
    away = np.maximum(np.maximum(inside[0] - bins, bins - inside[-1]), 0)
    return 0.5 - 0.5 * np.cos(np.pi * np.minimum(away, taper + 1) / (taper + 1))


def _filtered(x: np.ndarray, gain: np.ndarray, size: int) -> np.ndarray:
    """Frames of a periodic Hann window at half overlap, which sum to one wherever two frames lie, weighted by bin, with their phase, and added up
    again. A frame of silence at either end puts every sample under two frames."""
    hop = size // 2
    padded = np.concatenate([np.zeros(size), x, np.zeros(size + -len(x) % hop)])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    frames = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop] * window
    halves = np.fft.irfft(np.fft.rfft(frames, axis=1) * gain, size, axis=1).reshape(len(frames), 2, hop)
    out = np.zeros((len(frames) + 1, hop))
    out[:-1] += halves[:, 0]
    out[1:] += halves[:, 1]
    return out.ravel()[size : size + len(x)]


def band_stop(x: np.ndarray, rate: int, low: float, high: float, size: int = 2048, taper: int = TAPER) -> np.ndarray:
    """The wave without a band; as it was if there is nothing to remove."""
    gain = _stop_gain(size, rate, low, high, taper) if high > low and len(x) else None
    return x if gain is None else _filtered(np.asarray(x, float), gain, size)


def band_solo(x: np.ndarray, rate: int, low: float, high: float, size: int = 2048, taper: int = TAPER) -> np.ndarray:
    """The band alone: what band_stop takes out. A band without a bin leaves the wave as it is."""
    gain = _stop_gain(size, rate, low, high, taper) if high > low and len(x) else None
    return x if gain is None else _filtered(np.asarray(x, float), 1 - gain, size)


def attribution(df: DataFrame, key: str, wave: str, rec: str, rate: int, edges: list[float], embed: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, band, delta): how much the cosine of the wave's embedding with rec falls when a band is taken out. The embedder is the caller's."""
    kind = df.schema[key].dataType.simpleString()

    def cos(a: np.ndarray, b: np.ndarray) -> float:
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return float(a @ b / n) if n else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, w, r in zip(*(b.column(i).to_pylist() for i in range(3))):
                x, r = np.array(w, float), np.array(r, float)
                base = cos(embed(x), r)
                out += [(k, i, base - cos(embed(band_stop(x, rate, lo, hi)), r)) for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:]))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["key", "band", "delta"])

    return df.select(F.col(key).alias("key"), wave, rec).mapInArrow(run, f"key {kind}, band long, delta double").withColumnRenamed("key", key)


# Key profiles of the major and minor modes, from the tonic up.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)


def key_of(chroma: str) -> Column:
    """struct<strength, rotation, mode>: the best of 24 rotated profiles by correlation with 12 chroma values; the first wins ties; no spread, 0."""
    mean = F.aggregate(chroma, F.lit(0.0), lambda s, x: s + x) / 12
    centred = F.transform(chroma, lambda x: x - mean)
    size = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, x: s + x * x))
    options = []
    for m, (mode, profile) in enumerate((("major", MAJOR), ("minor", MINOR))):
        p = np.array(profile) - np.mean(profile)
        p /= np.linalg.norm(p)
        for tonic in range(12):
            rolled = F.array(*[F.lit(float(p[(i - tonic) % 12])) for i in range(12)])
            r = F.aggregate(F.zip_with(centred, rolled, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
            options.append(F.struct(F.greatest(F.coalesce(F.try_divide(r, size), F.lit(0.0)), F.lit(0.0)).alias("strength"), F.lit(-(m * 12 + tonic)).alias("rank"), F.lit(tonic).alias("tonic"), F.lit(mode).alias("mode")))
    return F.array_max(F.array(*options))


def self_similarity(rows: DataFrame, key: str, columns: str) -> DataFrame:
    """(key, a, b, cosine): each two of a row's pooled columns, an array of vectors; within the row, so nothing is joined, shuffled or broadcast."""
    from vecstrand.functions.vector import dot, norm

    def pair(x: Column, i: Column, y: Column, j: Column) -> Column:
        like = F.coalesce(F.try_divide(dot(x["v"], y["v"]), x["n"] * y["n"]), F.when(F.size(x["v"]) == F.size(y["v"]), F.lit(0.0)))
        return F.struct(i.cast("long").alias("a"), j.cast("long").alias("b"), like.alias("cosine"))

    normed = rows.filter(F.col(key).isNotNull()).select(key, F.transform(columns, lambda x: F.struct(x.alias("v"), norm(x).alias("n"))).alias("_v"))
    return normed.select(key, F.inline(F.flatten(F.transform("_v", lambda x, i: F.transform("_v", lambda y, j: pair(x, i, y, j))))))
