"""Signals on a regular grid: moving statistics, runs, cue rendering and alignment by correlation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FRAME_MS = 10
SCALES = (1.0, 24 / 23.976, 23.976 / 24, 25 / 24, 24 / 25, 25 / 23.976, 23.976 / 25)
LEAST_CONFIDENCE, RIVAL = 1.45, 300


def moving(df: DataFrame, keys: list[str], order: str, value: str, reach: int) -> DataFrame:
    """df with mean and spread over `reach` rows to either side, and the running total."""
    around = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"mean": F.avg(value).over(around), "spread": F.stddev_pop(value).over(around), "total": F.sum(value).over(upto)})


def runs(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """(keys, flag, start, length): maximal runs of equal flags in order; gaps and islands by two row numbers."""
    whole, own = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys, flag).orderBy(order)
    island = F.row_number().over(whole) - F.row_number().over(own)
    return df.withColumn("_i", island).groupBy(*keys, flag, "_i").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("length")).drop("_i")


def smoothed_flags(df: DataFrame, keys: list[str], order: str, flag: str, bridge: int, least: int) -> DataFrame:
    """(keys, start, length) of true runs after inner false runs shorter than `bridge` are filled and true runs shorter than
    `least` are dropped."""
    every = runs(df, keys, order, flag)
    w = Window.partitionBy(*keys).orderBy("start")
    inner = F.lag("start").over(w).isNotNull() & F.lead("start").over(w).isNotNull()
    filled = every.withColumn("on", F.col(flag) | (inner & (F.col("length") < bridge)))
    block = F.row_number().over(w) - F.row_number().over(Window.partitionBy(*keys, "on").orderBy("start"))
    merged = filled.withColumn("_b", block).groupBy(*keys, "on", "_b").agg(F.min("start").alias("start"), F.sum("length").alias("length"))
    return merged.filter(F.col("on") & (F.col("length") >= least)).select(*keys, "start", "length")


#: What counts as speech: the band in Hz, decibels over the noise floor and at all, modulation within 0.2 s, frames bridged and
#: kept. Frames of a block of the noise floor.
BAND, OVER_FLOOR, LEAST_DB, MODULATION, BRIDGED, KEPT, FLOOR_BLOCK = (250.0, 3400.0), 9.0, -60.0, 2.5, 20, 6, 100


def _response(turn: np.ndarray, rate: float, cutoff: float, high: bool) -> np.ndarray:
    """Frequency response of a second-order filter without a peak, at the angles `turn`."""
    w = 2 * np.pi * cutoff / rate
    alpha, cos = np.sin(w) / np.sqrt(2), np.cos(w)
    side = (1 + cos) / 2 if high else (1 - cos) / 2
    z = np.exp(-1j * turn)
    return side * (1 + (-2 if high else 2) * z + z * z) / ((1 + alpha) - 2 * cos * z + (1 - alpha) * z * z)


def band_passed(samples: np.ndarray, rate: int) -> np.ndarray:
    """The band of speech, filtered as a product of spectra over a signal padded by a second."""
    n = 1 << int(np.ceil(np.log2(max(len(samples) + rate, 2))))
    turn = 2 * np.pi * np.arange(n // 2 + 1) / n
    keep = _response(turn, rate, BAND[0], True) * _response(turn, rate, min(BAND[1], 0.45 * rate), False)
    return np.fft.irfft(np.fft.rfft(samples, n) * keep, n)[: len(samples)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the true runs of flags start and end."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2]


def speech(samples: np.ndarray, rate: int) -> np.ndarray:
    """Whether each frame of 10 ms holds speech: loud over the quietest tenth of the blocks around and modulated; gaps of under 20
    frames within are filled, then runs of under 6 dropped."""
    hop = max(rate * FRAME_MS // 1000, 1)
    frames = len(samples) // hop + (len(samples) % hop > 0)
    if not frames:
        return np.zeros(0, dtype=bool)
    at = np.minimum(np.arange(frames + 1) * hop, len(samples))
    power = np.diff(np.concatenate([[0.0], np.cumsum(band_passed(np.asarray(samples, dtype=float), rate) ** 2)])[at]) / np.diff(at)
    db = 10 * np.log10(np.maximum(power, 0) + 1e-12)
    lows = np.array([np.sort(b)[len(b) // 10] for b in np.split(db, range(FLOOR_BLOCK, frames, FLOOR_BLOCK))])
    around = np.lib.stride_tricks.sliding_window_view(np.pad(lows, 3, constant_values=np.inf), 7).min(axis=1)
    low, high = np.maximum(np.arange(frames) - 10, 0), np.minimum(np.arange(frames) + 11, frames)
    sums, squares = (np.concatenate([[0.0], np.cumsum(x)]) for x in (db, db * db))
    n = high - low
    spread = np.sqrt(np.maximum((squares[high] - squares[low]) / n - ((sums[high] - sums[low]) / n) ** 2, 0))
    on = (db > LEAST_DB) & (db > around[np.arange(frames) // FLOOR_BLOCK] + OVER_FLOOR) & (spread > MODULATION)
    for wanted, least in ((False, BRIDGED), (True, KEPT)):
        for a, b in zip(*_runs(on == wanted)):
            if b - a < least and (wanted or 0 < a and b < frames):
                on[a:b] = not wanted
    return on


def render(starts: np.ndarray, ends: np.ndarray, frames: int, scale: float = 1.0) -> np.ndarray:
    """Cues as 0 and 1 on a grid of frames."""
    grid = np.zeros(frames)
    for a, b in zip(np.floor(starts * scale / FRAME_MS).astype(int), np.ceil(ends * scale / FRAME_MS).astype(int)):
        grid[max(a, 0) : max(b, 0)] = 1
    return grid


def correlate(voice: np.ndarray, cues: np.ndarray) -> tuple[int, float]:
    """Best lag of the cues in frames and how much it beats rivals more than RIVAL frames away."""
    n = 1 << int(np.ceil(np.log2(len(voice) + len(cues))))
    score = np.fft.irfft(np.fft.rfft(voice - voice.mean(), n) * np.conj(np.fft.rfft(cues - cues.mean(), n)), n)
    at = int(np.argmax(score))
    lag = at - n if at > n // 2 else at
    far = np.abs((np.arange(n) - at + n // 2) % n - n // 2) > RIVAL
    rival = score[far].max() if far.any() else 0.0
    return lag, float(score[at] / rival) if rival > 0 else float("inf") if score[at] > 0 else 0.0


def align(voice: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[float, int, float] | None:
    """(scale, offset in ms, confidence) that lays the cues on the voice best; None below the least confidence."""
    best = max(((s, *correlate(voice, render(starts, ends, len(voice), s))) for s in SCALES), key=lambda x: x[2])
    return None if best[2] < LEAST_CONFIDENCE else (best[0], best[1] * FRAME_MS, best[2])


def align_films(pairs: DataFrame) -> DataFrame:
    """(film, scale, offset_ms, confidence) of films (film, voice array<double>, starts, ends array<bigint>); null if refused."""

    def run(batches):
        for batch in batches:
            rows = []
            for film, voice, starts, ends in batch[["film", "voice", "starts", "ends"]].itertuples(index=False):
                found = align(np.asarray(voice, float), np.asarray(starts, float), np.asarray(ends, float)) if len(voice) and len(starts) else None
                rows.append((film, *(found or (None, None, None))))
            yield pd.DataFrame(rows, columns=["film", "scale", "offset_ms", "confidence"])

    kind = dict(pairs.dtypes)["film"]
    return pairs.mapInPandas(run, f"film {kind}, scale double, offset_ms bigint, confidence double")
