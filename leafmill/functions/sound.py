"""Sound as arrays of samples: rates, silence, levels, fades, filters, pitch."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The resampling kernel, silence, the soft knee, fades, the two filters, the target level.
CROSSINGS, RESOLUTION, BETA, CUTOFF = 16, 256, 8.6, 0.97
QUIET, MARGIN_MS, FADE_MS = 0.004, 35, 6
KNEE, ROOM = 0.89, 0.1
RUMBLE, PRESENCE, PRESENCE_DB, WIDTH, PRESENCE_RATE = 75.0, 6500.0, 1.5, 0.7071, 16_000
TARGET, LEAST_GAIN, MOST_GAIN, KEEP = 0.085, 0.5, 3.0, 0.8


@lru_cache(1)
def _kernel() -> np.ndarray:
    """Half of a windowed sinc, RESOLUTION steps a sample."""
    x = np.arange(CROSSINGS * RESOLUTION + 1) / RESOLUTION
    return (np.sinc(x) * np.i0(BETA * np.sqrt(np.maximum(0, 1 - (x / CROSSINGS) ** 2))) / np.i0(BETA)).astype(np.float32)


def resampled(samples: np.ndarray, source: int, target: int) -> np.ndarray:
    """V9: samples at another rate, by a windowed sinc whose cut-off is below both halves of the rates."""
    if source == target or not len(samples):
        return samples
    step, cutoff, kernel = source / target, min(1.0, target / source) * CUTOFF, _kernel()
    place = np.arange(max(1, int(len(samples) / step))) * step
    reach = int(np.ceil(CROSSINGS / cutoff)) + 1
    out = np.zeros(len(place))
    for k in range(-reach, reach + 1):  # one tap for all outputs at a time
        index = np.floor(place).astype(np.int64) + k
        at = np.abs(place - index) * cutoff * RESOLUTION
        low = at.astype(np.int64)
        fits = (index >= 0) & (index < len(samples)) & (low < len(kernel) - 1)
        low, part = np.where(fits, low, 0), at - np.floor(at)
        weight = kernel[low] + (kernel[low + 1] - kernel[low]) * part
        out += np.where(fits, samples[np.clip(index, 0, len(samples) - 1)] * weight, 0)
    return (out * cutoff).astype(np.float32)


def speech_bounds(samples: np.ndarray, rate: int, quiet: float = QUIET, margin_ms: int = MARGIN_MS) -> tuple[int, int]:
    """[start, end) of what is not silence, with a margin; (0, 0) without a sound."""
    window, n = max(1, rate // 200), len(samples)
    loud = np.abs(samples) > quiet
    if not loud.any():
        return 0, 0
    start = int(loud.argmax()) // window * window
    last = n - int(loud[::-1].argmax())  # just past the last loud sample
    end = n - (n - last) // window * window
    margin = rate * margin_ms // 1000
    return max(0, start - margin), min(n, end + margin)


def trimmed(samples: np.ndarray, rate: int) -> np.ndarray:
    a, b = speech_bounds(samples, rate)
    return samples[a:b]


def with_gain(samples: np.ndarray, gain: float) -> np.ndarray:
    """Louder or softer, with a soft knee in place of clipping."""
    x = samples * np.float32(gain)
    size = np.abs(x)
    soft = np.copysign(KNEE + ROOM * np.tanh((size - KNEE) / ROOM), x)
    return np.where(size <= KNEE, x, soft).astype(np.float32)


def faded(samples: np.ndarray, rate: int, ms: int = FADE_MS) -> np.ndarray:
    """Both edges from and to silence."""
    n = min(len(samples) // 2, rate * ms // 1000)
    gain = np.ones(len(samples), np.float32)
    if n:
        gain[:n] = np.arange(n) / n
        gain[-n:] *= (np.arange(n) / n)[::-1]
    return samples * gain


def high_pass(rate: int, hz: float = RUMBLE) -> tuple[float, ...]:
    w = 2 * np.pi * hz / rate
    cos, alpha = np.cos(w), np.sin(w) / (2 * WIDTH)
    return tuple(x / (1 + alpha) for x in ((1 + cos) / 2, -(1 + cos), (1 + cos) / 2, -2 * cos, 1 - alpha))


def high_shelf(rate: int, hz: float = PRESENCE, db: float = PRESENCE_DB) -> tuple[float, ...]:
    w, a = 2 * np.pi * min(hz, rate * 0.45) / rate, 10 ** (db / 40)
    cos, edge = np.cos(w), 2 * np.sqrt(a) * np.sin(w) / 2 * np.sqrt(2)
    up, down = a + 1, a - 1
    top = (a * (up + down * cos + edge), -2 * a * (down + up * cos), a * (up + down * cos - edge))
    return tuple(x / (up - down * cos + edge) for x in (*top, 2 * (down - up * cos), up - down * cos - edge))


def filtered(samples: np.ndarray, section: tuple[float, ...]) -> np.ndarray:
    """One second-order section, in transposed direct form II; each output is rounded to a float."""
    b0, b1, b2, a1, a2 = section
    first = second = 0.0
    out = np.empty(len(samples), np.float32)
    for k, x in enumerate(samples.astype(float).tolist()):
        y = b0 * x + first
        first, second = b1 * x - a1 * y + second, b2 * x - a2 * y
        out[k] = y
    return out


def equalised(samples: np.ndarray, rate: int) -> np.ndarray:
    """Rumble taken out and consonants lifted."""
    if not len(samples) or rate <= 0:
        return samples
    low = filtered(samples, high_pass(rate))
    return filtered(low, high_shelf(rate)) if rate >= PRESENCE_RATE else low


def gains(levels: np.ndarray) -> np.ndarray:
    """A voice's gain line by line, from a slow average of its levels; silence has none and leaves no trace."""
    out, average = np.ones(len(levels)), None
    for k, level in enumerate(levels):
        if level > 0:
            average = level if average is None else KEEP * average + (1 - KEEP) * level
            out[k] = min(max(TARGET / average, LEAST_GAIN), MOST_GAIN)
    return out


def pitch(samples: np.ndarray, rate: int, low: float = 60.0, high: float = 400.0, threshold: float = 0.15) -> float:
    """The median pitch of voiced 40 ms frames by the cumulative mean normalised difference; 0 without any."""
    frame, shortest, longest = int(0.04 * rate), int(rate / high), int(rate / low)
    if len(samples) <= frame + longest:
        return 0.0
    loud = np.percentile(np.abs(samples), 95) or 1.0
    starts = np.arange(0, len(samples) - frame - longest, frame // 2)
    x = np.lib.stride_tricks.sliding_window_view(samples.astype(np.float64), frame + longest)[starts]
    x = x[np.sqrt((x[:, :frame] ** 2).mean(1)) >= 0.05 * loud]
    if not len(x):
        return 0.0
    lags = np.arange(longest + 1)
    diff = np.stack([((x[:, :frame] - x[:, k : k + frame]) ** 2).sum(1) for k in lags], axis=1)
    sums = np.cumsum(diff[:, 1:], axis=1)
    norm = np.ones_like(diff)
    norm[:, 1:] = diff[:, 1:] * lags[1:] / np.where(sums == 0, 1, sums)
    found = []
    for row in norm:
        below = np.flatnonzero(row[shortest:] < threshold)
        if len(below):
            lag = shortest + int(below[0])
            rises = np.flatnonzero(row[lag + 1 :] >= row[lag:-1])
            found.append(rate / (lag + int(rises[0]) if len(rises) else longest))
    return float(np.median(found)) if found else 0.0


@F.pandas_udf(T.ArrayType(T.FloatType()))
def prepared(samples: pd.Series, rate: pd.Series, target: pd.Series) -> pd.Series:
    """Lines trimmed, equalised, faded and brought to a rate."""
    return pd.Series([faded(resampled(equalised(trimmed(np.asarray(s, np.float32), int(r)), int(r)), int(r), int(t)), int(t)) for s, r, t in zip(samples, rate, target, strict=True)])


@F.pandas_udf(T.DoubleType())
def median_pitch(samples: pd.Series, rate: pd.Series) -> pd.Series:
    return pd.Series([pitch(np.asarray(s, np.float32), int(r)) for s, r in zip(samples, rate, strict=True)])
