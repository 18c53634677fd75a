"""Spectral features of signal cells: Arrow-batched numpy kernels, as Spark has no Fourier transform.

One UDF computes all asked features of a cell, so its spectrum is computed once. Cells of
equal length are stacked and transformed together.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Level of quiet (dB) of the 24 Bark bands.
QUIET = np.array([44, 32, 25, 19, 14, 11, 8, 6] + [5] * 16, float)
BARKS = 24
#: Fixed value: upper edge of the last Bark band, Hz.
TOP_HZ = 15500.0


def bark(hz: np.ndarray | float) -> np.ndarray | float:
    return 13.0 * np.arctan(0.00076 * hz) + 3.5 * np.arctan((hz / 7500.0) ** 2)


def bark_edges() -> np.ndarray:
    """Hz at 0, 1, ... 24 Bark, by bisection of all edges at once."""
    z = np.arange(BARKS + 1)
    low, high = np.zeros(BARKS + 1), np.full(BARKS + 1, 20000.0)
    for _ in range(50):
        mid = (low + high) / 2
        under = bark(mid) < z
        low, high = np.where(under, mid, low), np.where(under, high, mid)
    out = (low + high) / 2
    out[0], out[-1] = 0.0, TOP_HZ
    return out


_EDGES = bark_edges()


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal, along the last axis."""
    n = x.shape[-1]
    if n < 2:
        return np.abs(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * gain))


def band_pass(x: np.ndarray, rate: float, low: float, high: float | None) -> np.ndarray:
    n = x.shape[-1]
    if n < 2:
        return x
    hz = np.fft.rfftfreq(n, 1 / rate)
    return np.fft.irfft(np.fft.rfft(x) * ((hz >= low) & (hz <= (rate / 2 if high is None else high))), n)


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Raw autocorrelation at lags 0 to n - 1, along the last axis."""
    n = x.shape[-1]
    size = 1 << (2 * n - 1).bit_length()
    s = np.fft.rfft(x, size)
    return np.fft.irfft(s * np.conj(s), size)[..., :n]


def kurtosis(x: np.ndarray) -> float:
    if len(x) < 2 or (s := np.std(x, ddof=1)) == 0:
        return 0.0
    return float(np.mean((x - x.mean()) ** 4) / s**4 - 3)


def hnr(x: np.ndarray) -> float:
    """Harmonics-to-noise ratio, dB, from the highest autocorrelation beyond lag 0."""
    if len(x) < 3:
        return 0.0
    r = autocorrelation(x - x.mean())
    if r[0] == 0:
        return 0.0
    top = float(np.clip((r[1:] / r[0]).max(), 0.0, 0.999999))
    return 10 * math.log10(top / (1 - top)) if top > 0 else -math.inf


def welch(x: np.ndarray) -> np.ndarray:
    """Power density: periodic Hann windows of 256 values or fewer, half overlapped, means removed."""
    size = min(256, len(x))
    step = size - size // 2
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / size))
    count = max(1, (len(x) - size // 2) // step)
    parts = np.stack([x[i * step : i * step + size] for i in range(count)])
    power = (np.abs(np.fft.rfft((parts - parts.mean(axis=1, keepdims=True)) * hann)) ** 2).sum(axis=0) / (count * (hann**2).sum())
    inner = slice(1, -1) if size % 2 == 0 else slice(1, None)
    power[inner] *= 2
    return power


def spectral_entropy(x: np.ndarray) -> float:
    if len(x) < 2:
        return 0.0
    p = welch(x)
    if p.sum() <= 0:
        return 0.0
    p = p / p.sum()
    p = p[p > 0]
    return float(-(p * np.log2(p)).sum() / np.log2(len(p))) if len(p) > 1 else 0.0


def sharpness(x: np.ndarray, rate: float) -> float:
    """Loudness-weighted centroid over the Bark bands."""
    if len(x) < 2:
        return 0.0
    hz = np.fft.rfftfreq(len(x), 1 / rate)
    band = np.searchsorted(_EDGES, hz, "right") - 1
    inside = band < BARKS
    power = np.bincount(band[inside], (np.abs(np.fft.rfft(x)) ** 2 / len(x))[inside], BARKS)
    level = 10 * np.log10(np.maximum(power, 1e-20) / 1e-12) - QUIET
    loud = np.where(level > 0, 0.08 * (10 ** (level / 10)) ** 0.23, 0.0)
    z = np.arange(BARKS) + 0.5
    weight = np.where(z > 15, 0.066 * np.exp(0.171 * z), 1.0)
    return float(0.11 * (loud * weight * z).sum() / loud.sum()) if loud.sum() > 0 else 0.0


def roughness(x: np.ndarray, rate: float) -> float:
    """Sum over Bark bands of modulation depth times a weight that peaks at 70 Hz, by band power."""
    n = len(x)
    if n < 8:
        return 0.0
    hz = np.abs(np.fft.fftfreq(n, 1 / rate))
    mask = (hz >= _EDGES[:-1, None]) & (hz < _EDGES[1:, None])
    mask[:, 0] = False
    bands = np.fft.ifft(np.fft.fft(x) * mask).real
    power = (bands**2).mean(axis=1)
    env = envelope(bands)
    centre = env.mean(axis=1)
    first = max(1, int(rate / 500))
    if first >= n:
        return 0.0
    out = 0.0
    for b in np.flatnonzero((power >= 1e-20) & (centre > 0)):
        swing = env[b] - centre[b]
        depth = min(swing.std() / centre[b], 1.0)
        r = autocorrelation(swing)
        if depth <= 0 or r[0] <= 0:
            continue
        lag = int(np.argmax(r[first:])) + first
        if r[lag] <= 0:
            continue
        f = rate / lag / 70.0
        out += 0.3 * depth * f * math.exp(1 - f) * power[b]
    return float(out)


def _level(spectrum: np.ndarray, half: int) -> np.ndarray:
    """The spectrum over a two-sided moving baseline of 2 * half + 1 bins."""
    n, win = len(spectrum), max(2 * half + 1, 3)
    if n < win:
        return spectrum
    moving = np.convolve(spectrum, np.ones(win) / win, "valid")
    i, ahead = np.arange(n), 2 * half - 1
    has_ahead = i < max(len(moving) - ahead, 0)
    base = np.where(has_ahead, moving[np.minimum(i + ahead, len(moving) - 1)], 1.0)
    behind = (i >= 3 * half) & (i < 3 * half + len(moving))
    both, only = behind & has_ahead, behind & ~has_ahead
    base[both] = (base[both] + moving[: both.sum()]) / 2
    base[only] = moving[: only.sum()]
    return spectrum / np.maximum(base, 1e-10)


def speed_rpm(x: np.ndarray, rate: float, slowest: float, fastest: float, harmonics: int = 5, delta: float = 10.0, least_std: float = 0.01) -> float:
    """Rotation speed by the harmonic product spectrum, with peaks validated at the harmonics."""
    n = len(x)
    if n < 2 or np.std(x) < least_std:
        return 0.0
    level = _level(np.abs(np.fft.rfft(x)), max(1, math.ceil(delta / 60 * n / rate)))
    size = len(level) // harmonics
    product = sum(np.log(np.maximum(level[::h][:size], 1e-30)) for h in range(1, harmonics + 1)) if size and len(level) > 1 else np.zeros(1)
    low, high = max(1, int(slowest / 60 * n / rate)), min(math.ceil(fastest / 60 * n / rate), len(product) - 1)
    if low >= high:
        return 0.0
    part = np.concatenate([[-np.inf], product[low : high + 1], [-np.inf]])
    peaks = np.flatnonzero((part[1:-1] > part[:-2]) & (part[1:-1] > part[2:])) + low
    if not len(peaks):
        best = low + int(np.argmax(product[low : high + 1]))
        return float(best / n * rate * 60)
    around = np.concatenate([[-np.inf], level, [-np.inf]])
    is_peak = (level > around[:-2]) & (level > around[2:])

    def rank(c: int) -> tuple[int, float]:
        at = [c * h for h in range(1, harmonics + 1) if c * h < len(level)]
        above = 0.0
        for b in at:
            w = max(2, b // 4)
            near = np.concatenate([level[max(0, b - w) : b], level[b + 1 : b + w + 1]])
            above += level[b] - near.mean() if len(near) else level[b]
        return int(is_peak[at].sum()), float(above)

    best = int(peaks[0]) if len(peaks) == 1 else max((int(c) for c in peaks), key=rank)
    return float(best / n * rate * 60)


def _moments(x: np.ndarray, rate: float) -> dict[str, np.ndarray]:
    """Power-weighted frequency moments of stacked cells."""
    n = x.shape[1]
    zero = np.zeros(len(x))
    if n < 2:
        return dict.fromkeys(("centroid", "mean_square_frequency", "rms_frequency", "frequency_variance", "frequency_std"), zero)
    hz = np.fft.rfftfreq(n, 1 / rate)
    p = np.abs(np.fft.rfft(x)) ** 2
    all_p = p.sum(axis=1)
    safe = np.where(all_p > 0, all_p, 1.0)
    on = all_p > 0
    c = np.where(on, p @ hz / safe, 0.0)
    ms = np.where(on, p @ hz**2 / safe, 0.0)
    v = np.where(on, (p * (hz[None, :] - c[:, None]) ** 2).sum(axis=1) / safe, 0.0)
    return {"centroid": c, "mean_square_frequency": ms, "rms_frequency": np.sqrt(ms), "frequency_variance": v, "frequency_std": np.sqrt(v)}


def _rms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x**2).mean(axis=1))


#: Features of one cell each; those of ``_moments``, envelope_rms and band_rms work on stacked cells.
SINGLE: dict[str, Callable[..., float]] = {
    "entropy": lambda x, o: spectral_entropy(x),
    "hnr": lambda x, o: hnr(x),
    "sharpness": lambda x, o: sharpness(x, o["rate"]),
    "roughness": lambda x, o: roughness(x, o["rate"]),
    "band_kurtosis": lambda x, o: kurtosis(band_pass(x, o["rate"], o["low"], o["high"])),
    "band_hnr": lambda x, o: hnr(band_pass(x, o["rate"], o["low"], o["high"])),
    "speed_rpm": lambda x, o: speed_rpm(x, o["rate"], o["speed_min"], o["speed_max"], o["n_harmonics"], o["speed_delta"], o["std_min"]),
}
STACKED = ("centroid", "mean_square_frequency", "rms_frequency", "frequency_variance", "frequency_std", "envelope_rms", "band_rms")


def compute(cells: list[np.ndarray], names: list[str], options: dict) -> dict[str, np.ndarray]:
    """The named features of all cells."""
    out = {n: np.zeros(len(cells)) for n in names}
    sizes = np.array([len(x) for x in cells])
    stacked = [n for n in names if n in STACKED]
    for size in np.unique(sizes) if stacked else []:
        at = np.flatnonzero(sizes == size)
        if not size:
            continue
        x = np.stack([cells[i] for i in at])
        found = _moments(x, options["rate"]) if set(stacked) - {"envelope_rms", "band_rms"} else {}
        if "envelope_rms" in stacked:
            found["envelope_rms"] = _rms(envelope(x)) if size > 1 else np.zeros(len(at))
        if "band_rms" in stacked:
            found["band_rms"] = _rms(band_pass(x, options["rate"], options["low"], options["high"]))
        for n in stacked:
            out[n][at] = found[n]
    for n in names:
        if n in SINGLE:
            out[n] = np.array([SINGLE[n](x, options) if len(x) else 0.0 for x in cells])
    return out


DEFAULTS = {"rate": 1.0, "low": 0.0, "high": None, "speed_min": 0.0, "speed_max": 6000.0, "n_harmonics": 5, "speed_delta": 10.0, "std_min": 0.01}


def features(c: Column, names: list[str], **options: float | None) -> Column:
    """struct of the named features (``STACKED`` and ``SINGLE``) of an array<double> column, in one pass."""
    unknown = set(names) - set(STACKED) - set(SINGLE)
    if unknown:
        raise ValueError(f"no spectral features {sorted(unknown)}")
    settings = DEFAULTS | options

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def kernel(cells: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(compute([np.asarray(x, float) if x is not None else np.zeros(0) for x in cells], names, settings))

    return kernel(c)
