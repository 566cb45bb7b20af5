"""Waveform operators whose state is sequential or numeric: numpy kernels behind Arrow functions.

A signal is an array of floats. Every kernel takes (signal, params, seed), so
``apply`` can fold a chain of operators over a row in one Python call. External
encoders are no part of the engine; ``register`` adds a kernel by name.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray, dict, int], np.ndarray]
KERNELS: dict[str, Kernel] = {}
RATE = 16000


def register(name: str) -> Callable[[Kernel], Kernel]:
    def add(kernel: Kernel) -> Kernel:
        KERNELS[name] = kernel
        return kernel

    return add


def limit(x: np.ndarray, top: float = 0.98) -> np.ndarray:
    peak = np.abs(x).max(initial=0.0)
    return np.tanh(2 * x) / np.tanh(2) * top if peak > top else x


@register("packet_loss")
def packet_loss(x: np.ndarray, params: dict, seed: int) -> np.ndarray:
    """Two-state losses of 20 ms frames with bursts; lost frames repeat the last good one (repeat) or fade it, are interpolated or filled with noise."""
    random, size = np.random.default_rng(seed), max(1, int(params.get("frame", RATE // 50)))
    n = -(-len(x) // size)
    out = np.zeros(n * size)
    out[: len(x)] = x
    frames = out.reshape(n, size)
    loss, burst = float(params.get("loss_rate_pct", 1)) / 100, max(1.0, float(params.get("avg_burst_frames", 2)))
    leave = 1 / burst
    enter = min(1.0, loss * leave / max(1e-9, 1 - loss))
    draws, bad, lost = random.random(n), False, np.zeros(n, bool)
    for k in range(n):  # a Markov chain, a step for each frame
        bad = draws[k] < enter if not bad else draws[k] >= leave
        lost[k] = bad
    good = np.flatnonzero(~lost)
    how = params.get("concealment", "repeat_fade")
    for k in np.flatnonzero(lost):
        before = good[good < k]
        last = frames[before[-1]] if len(before) else np.zeros(size)
        if how == "noise_fill":
            frames[k] = random.normal(0, max(1e-4, last.std()), size)
        elif how == "interpolate":
            after = good[good > k]
            following = frames[after[0]] if len(after) else last
            frames[k] = (last + following) / 2
        elif how == "repeat":
            frames[k] = last
        else:
            frames[k] = last * 0.8 ** (k - before[-1] if len(before) else 1)
    return out[: len(x)]


@register("noise")
def noise(x: np.ndarray, params: dict, seed: int) -> np.ndarray:
    """Coloured noise at a signal-to-noise ratio: white, pink, brown, babble, hiss or hum."""
    random, n = np.random.default_rng(seed), len(x)
    if not n:
        return x
    kind, t = params.get("noise_type", "white"), np.arange(n) / RATE
    white = random.normal(size=n)
    if kind in ("pink", "brown"):
        spectrum = np.fft.rfft(white)
        spectrum /= np.maximum(1, np.arange(len(spectrum))) ** (0.5 if kind == "pink" else 1.0)
        made = np.fft.irfft(spectrum, n)
    elif kind == "hum":
        made = sum(np.sin(2 * np.pi * 50 * h * t) / h for h in (1, 2, 3)) * (1 + 0.1 * np.sin(2 * np.pi * 0.5 * t))
    elif kind == "babble":
        made = sum(random.normal(size=n) * (1 + np.sin(2 * np.pi * random.uniform(2, 5) * t + random.uniform(0, 6))) for _ in range(4))
    elif kind == "hiss":
        made = np.diff(white, prepend=0.0) * (1 + 0.2 * np.sin(2 * np.pi * 0.3 * t))
    else:
        made = white
    power, own = np.mean(x**2), np.mean(made**2)
    gain = np.sqrt(max(power, 1e-12) / max(own, 1e-12) / 10 ** (float(params.get("snr_db", 20)) / 10))
    return limit(x + gain * made)


@functools.lru_cache(maxsize=64)
def _decay(n: int, rt60: float) -> np.ndarray:
    return 10 ** (-3 * np.arange(n) / (rt60 * RATE))


def impulse_response(params: dict, seed: int) -> np.ndarray:
    """A direct path, random reflections that decay by 60 dB in rt60, and a decaying floor."""
    random, rt60 = np.random.default_rng(seed), float(params.get("rt60", 0.4))
    n = max(8, int(rt60 * RATE))
    decay = _decay(n, rt60)
    out = random.normal(size=n)
    out *= 0.01
    out *= decay
    at = random.integers(1, n, 24)
    out[at] += random.uniform(-0.5, 0.5, 24) * decay[at]
    out[0] = 1 / max(0.5, float(params.get("distance", 1)))
    return out / max(out.max(), -out.min())


def convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Directly for small products, by FFT beyond; as long as ``x``, so later parts of ``h`` are never heard."""
    h = h[: len(x)]
    if len(x) * len(h) <= 2_000_000:
        return np.convolve(x, h)[: len(x)]
    size = 1 << (len(x) + len(h) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[: len(x)]


@register("rir")
def reverberate(x: np.ndarray, params: dict, seed: int) -> np.ndarray:
    return limit(convolve(x, impulse_response(params, seed))) if len(x) else x


@register("jitter")
def jitter(x: np.ndarray, params: dict, seed: int) -> np.ndarray:
    """Frames displaced by up to jitter_ms, overlapped and added under a triangular window."""
    shift, size = int(float(params.get("jitter_ms", 8)) * RATE / 1000), max(2, int(params.get("frame", RATE // 50)))
    if not shift or len(x) < size:
        return x
    random, hop = np.random.default_rng(seed), size // 2
    window, out, weight = np.bartlett(size + 2)[1:-1], np.zeros(len(x)), np.full(len(x), 1e-9)
    for start in range(0, len(x) - size + 1, hop):
        to = int(np.clip(start + random.integers(-shift, shift + 1), 0, len(x) - size))
        out[to : to + size] += x[start : start + size] * window
        weight[to : to + size] += window
    return out / np.maximum(weight, 1e-3)


@register("bandlimit")
def bandlimit(x: np.ndarray, params: dict, seed: int) -> np.ndarray:
    """Narrow band 250 to 3400 Hz or wide band 50 to 7000 Hz, by FFT."""
    low, high = (250, 3400) if str(params.get("mode", "NB")).upper() == "NB" else (50, 7000)
    spectrum, f = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / RATE) if len(x) else np.zeros(0)
    return np.fft.irfft(np.where((f >= low) & (f <= high), spectrum, 0), len(x)) if len(x) else x


@register("resample")
def resample(x: np.ndarray, params: dict, seed: int) -> np.ndarray:
    """A mode such as 16k_to_8k_to_16k, by linear interpolation from rate to rate."""
    rates = [int(p.rstrip("k")) for p in str(params.get("mode", "16k_to_16k")).split("_to_")]
    for a, b in zip(rates, rates[1:]):
        n = len(x) * b // a
        x = np.interp(np.arange(n) * a / b, np.arange(len(x)), x) if n else x[:0]
    return x


def _mu_law(x: np.ndarray) -> np.ndarray:
    y = np.sign(x) * np.log1p(255 * np.minimum(np.abs(x), 1)) / np.log(256)
    y = np.round(y * 127) / 127
    return np.sign(y) * np.expm1(np.abs(y) * np.log(256)) / 255


def _a_law(x: np.ndarray) -> np.ndarray:
    a, m = 87.6, np.minimum(np.abs(x), 1)
    whole = 1 + np.log(a)
    y = np.where(m < 1 / a, a * m, 1 + np.log(np.maximum(a * m, 1))) / whole
    y = np.round(y * 127) / 127 * whole
    return np.sign(x) * np.where(y < 1, y, np.exp(np.maximum(y, 1) - 1)) / a


@register("codec")
def companded(x: np.ndarray, params: dict, seed: int) -> np.ndarray:
    """A round trip through eight bits, A-law for ``pcm_alaw``, else mu-law; what needs an encoder outside the engine is registered by name."""
    return _a_law(x) if params.get("codec") == "pcm_alaw" else _mu_law(x)


KERNELS["reencode"] = companded


@register("call_path")
def call_path(x: np.ndarray, params: dict, seed: int) -> np.ndarray:
    """Band, codec, burst loss, jitter and gain control, one after another."""
    for name, own in (("bandlimit", {"mode": params.get("profile", "NB")}), ("codec", params), ("packet_loss", params), ("jitter", params)):
        x = KERNELS[name](x, own, seed)
    peak = np.abs(x).max(initial=0.0)
    return x * (0.7 / peak) if params.get("agc_profile") and peak > 0 else x


def apply(rows: DataFrame, signal: str, operators: str, seed: Column, out: str = "rendered") -> DataFrame:
    """``rows`` with ``operators`` (JSON list of objects with op) folded over ``signal``; null without a signal or with text that isn't JSON. An unknown operator is an error."""
    import json

    import pandas as pd

    @F.pandas_udf("array<double>")
    def fold(x, ops, seeds):
        result = []
        for signal_, text, s in zip(x, ops, seeds):
            try:
                steps = json.loads(text or "[]")
            except ValueError:
                steps = None
            if signal_ is None or steps is None:
                result.append(None)
                continue
            unknown = [o.get("op") for o in steps if o.get("op") not in KERNELS]
            if unknown:
                raise ValueError(f"unknown operators: {unknown}")
            y = np.nan_to_num(np.asarray(signal_, float))
            for k, o in enumerate(steps):
                y = KERNELS[o["op"]](y, o, int(s) + k)
            result.append(y.tolist())
        return pd.Series(result, dtype=object)

    return rows.withColumn(out, fold(F.col(signal), F.col(operators), seed))


def quality(rows: DataFrame, signal: str, rate: int = RATE, floor_db: float = -50.0, least_sec: float = 0.5) -> DataFrame:
    """``rows`` with mean_db, max_db and silence_sec: the seconds in runs of at least ``least_sec`` below ``floor_db``. Null without samples."""
    import pandas as pd

    @F.pandas_udf("mean_db double, max_db double, silence_sec double")
    def of(x):
        out = []
        for s in x:
            y = np.abs(np.nan_to_num(np.asarray(s if s is not None else [], float)))
            if not len(y):
                out.append((None, None, None))
                continue
            quiet = np.concatenate([[0], (y < 10 ** (floor_db / 20)).astype(np.int8), [0]])
            turns = np.flatnonzero(np.diff(quiet))
            runs = turns[1::2] - turns[::2]
            out.append((10 * np.log10(max(np.mean(y**2), 1e-12)), 20 * np.log10(max(y.max(), 1e-6)), float(runs[runs >= least_sec * rate].sum()) / rate))
        return pd.DataFrame(out, columns=["mean_db", "max_db", "silence_sec"])

    return rows.withColumn("__q", of(F.col(signal))).select(*rows.columns, "__q.*")
