"""Signal operators on voxel arrays."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.arrays import AXES, bind
from lumenframe.operators.steps import REQUIRED, Step

FWHM_PER_SIGMA = 2 * math.sqrt(2 * math.log(2))


def fwhm_to_sigma(fwhm: float) -> float:
    return fwhm / FWHM_PER_SIGMA


def sigma_to_fwhm(sigma: float) -> float:
    return sigma * FWHM_PER_SIGMA


def gauss_kernel(sigma: float) -> list[float]:
    """Normalised weights, int(3 sigma + 1) on each side."""
    half = int(3 * sigma + 1)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def convolve(values: Column, dims: Column, kernel: list[float], axis: str = "c", sequential: bool = False) -> Column:
    """Centred convolution along an axis, zeros beyond the border.

    ``sequential`` reads neighbours that were already replaced, as a pass in place does: then element i uses the new values
    before it.  That form is inherently one after another and only there for comparison.
    """
    k, half = AXES.index(axis), len(kernel) // 2
    below = F.lit(1)
    for a in AXES[:k]:
        below = below * dims[a]
    n = dims[axis]
    place = lambda i: F.floor(i / below).cast("int") % n

    def at(source: Column, i: Column, here: Column) -> Column:
        out = F.lit(0.0)
        for j, w in enumerate(kernel):
            o = j - half
            inside = (here + o >= 0) & (here + o < n)
            out = out + F.when(inside, F.get(source, (i + o * below).cast("int")).cast("double") * w).otherwise(0.0)
        return out

    if not sequential:
        return bind(values, lambda v: F.transform(v, lambda _, i: at(v, i, place(i))))
    index = F.sequence(F.lit(0), F.size(values) - 1)
    start = F.transform(values, lambda x: x.cast("double"))
    return F.aggregate(index, start, lambda a, i: F.transform(a, lambda x, j: F.when(j == i, at(a, i, place(i))).otherwise(x)))


def gauss(chunks: DataFrame, sigma: float | None = None, fwhm: float | None = None, axes: str = "crs", spacing: dict[str, float] | None = None) -> DataFrame:
    """Separable Gauss filter over chunks (voxels, dims); with ``spacing`` (by axis) sigma is in physical units."""
    s = sigma if sigma is not None else fwhm_to_sigma(fwhm)
    d = chunks
    for a in axes:
        kernel = gauss_kernel(s / (spacing or {}).get(a, 1.0))
        d = d.withColumn("voxels", convolve(F.col("voxels"), F.col("dims"), kernel, a))
    return d


def _one_width(parameters: dict, _: dict) -> str | None:
    given = [k for k in ("sigma", "fwhm") if parameters[k] is not None]
    if len(given) != 1:
        return "exactly one of sigma and fwhm is needed"
    if parameters[given[0]] <= 0:
        return f"{given[0]} must be above 0"
    return None if set(parameters["axes"]) <= set(AXES) else f"axes are some of {', '.join(AXES)}"


#: The Gauss filter as a step with checked parameters.
GAUSS = Step("gauss", lambda d, p, _: (gauss(d, p["sigma"], p["fwhm"], p["axes"], p["spacing"]), {"sigma": p["sigma"] if p["sigma"] is not None else fwhm_to_sigma(p["fwhm"])}), {"sigma": None, "fwhm": None, "axes": "crs", "spacing": None}, valid=_one_width)


def _weighted(d: DataFrame, parameters: dict, inputs: dict[str, DataFrame]) -> DataFrame:
    key = parameters["by"]
    weights = inputs["weights"].select(F.col(key).alias("__key"), F.col("weight").cast("double").alias("__weight"))
    joined = d.join(weights, F.col(key).eqNullSafe(F.col("__key")), "left")
    return joined.withColumn("voxels", F.transform("voxels", lambda x: x * F.coalesce("__weight", F.lit(1.0)))).drop("__key", "__weight")


#: Voxels times the weight that the input ``weights`` (key, weight) has for their key; 1 where it has none.
WEIGHTED = Step("weighted", _weighted, {"by": REQUIRED}, labels=("weights",))


def band_response(n: int, step: float, low: float | None, high: float | None, steepness: float, stop: bool = False) -> np.ndarray:
    """Gain at the frequencies of a real transform: sigmoid edges at ``low`` (high pass) and ``high`` (low pass), in 1 / unit of step."""
    f = np.fft.rfftfreq(n, step)
    gain = np.ones_like(f)
    edge = lambda x: 1 / (1 + np.exp(np.clip(x, -700, 700)))
    if low is not None:
        gain *= edge(-(f - low) * steepness)
    if high is not None:
        gain *= edge((f - high) * steepness)
    return 1 - gain if stop else gain


def filter_series(values: np.ndarray, step: float, low: float | None, high: float | None, steepness: float = 1000.0, stop: bool = False) -> np.ndarray:
    """A series with mirrored tails, its mean kept, filtered in frequency."""
    n = len(values)
    if n < 2:
        return values.astype(float)
    mean = values.mean()
    x = values - mean
    padded = np.concatenate([x[::-1], x, x[::-1]])
    spectrum = np.fft.rfft(padded) * band_response(len(padded), step, low, high, steepness, stop)
    return np.fft.irfft(spectrum, len(padded))[n : 2 * n] + mean


def frequency_filter(series: DataFrame, keys: list[str], order: str, value: str, step: float, low: float | None = None, high: float | None = None, steepness: float = 1000.0, stop: bool = False) -> DataFrame:
    """Each series (by keys, in order) filtered; a transform needs all samples of a series in one place.

    ``low`` and ``high`` are wavelengths' frequencies in 1 / unit of ``step`` (seconds between samples).
    """
    kept = [f.name for f in series.schema if f.name in (*keys, order)]
    schema = ", ".join(f"`{n}` {series.schema[n].dataType.simpleString()}" for n in kept) + ", filtered double"

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order, kind="stable")
        out = g[kept].copy()
        out["filtered"] = filter_series(g[value].to_numpy(float), step, low, high, steepness, stop)
        return out

    return series.groupBy(*keys).applyInPandas(run, schema)
