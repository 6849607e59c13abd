"""Gains of spectral filters and wavelets as columns over an eigenvalue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def low_pass(lam: Column, cutoff: float, rolloff: float = 0.0) -> Column:
    return (lam <= cutoff).cast("double") if rolloff <= 0 else 1 / (1 + F.exp((lam - cutoff) / rolloff))


def high_pass(lam: Column, cutoff: float, rolloff: float = 0.0) -> Column:
    return 1 - low_pass(lam, cutoff, rolloff)


def band_pass(lam: Column, low: float, high: float, rolloff: float = 0.0) -> Column:
    if high < low:
        raise ValueError("high must not be under low")
    return high_pass(lam, low, rolloff) * low_pass(lam, high, rolloff) if rolloff > 0 else ((lam >= low) & (lam <= high)).cast("double")


def heat(lam: Column, time: float) -> Column:
    return F.exp(-time * lam)


def tikhonov(lam: Column, alpha: float) -> Column:
    return 1 / (1 + alpha * lam)


def power(lam: Column, strength: float, p: float) -> Column:
    return 1 / (1 + strength * F.pow(F.greatest(lam, F.lit(0.0)), F.lit(p)))


def wavelet(kernel: str, lam: Column, scale: Column) -> Column:
    z = lam * scale
    found = {
        "mexican_hat": F.greatest(z, F.lit(0.0)) * F.exp(-F.greatest(z, F.lit(0.0))),
        "heat": F.exp(-z),
        "band": z * z * F.exp(-z),
        "diffusion_difference": F.exp(-z) - F.exp(-2 * z),
    }
    if kernel not in found:
        raise ValueError(f"unknown kernel {kernel!r}")
    return found[kernel]
