"""Convex outlines from the Fourier coefficients of their normal density."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_density(phi: Column, re: Column, im: Column) -> Column:
    """rho(phi) = c_0 + sum over n >= 2 of Re(c_n e^{i n phi}); the first harmonic closes the outline and is left out."""
    n = F.sequence(F.lit(0), F.size(re) - 1)
    terms = F.transform(n, lambda k: F.when(k == 0, F.get(re, k)).when(k == 1, F.lit(0.0)).otherwise(
        F.get(re, k) * F.cos(k * phi) - F.get(im, k) * F.sin(k * phi)))
    return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)


def outline_point(phi: Column, re: Column, im: Column) -> tuple[Column, Column]:
    """Point of the outline whose tangent makes ``phi`` with the first axis, starting from the origin.

    With I(phi) the integral of rho(t) (cos t, sin t) / (2 pi) from 0 to phi, taken a harmonic
    at a time, the point is (-I_y, -I_x): the outline is seen from its inner normal.
    """
    n = F.sequence(F.lit(0), F.size(re) - 1)

    def harmonic(k: Column, cosine: bool) -> Column:
        up, down = (k + 1).cast("double"), (k - 1).cast("double")
        c_up, s_up = (1 - F.cos(up * phi)) / up, F.sin(up * phi) / up
        c_down, s_down = (1 - F.cos(down * phi)) / down, F.sin(down * phi) / down
        if cosine:
            return (F.get(re, k) * (s_up + s_down) - F.get(im, k) * (c_up + c_down)) / 2
        return (F.get(re, k) * (c_up - c_down) + F.get(im, k) * (s_up - s_down)) / 2

    def integral(cosine: bool) -> Column:
        mean = F.sin(phi) if cosine else 1 - F.cos(phi)
        terms = F.transform(n, lambda k: F.when(k == 0, F.get(re, k) * mean).when(k == 1, F.lit(0.0)).otherwise(harmonic(k, cosine)))
        return F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / (2 * F.pi())

    return -integral(False), -integral(True)
