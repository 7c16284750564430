"""Periodic-box arithmetic on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def axes(dim: int) -> tuple[str, ...]:
    return AXES[:dim]


def wrap(x: Column, length: Column) -> Column:
    """Image of ``x`` inside ``[0, length)``."""
    return x - length * F.floor(x / length)


def min_image(dx: Column, length: Column) -> Column:
    """Separation to the nearest periodic image; ties go half-to-even (``rint``)."""
    return dx - length * F.rint(dx / length)


def norm(parts: list[Column]) -> Column:
    total = parts[0] * parts[0]
    for part in parts[1:]:
        total = total + part * part
    return F.sqrt(total)


def grid_index(x: Column, length: Column, n: Column) -> Column:
    """Cell of a wrapped coordinate; the far face belongs to the last cell."""
    return F.least(F.floor(x / length * n), n - 1).cast("long")


def axis_to_angles(ux: Column, uy: Column, uz: Column) -> tuple[Column, Column]:
    """(azimuth, polar) of a unit vector, both in ``[0, 2*pi)``."""
    def positive(angle: Column) -> Column:
        return F.when(angle < 0, angle + 2 * F.pi()).otherwise(angle)

    return positive(F.atan2(uy, ux)), positive(F.atan2(F.hypot(ux, uy), uz))
