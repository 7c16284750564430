"""Names: resolution labels, snake-case types, phase labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _short(number: Column) -> Column:
    """A number with up to six digits and no trailing zeros."""
    text = F.format_number(number, 6)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ",", ""), "0+$", ""), "\\.$", "")


def resolution_label(element: Column, mesh_size: Column, per_particle: Column) -> Column:
    """``tri6``, ``tri6_h0.05``, ``tri6_h0.05_epp4``: what was asked for, the rest left out."""
    return F.concat_ws("_", element, F.concat(F.lit("h"), _short(mesh_size)), F.concat(F.lit("epp"), _short(per_particle)))


def type_name(kind: Column) -> Column:
    """``CylindricalFiber`` as ``cylindrical_fiber``."""
    return F.lower(F.regexp_replace(kind, "(?<!^)([A-Z])", "_$1"))
