"""Exact separation of convex pairs: least over directions of the widths less the offset.

All registered shapes are symmetric about their centre, so two of them overlap exactly when
h_A(u) + h_B(u) - d.u stays positive for every unit u, and its least value is the depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packstat.functions.periodic import axes
from packstat.functions.shapes import by_shape

#: Directions tried before the descent, and the angle at which it stops.
COARSE = {2: 128, 3: 400}
FINEST = 1e-9


def _directions(dim: int) -> np.ndarray:
    n = COARSE[dim]
    if dim == 2:
        t = 2 * np.pi * np.arange(n) / n
        return np.stack([np.cos(t), np.sin(t)], axis=1)
    k = np.arange(n) + 0.5
    z, t = 1 - 2 * k / n, np.pi * (1 + 5 ** 0.5) * k
    s = np.sqrt(1 - z * z)
    return np.stack([s * np.cos(t), s * np.sin(t), z], axis=1)


def _widths(batch: pd.DataFrame, side: str, u: np.ndarray) -> np.ndarray:
    """Width of every row's particle along its directions ``u`` of shape (rows, directions, dim)."""
    dim = u.shape[2]
    col = lambda name: batch[side + name].to_numpy(float)[:, None]
    has = lambda name: side + name in batch
    kind = batch[side + "shape"].to_numpy()[:, None]
    out = np.zeros(u.shape[:2])
    if has("r"):
        out = np.where(np.isin(kind, ("Disk", "Sphere", "CylindricalFiber")), col("r"), out)
    if dim == 2:
        if has("side"):
            out = np.where(kind == "Square", col("side") / 2 * np.abs(u).sum(axis=2), out)
        if has("major_axis"):
            c, s = np.cos(col("angle")), np.sin(col("angle"))
            a = col("major_axis") / 2 * (u[:, :, 0] * c + u[:, :, 1] * s)
            b = col("minor_axis") / 2 * (u[:, :, 1] * c - u[:, :, 0] * s)
            out = np.where(kind == "Ellipse", np.hypot(a, b), out)
        return out
    if has("m11"):
        local = [sum(u[:, :, j] * col(f"m{i + 1}{j + 1}") for j in range(3)) for i in range(3)]
        if has("axis_1"):
            q = sum((col(f"axis_{i + 1}") / 2 * local[i]) ** 2 for i in range(3))
            out = np.where(kind == "Ellipsoid", np.sqrt(q), out)
        if has("r_cyl"):
            across = np.sqrt(np.maximum(1 - local[0] ** 2, 0))
            out = np.where(kind == "Cylinder", col("length") / 2 * np.abs(local[0]) + col("r_cyl") * across, out)
    return out


def _across(v: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """The part of ``v`` square to a unit axis."""
    return v - np.einsum("nj,nj->n", v, axis)[:, None] * axis


def _normals(batch: pd.DataFrame, d: np.ndarray) -> np.ndarray:
    """Directions in which kinks of turned bodies lie: their axes, products of these, offsets square to them."""
    sides = [s for s in ("a_", "b_") if s + "m11" in batch]
    frames = [np.nan_to_num(batch[[f"{s}m{i}{j}" for j in (1, 2, 3)]].to_numpy(float)) for s in sides for i in (1, 2, 3)]
    found = [*frames, *[_across(d, frames[3 * k]) for k in range(len(sides))]]
    if len(sides) == 2:
        found += [np.cross(p, q) for p in frames[:3] for q in frames[3:]]
        found += [_across(frames[3], frames[0]), _across(frames[0], frames[3])]
    if not found:
        return np.zeros((len(d), 0, 3))
    out = np.stack(found, axis=1)
    size = np.linalg.norm(out, axis=2, keepdims=True)
    out = np.where(size > 1e-12, out / np.where(size > 1e-12, size, 1), np.array([1.0, 0, 0]))
    return np.concatenate([out, -out], axis=1)


def _depths(batch: pd.DataFrame, dim: int, sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Least over directions of the width of a, plus (``sign`` -1: less) that of b, less the offset along them."""
    d = batch[[f"d{a}" for a in axes(dim)]].to_numpy(float)
    n = len(d)

    def gap(u: np.ndarray) -> np.ndarray:
        return _widths(batch, "a_", u) + sign * _widths(batch, "b_", u) - np.einsum("nkj,nj->nk", u, d)

    grid = np.broadcast_to(_directions(dim), (n, COARSE[dim], dim))
    if dim == 3:
        grid = np.concatenate([grid, _normals(batch, d)], axis=1)
    size = np.linalg.norm(d, axis=1, keepdims=True)
    first = np.zeros(dim)
    first[0] = 1.0
    line = np.where(size > 0, d / np.where(size > 0, size, 1), first)
    u = np.concatenate([line[:, None, :], grid], axis=1)
    value = gap(u)
    # one descent from the best direction of each quadrant or octant
    part = ((u > 0) * (1 << np.arange(dim))).sum(axis=2)
    depth, best = np.full(n, np.inf), u[:, 0]
    for k in range(1 << dim):
        pick = np.argmin(np.where(part == k, value, np.inf), axis=1)
        least, at = _descend(gap, u[np.arange(n), pick], value[np.arange(n), pick], dim)
        best = np.where((least < depth)[:, None], at, best)
        depth = np.minimum(depth, least)
    return depth, best


def _descend(gap, best: np.ndarray, depth: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Follow the gap down from a direction of each row, to the finest angle."""
    n = len(best)
    step = 2 * np.pi / COARSE[2] if dim == 2 else 3.6 / COARSE[3] ** 0.5
    ticks = np.linspace(-1, 1, 9 if dim == 2 else 5)
    while step > FINEST:
        # a shrinking fan around the best direction, in the plane across it
        if dim == 2:
            side = np.stack([-best[:, 1], best[:, 0]], axis=1)[:, None, :]
            near = best[:, None, :] + step * ticks[None, :, None] * side
        else:
            other = np.where(np.abs(best[:, :1]) < 0.9, [[1.0, 0, 0]], [[0, 1.0, 0]])
            p = np.cross(best, other)
            p /= np.linalg.norm(p, axis=1, keepdims=True)
            q = np.cross(best, p)
            s, t = (g.ravel()[None, :, None] for g in np.meshgrid(ticks, ticks))
            near = best[:, None, :] + step * (s * p[:, None, :] + t * q[:, None, :])
        near = near / np.linalg.norm(near, axis=2, keepdims=True)
        value = gap(near)
        pick = np.argmin(value, axis=1)
        better = value[np.arange(n), pick] < depth
        best = np.where(better[:, None], near[np.arange(n), pick], best)
        depth = np.minimum(depth, value[np.arange(n), pick])
        step *= 0.35 if dim == 2 else 0.6
    return depth, best


def separate(pairs: DataFrame, dim: int) -> DataFrame:
    """Overlapping pairs among candidate pairs, with depth and direction, in Arrow batches."""
    key = pairs.schema["sample_id"].dataType.simpleString()
    names = [f"u{a}" for a in axes(dim)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            depth, u = _depths(batch, dim)
            out = pd.DataFrame({"sample_id": batch["sample_id"], "i": batch["a_particle_id"],
                                "j": batch["b_particle_id"], "length": depth})
            for k, name in enumerate(names):
                out[name] = u[:, k]
            yield out[depth > 0]

    schema = f"sample_id {key}, i bigint, j bigint, length double, " + ", ".join(f"{n} double" for n in names)
    return pairs.mapInPandas(run, schema).where(F.col("length") > 0)


def contained(pairs: DataFrame, dim: int) -> DataFrame:
    """Pairs (a, b) with the room that b has inside a, negative where it sticks out: ``_room``, in Arrow batches.

    A convex body lies in another exactly when it is nowhere wider, seen from the other's centre.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(_room=_depths(batch, dim, -1)[0])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", _room double"
    return pairs.mapInPandas(run, schema)


def _column(batch: pd.DataFrame, side: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest ordinate of every row's 2D particle at abscissae from its centre (empty: low > high)."""
    kind = batch[side + "shape"].to_numpy()[:, None]
    mid, half = np.zeros_like(x), np.full_like(x, -np.inf)
    col = lambda name: batch[side + name].to_numpy(float)[:, None]
    if side + "r" in batch:
        on = np.isin(kind, ("Disk", "CylindricalFiber")) & (np.abs(x) <= col("r"))
        half = np.where(on, np.sqrt(np.maximum(col("r") ** 2 - x ** 2, 0)), half)
    if side + "side" in batch:
        half = np.where((kind == "Square") & (np.abs(x) <= col("side") / 2), col("side") / 2, half)
    if side + "major_axis" in batch:
        a, b, t = col("major_axis") / 2, col("minor_axis") / 2, col("angle")
        reach = (a * np.cos(t)) ** 2 + (b * np.sin(t)) ** 2
        on = (kind == "Ellipse") & (x ** 2 <= reach)
        mid = np.where(on, x * (a ** 2 - b ** 2) * np.sin(t) * np.cos(t) / reach, mid)
        half = np.where(on, a * b / reach * np.sqrt(np.maximum(reach - x ** 2, 0)), half)
    return mid - half, mid + half


def overlap_areas(pairs: DataFrame, strips: int = 2048) -> DataFrame:
    """Shared area of candidate 2D pairs, in Arrow batches: the common ordinates summed over strips.

    The strips crowd at both ends of the common abscissae, where the outlines turn steeply;
    the error is of the order of the area over the square of their number.
    """
    key = pairs.schema["sample_id"].dataType.simpleString()
    across = [F.lit(1.0), F.lit(0.0)]
    ranged = pairs.withColumn("_wa", by_shape(pairs, lambda s, c: s.width(c, across), "a_", 2)).withColumn(
        "_wb", by_shape(pairs, lambda s, c: s.width(c, across), "b_", 2))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = np.pi * ((np.arange(strips) + 0.5) / strips - 0.5)
        for whole in batches:
            for first in range(0, len(whole), 512):
                batch = whole.iloc[first:first + 512]
                dx, dy = batch["dx"].to_numpy(float)[:, None], batch["dy"].to_numpy(float)[:, None]
                wa, wb = batch["_wa"].to_numpy(float)[:, None], batch["_wb"].to_numpy(float)[:, None]
                lo, hi = np.maximum(-wa, dx - wb), np.minimum(wa, dx + wb)
                x = (lo + hi) / 2 + (hi - lo) / 2 * np.sin(t)
                (la, ha), (lb, hb) = _column(batch, "a_", x), _column(batch, "b_", x - dx)
                common = np.maximum(np.minimum(ha, hb + dy) - np.maximum(la, lb + dy), 0)
                area = np.sum(common * np.cos(t), axis=1) * (np.maximum(hi - lo, 0)[:, 0] / 2) * np.pi / strips
                yield pd.DataFrame({"sample_id": batch["sample_id"], "i": batch["a_particle_id"],
                                    "j": batch["b_particle_id"], "size": area})

    return ranged.mapInPandas(run, f"sample_id {key}, i bigint, j bigint, size double").where(F.col("size") > 0)
