"""Explicit schemas of the working tables and of the microstructure documents."""

from __future__ import annotations

from pyspark.sql import types as T

from packstat.functions.shapes import SHAPES

# fixed values: how a document format is named, and the version that is read
FORMAT_SUFFIX = "-microstructure"
VERSION = 1

PARTICLE_SIZES = ("r", "major_axis", "minor_axis", "angle", "side", "axis_1", "axis_2", "axis_3",
                  "rot_x", "rot_y", "rot_z", "r_cyl", "length", "azimuth_angle", "polar_angle")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


D, L, S, I, B = T.DoubleType(), T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType()

PARTICLES = _struct(
    sample_id=S, particle_id=L, phase=S, shape=S, cx=D, cy=D, cz=D,
    **{n: D for n in PARTICLE_SIZES}, direction=I, parent_id=L, delta=D,
)
SAMPLES = _struct(sample_id=S, dim=I, lx=D, ly=D, lz=D, periodic=B, matrix_phase=S)
PHASES = _struct(sample_id=S, phase=S, phase_order=I, type=S, type_code=I, inner_phase=B, outer_phase=S)
DESCRIPTORS = _struct(
    sample_id=S, phase=S, name=S, distribution=S, params=T.MapType(S, D),
    values=T.ArrayType(D), probabilities=T.ArrayType(D),
)
RUN_STEPS = _struct(sample_id=S, step=L, ts=T.TimestampType(), total_overlap=D, kinetic=D,
                    thermic=D, dt=D, ratio=D)

TYPE_CODES = {"Matrix": 1, **{s.name: s.code for s in SHAPES.values()}}
TYPE_DIMS = {s.name: (3 if s.name == "CylindricalFiber" else s.dim) for s in SHAPES.values()}
# coordinates of a centre: fibres are kept by the two across their axis
SHAPES_CENTRE = {d: tuple(s.name for s in SHAPES.values() if s.dim == d) for d in (2, 3)}
