"""The shape registry: one entry per particle shape, every entry a set of column expressions.

An expression is a function of an accessor ``c`` with ``c.r``, ``c.major_axis`` ... giving
the columns of the particle (``Cols("a_")`` reads the ``a_`` side of a pair). Adding a
shape here makes volume, radius, extents, support, containment and erosion work for it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Expr = Callable[["Cols"], Column]


class Cols:
    """Columns of one particle, optionally behind a prefix."""

    def __init__(self, prefix: str = "", known: set[str] | None = None):
        self._prefix, self._known = prefix, known

    def frame(self, dim: int) -> list[list[Column]] | None:
        """The rotation, where ``framed`` has already put it into columns."""
        if self._known is None or "m11" not in self._known:
            return None
        return [[F.col(f"{self._prefix}m{i}{j}") for j in range(1, dim + 1)] for i in range(1, dim + 1)]

    def parts(self, stem: str) -> list[Column] | None:
        """Four columns ``stem0 ..`` worked out beforehand, if the table has them."""
        if self._known is None or f"{stem}0" not in self._known:
            return None
        return [F.col(f"{self._prefix}{stem}{k}") for k in range(4)]

    def __getattr__(self, name: str) -> Column:
        if self._known is not None and name not in self._known:
            return F.lit(0.0)
        return F.col(self._prefix + name)


@dataclass(frozen=True)
class Shape:
    name: str
    code: int
    dim: int
    columns: tuple[str, ...]
    sizes: tuple[str, ...]
    volume: Expr
    real_volume: Expr
    radius: Expr
    radius_insc: Expr
    rotation: Callable[["Cols"], list[list[Column]]]
    width: Callable[["Cols", list[Column]], Column]
    furthest: Callable[["Cols", list[Column]], list[Column]]
    contains: Callable[["Cols", list[Column]], Column]
    boundary: Callable[["Cols", list[Column], float], Column] | None = None
    erosion: Expr | None = None
    grown: dict[str, float] = field(default_factory=dict)


def dot(a: list[Column], b: list[Column]) -> Column:
    total = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        total = total + x * y
    return total


def clip0(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def _identity(dim: int):
    return lambda c: [[F.lit(1.0 if i == j else 0.0) for j in range(dim)] for i in range(dim)]


def _ellipse_axes(c: Cols) -> list[list[Column]]:
    cos, sin = F.cos(c.angle), F.sin(c.angle)
    return [[cos, sin], [-sin, cos]]


def _ellipsoid_axes(c: Cols) -> list[list[Column]]:
    """Unit vectors of the principal axes, from the quaternion of the axis-angle rotation."""
    if c.frame(3):
        return c.frame(3)
    w, x, y, z = c.parts("_q") or _quaternion(c)
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y + z * w), 2 * (x * z - y * w)],
        [2 * (x * y - z * w), 1 - 2 * (x * x + z * z), 2 * (y * z + x * w)],
        [2 * (x * z + y * w), 2 * (y * z - x * w), 1 - 2 * (x * x + y * y)],
    ]


def _quaternion(c: Cols) -> list[Column]:
    size = F.sqrt(c.rot_x * c.rot_x + c.rot_y * c.rot_y + c.rot_z * c.rot_z)
    s = F.try_divide(F.sin(c.angle / 2), size)
    return [F.cos(c.angle / 2), s * c.rot_x, s * c.rot_y, s * c.rot_z]


def _turns(c: Cols) -> list[Column]:
    return [F.sin(c.polar_angle), F.cos(c.polar_angle), F.sin(c.azimuth_angle), F.cos(c.azimuth_angle)]


def _cylinder_axes(c: Cols) -> list[list[Column]]:
    """Axis of symmetry, then the directions in which the polar and azimuth angles grow."""
    if c.frame(3):
        return c.frame(3)
    st, ct, sp, cp = c.parts("_c") or _turns(c)
    return [[st * cp, st * sp, ct], [ct * cp, ct * sp, -st], [-sp, cp, F.lit(0.0)]]


def _local(frame: list[list[Column]], v: list[Column]) -> list[Column]:
    return [dot(axis, v) for axis in frame]


def _global(frame: list[list[Column]], v: list[Column]) -> list[Column]:
    return [dot([axis[k] for axis in frame], v) for k in range(len(v))]


def _quadric(axes_of, sizes: Callable[[Cols], list[Column]]):
    """Expressions shared by ellipses and ellipsoids: semi-axes along a rotated frame."""

    def level(c: Cols, d: list[Column]) -> Column:
        local = _local(axes_of(c), d)
        total = None
        for x, a in zip(local, sizes(c)):
            term = (x / a) * (x / a)
            total = term if total is None else total + term
        return total

    def width(c: Cols, u: list[Column]) -> Column:
        parts = [a * x for a, x in zip(sizes(c), _local(axes_of(c), u))]
        return F.sqrt(dot(parts, parts))

    def furthest(c: Cols, u: list[Column]) -> list[Column]:
        frame = axes_of(c)
        local = [a * a * x for a, x in zip(sizes(c), _local(frame, u))]
        scale = width(c, u)
        return [x / scale for x in _global(frame, local)]

    return level, width, furthest


_ellipse_semi = lambda c: [c.major_axis / 2, c.minor_axis / 2]
_ellipsoid_semi = lambda c: [c.axis_1 / 2, c.axis_2 / 2, c.axis_3 / 2]
_ellipse_level, _ellipse_width, _ellipse_far = _quadric(_ellipse_axes, _ellipse_semi)
_ellipsoid_level, _ellipsoid_width, _ellipsoid_far = _quadric(_ellipsoid_axes, _ellipsoid_semi)


def _ball_width(c: Cols, u: list[Column]) -> Column:
    return c.r * F.sqrt(dot(u, u))


def _ball_far(c: Cols, u: list[Column]) -> list[Column]:
    size = F.sqrt(dot(u, u))
    return [c.r * x / size for x in u]


def _square_far(c: Cols, u: list[Column]) -> list[Column]:
    half = c.side / 2
    # a corner is always returned: a zero component counts as positive, except beside a negative y
    x = F.when((u[0] < 0) & ~((u[0] >= 0) & (u[1] < 0)), -half).otherwise(half)
    return [x, F.when(u[1] >= 0, half).otherwise(-half)]


def _cylinder_parts(c: Cols, u: list[Column]) -> tuple[Column, list[Column], Column]:
    axis = _cylinder_axes(c)[0]
    along = dot(u, axis)
    radial = [x - along * k for x, k in zip(u, axis)]
    return along, radial, F.sqrt(clip0(dot(u, u) - along * along))


def _cylinder_width(c: Cols, u: list[Column]) -> Column:
    along, _, across = _cylinder_parts(c, u)
    return c.length / 2 * F.abs(along) + c.r_cyl * across


def _cylinder_far(c: Cols, u: list[Column]) -> list[Column]:
    axis = _cylinder_axes(c)[0]
    along, radial, across = _cylinder_parts(c, u)
    end = F.when(along >= 0, c.length / 2).otherwise(-c.length / 2)
    # below rounding the direction runs along the axis, and the cap's centre is the answer
    flat = across > 1e-7
    return [end * k + F.when(flat, c.r_cyl * x / across).otherwise(0.0) for k, x in zip(axis, radial)]


def _cylinder_contains(c: Cols, d: list[Column]) -> Column:
    along = dot(d, _cylinder_axes(c)[0])
    away = F.sqrt(clip0(dot(d, d) - along * along))
    return (F.abs(along) <= c.length / 2) & (away < c.r_cyl)


def _inflation(c: Cols) -> Column:
    return F.coalesce(c.inflation, F.lit(0.0))


# fixed values: type codes 1..8, and the tolerances of the containment tests
MATRIX_CODE = 1
ELLIPSE_TOL = 1e-8
BALL_TOL = 1e-6

SHAPES: dict[str, Shape] = {}


def register_shape(shape: Shape) -> None:
    SHAPES[shape.name] = shape


register_shape(Shape(
    "Disk", 2, 2, ("r",), ("r",),
    volume=lambda c: F.pi() * c.r * c.r,
    real_volume=lambda c: F.pi() * (c.r - c.delta) * (c.r - c.delta),
    radius=lambda c: c.r, radius_insc=lambda c: c.r,
    rotation=_identity(2), width=_ball_width, furthest=_ball_far,
    contains=lambda c, d: F.sqrt(dot(d, d)) <= c.r,
    erosion=lambda c: c.r, grown={"r": 1.0},
))
register_shape(Shape(
    "Ellipse", 3, 2, ("major_axis", "minor_axis", "angle"), ("major_axis", "minor_axis"),
    volume=lambda c: F.pi() * c.major_axis / 2 * c.minor_axis / 2,
    real_volume=lambda c: F.pi() * (c.major_axis / 2 - _inflation(c)) * (c.minor_axis / 2 - _inflation(c)),
    radius=lambda c: c.major_axis / 2, radius_insc=lambda c: c.minor_axis / 2,
    rotation=_ellipse_axes, width=_ellipse_width, furthest=_ellipse_far,
    contains=lambda c, d: _ellipse_level(c, d) <= 1 + ELLIPSE_TOL,
    boundary=lambda c, d, tol: F.abs(_ellipse_level(c, d) - 1) < tol,
    erosion=lambda c: c.minor_axis * c.minor_axis / (2 * c.major_axis),
))
register_shape(Shape(
    "Sphere", 4, 3, ("r",), ("r",),
    volume=lambda c: 4.0 / 3.0 * F.pi() * c.r * c.r * c.r,
    real_volume=lambda c: 4.0 / 3.0 * F.pi() * (c.r - c.delta) * (c.r - c.delta) * (c.r - c.delta),
    radius=lambda c: c.r, radius_insc=lambda c: c.r,
    rotation=_identity(3), width=_ball_width, furthest=_ball_far,
    contains=lambda c, d: dot(d, d) / (c.r * c.r) - 1 <= BALL_TOL,
    erosion=lambda c: 0.9 * c.r, grown={"r": 1.0},
))
register_shape(Shape(
    "Ellipsoid", 5, 3, ("axis_1", "axis_2", "axis_3", "rot_x", "rot_y", "rot_z", "angle"),
    ("axis_1", "axis_2", "axis_3"),
    volume=lambda c: F.pi() / 6.0 * c.axis_1 * c.axis_2 * c.axis_3,
    real_volume=lambda c: 4.0 / 3.0 * F.pi() * (c.axis_1 / 2 - _inflation(c))
    * (c.axis_2 / 2 - _inflation(c)) * (c.axis_3 / 2 - _inflation(c)),
    radius=lambda c: F.greatest(c.axis_1, c.axis_2, c.axis_3) / 2,
    radius_insc=lambda c: F.least(c.axis_1, c.axis_2, c.axis_3) / 2,
    rotation=_ellipsoid_axes, width=_ellipsoid_width, furthest=_ellipsoid_far,
    contains=lambda c, d: _ellipsoid_level(c, d) - 1 <= BALL_TOL,
    boundary=lambda c, d, tol: F.abs(_ellipsoid_level(c, d) - 1) <= tol,
    erosion=lambda c: F.pow(F.least(c.axis_1, c.axis_2, c.axis_3), 2)
    / (2 * F.greatest(c.axis_1, c.axis_2, c.axis_3)),
))
register_shape(Shape(
    "CylindricalFiber", 6, 2, ("r", "direction"), ("r",),
    volume=lambda c: F.pi() * c.r * c.r * c.fiber_length,
    real_volume=lambda c: F.pi() * (c.r - c.delta) * (c.r - c.delta) * c.fiber_length,
    radius=lambda c: c.r, radius_insc=lambda c: c.r,
    rotation=_identity(2), width=_ball_width, furthest=_ball_far,
    contains=lambda c, d: F.sqrt(dot(d, d)) <= c.r,
    erosion=lambda c: c.r, grown={"r": 1.0},
))
register_shape(Shape(
    "Cylinder", 7, 3, ("r_cyl", "length", "azimuth_angle", "polar_angle"), ("r_cyl", "length"),
    volume=lambda c: c.length * F.pi() * c.r_cyl * c.r_cyl,
    real_volume=lambda c: (c.length - 2 * c.delta) * F.pi() * (c.r_cyl - c.delta) * (c.r_cyl - c.delta),
    radius=lambda c: F.sqrt(c.length / 2 * (c.length / 2) + c.r_cyl * c.r_cyl),
    radius_insc=lambda c: F.least(c.length / 2, c.r_cyl),
    rotation=_cylinder_axes, width=_cylinder_width, furthest=_cylinder_far,
    contains=_cylinder_contains, grown={"r_cyl": 1.0, "length": 2.0},
))
register_shape(Shape(
    "Square", 8, 2, ("side",), ("side",),
    volume=lambda c: c.side * c.side,
    real_volume=lambda c: (c.side - 2 * c.delta) * (c.side - 2 * c.delta),
    # a square has no inscribed radius of its own and is meshed by its outer one
    radius=lambda c: c.side / 2 * F.sqrt(F.lit(2.0)), radius_insc=lambda c: c.side / 2 * F.sqrt(F.lit(2.0)),
    rotation=_identity(2),
    width=lambda c, u: c.side / 2 * (F.abs(u[0]) + F.abs(u[1])), furthest=_square_far,
    contains=lambda c, d: (F.abs(d[0]) <= c.side / 2) & (F.abs(d[1]) <= c.side / 2),
    erosion=lambda c: c.side / 8, grown={"side": 2.0},
))


def cols_of(df: DataFrame, prefix: str = "") -> Cols:
    """Accessor that reads optional bookkeeping columns as zero when the table lacks them."""
    known = {n[len(prefix):] for n in df.columns if n.startswith(prefix)}
    return Cols(prefix, known)


def present(df: DataFrame, prefix: str = "", dim: int | None = None) -> list[Shape]:
    """Registered shapes whose columns the table carries; 3D ones need a third coordinate."""
    names = set(df.columns)
    most = 3 if prefix + "cz" in names else 2
    return [s for s in SHAPES.values()
            if all(prefix + col in names for col in s.columns) and s.dim <= most and (dim is None or s.dim == dim)]


def by_shape(df: DataFrame, expression: Callable[[Shape, Cols], Column | None],
             prefix: str = "", dim: int | None = None) -> Column:
    """``CASE shape WHEN ... END`` of one registry expression over the shapes in a table."""
    c = cols_of(df, prefix)
    case = None
    for shape in present(df, prefix, dim):
        value = expression(shape, c)
        if value is None:
            continue
        is_shape = F.col(prefix + "shape") == shape.name
        case = F.when(is_shape, value) if case is None else case.when(is_shape, value)
    return case if case is not None else F.lit(None).cast("double")


def by_shape_vector(df: DataFrame, expression: Callable[[Shape, Cols], list[Column] | None],
                    size: int, prefix: str = "", dim: int | None = None) -> list[Column]:
    """One ``CASE`` per component of a vector-valued registry expression."""
    def component(k: int):
        def pick(shape: Shape, c: Cols) -> Column | None:
            vector = expression(shape, c)
            return None if vector is None or k >= len(vector) else vector[k]
        return pick

    return [by_shape(df, component(k), prefix, dim) for k in range(size)]


def with_rotation(particles: DataFrame, dim: int) -> DataFrame:
    """Columns ``m11 ..``: row k is the k-th local axis in global coordinates.

    The sines, cosines and quaternions are columns of their own first, each computed once.
    """
    names, cells, c = particles.columns, [], cols_of(particles)
    kinds = {s.name for s in present(particles, dim=dim)}
    if "Ellipsoid" in kinds:
        particles = particles.withColumns({f"_q{k}": x for k, x in enumerate(_quaternion(c))})
    if "Cylinder" in kinds:
        particles = particles.withColumns({f"_c{k}": x for k, x in enumerate(_turns(c))})
    for i in range(dim):
        row = by_shape_vector(particles, lambda s, c, i=i: s.rotation(c)[i], dim, dim=dim)
        cells += [x.alias(f"m{i + 1}{j + 1}") for j, x in enumerate(row)]
    return particles.select(*names, *cells)


def framed(particles: DataFrame, dim: int) -> DataFrame:
    """The table with its rotations worked out once, where it holds turned 3D shapes."""
    turned = dim == 3 and any(s.name in ("Ellipsoid", "Cylinder") for s in present(particles, dim=3))
    return with_rotation(particles, 3) if turned and "m11" not in particles.columns else particles
