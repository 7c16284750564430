"""Node and cell tables: grids, periodic boundaries, constraints, measures, groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstat.functions.ordered import number_rows, over_halo, running
from packstat.functions.periodic import axes, norm
from packstat.operators.spatial import attach, attach_box, box
from packstat.operators.voxel import grid_cells_of

# fixed values: relative tolerances of the face test and of the fill test
FACE_TOL = 1e-8
FILL_TOL = 1e-6
# fixed values: corners of a grid cell in VTK order
CORNERS = {2: ((0, 0), (1, 0), (1, 1), (0, 1)),
           3: ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))}
# fixed values: node order of second-order cells in the solver convention, as positions in the VTK order
NODE_ORDERS = {"quad8": (0, 4, 1, 5, 2, 6, 3, 7), "quad9": (0, 4, 1, 5, 2, 6, 3, 7, 8),
               "hexahedron20": (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 16, 17, 18, 19, 12, 13, 14, 15)}


# --- grids ------------------------------------------------------------------------------


def _node_id(dim: int, index: Sequence[Column]) -> Column:
    """C-order number of a lattice node: the last axis runs fastest."""
    number = None
    for a, i in zip(axes(dim), index):
        number = i if number is None else number * (F.col(f"n{a}") + 1) + i
    return number


def grid_nodes(grids: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Nodes of a regular grid: ``node_id`` and coordinates (z = 0 in the plane)."""
    at = [f"i{a}" for a in axes(dim)]
    sizes = attach(grids.select("sample_id", *[f"n{a}" for a in axes(dim)]), samples.select("sample_id", *box(dim)))
    rows = attach(grid_cells_of(grids, dim, at, plus=1), sizes)
    coords = [(F.col(f"i{a}") * (F.col(f"l{a}") / F.col(f"n{a}"))).alias(a) for a in axes(dim)]
    flat = [F.lit(0.0).alias("z")] if dim == 2 else []
    return rows.select("sample_id", _node_id(dim, [F.col(i) for i in at]).alias("node_id"), *coords, *flat)


def grid_cells(voxels: DataFrame, grids: DataFrame, dim: int) -> DataFrame:
    """One cell per voxel, in VTK corner order, with the voxel's phase."""
    rows = attach(voxels, grids.select("sample_id", *[f"n{a}" for a in axes(dim)]))
    number = None
    for a in axes(dim):
        number = F.col(f"i{a}") if number is None else number * F.col(f"n{a}") + F.col(f"i{a}")
    conn = F.array(*[_node_id(dim, [F.col(f"i{a}") + c for a, c in zip(axes(dim), corner)]) for corner in CORNERS[dim]])
    return rows.select("sample_id", F.lit(0).alias("block"), number.alias("cell_id"),
                       F.lit("quad" if dim == 2 else "hexahedron").alias("cell_type"), conn.alias("conn"), "phase")


def bounding_box(nodes: DataFrame) -> DataFrame:
    """Sides of the box around the nodes, for meshes that bring none; two-dimensional when flat."""
    return nodes.groupBy("sample_id").agg(*[(F.max(a) - F.min(a)).alias(f"l{a}") for a in "xyz"]).withColumn(
        "dim", F.when(F.col("lz") > 0, 3).otherwise(2))


def phase_from_tags(cells: DataFrame, tags: Sequence[str] = ("phase", "gmsh:physical", "medit:ref")) -> DataFrame:
    """Phase of a cell: the first tag column the table has, else one."""
    found = next((t for t in tags if t in cells.columns), None)
    phase = F.col(f"`{found}`").cast("int") if found else F.lit(1)
    keep = [c for c in cells.columns if c not in tags]
    return cells.select(*[F.col(f"`{c}`") for c in keep], phase.alias("phase"))


def reorder_cells(cells: DataFrame, orders: dict[str, Sequence[int]] | None = None) -> DataFrame:
    """Connectivity in another node order; types without one stay as they are."""
    case = None
    for kind, order in (orders or NODE_ORDERS).items():
        turned = F.transform(F.array(*[F.lit(k) for k in order]), lambda i: F.get(F.col("conn"), i))
        is_kind = F.col("cell_type") == kind
        case = F.when(is_kind, turned) if case is None else case.when(is_kind, turned)
    return cells.withColumn("conn", case.otherwise(F.col("conn")) if case is not None else F.col("conn"))


# --- periodic boundary ------------------------------------------------------------------


def classify_nodes(nodes: DataFrame, samples: DataFrame, dim: int, tol: float | None = None) -> DataFrame:
    """Faces each node is on: ``on_x`` in -1/0/1, bit ``face_mask``, ``n_faces``, ``kind``, ``name``."""
    out = attach_box(nodes, samples, dim)
    limit = F.lit(tol) if tol is not None else F.lit(FACE_TOL) * F.greatest(*[F.col(b) for b in box(dim)])
    out = out.withColumn("_tol", limit)
    mask = count = None
    names = []
    for k, a in enumerate(axes(dim)):
        x, b = F.col(a), F.col(f"l{a}")
        low = (x > -F.col("_tol")) & (x < F.col("_tol"))
        high = (x > b - F.col("_tol")) & (x < b + F.col("_tol"))
        out = out.withColumn(f"on_{a}", F.when(low, -1).when(high, 1).otherwise(0))
        bits = F.when(low, 1 << (2 * k)).when(high, 1 << (2 * k + 1)).otherwise(0)
        hit = (low | high).cast("int")
        mask, count = (bits, hit) if mask is None else (mask.bitwiseOR(bits), count + hit)
        names.append(F.when(F.col(f"on_{a}") < 0, f"{a}-").when(F.col(f"on_{a}") > 0, f"{a}+").otherwise(""))
    kind = F.when(F.col("n_faces") == 1, "face").when(F.col("n_faces") == dim, "corner")
    if dim == 3:
        kind = kind.when(F.col("n_faces") == 2, "edge")
    return (out.withColumn("face_mask", mask).withColumn("n_faces", count).withColumn("kind", kind)
            .withColumn("name", F.concat(*names)))


def node_sets(classified: DataFrame, dim: int) -> DataFrame:
    """Membership of the FACE, EDGE and CORNER sets; a corner node is on its faces too."""
    faces = [F.when(F.col(f"on_{a}") < 0, f"{a}-").when(F.col(f"on_{a}") > 0, f"{a}+") for a in axes(dim)]
    sets = F.array(*[F.when(f.isNotNull(), F.struct(F.lit("face").alias("kind"), f.alias("name"))) for f in faces],
                   F.when(F.col("kind").isin("edge", "corner"), F.struct(F.col("kind"), F.col("name"))))
    out = (classified.where("n_faces > 0")
           .select("sample_id", "node_id", F.explode(F.array_compact(sets)).alias("_s"))
           .select("sample_id", "_s.kind", "_s.name", "node_id"))
    return out.withColumn("set_name", set_name(F.col("kind"), F.col("name")))


def set_name(kind: Column, name: Column) -> Column:
    """``FACE_XNEG``, ``CORNER_XNEG_YPOS``: the signs spelled out."""
    spelled = F.regexp_replace(F.regexp_replace(F.upper(name), "-", "NEG_"), "\\+", "POS_")
    return F.concat_ws("_", F.upper(kind), F.regexp_replace(spelled, "_$", ""))


def _matched(slaves: DataFrame, masters: DataFrame, coords: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Nearest master of each slave within the tolerance in the given coordinates.

    Buckets are four tolerances wide: a slave looks into the one or two buckets its
    tolerance interval touches along each coordinate, a master is listed in one.
    """
    wide = 4 * F.col("_tol")
    left, right = slaves, masters
    for k, x in enumerate(coords):
        near = F.array_distinct(F.array(F.floor((F.col(x) - F.col("_tol")) / wide), F.floor((F.col(x) + F.col("_tol")) / wide)))
        left = left.withColumn(f"_b{k}", F.explode(near))
        right = right.withColumn(f"_b{k}", F.floor(F.col(x) / wide))
    buckets = [f"_b{k}" for k in range(len(coords))]
    right = right.select(*keys, *buckets, F.col("node_id").alias("master"), *[F.col(x).alias("_m" + x) for x in coords])
    both = left.withColumnRenamed("node_id", "slave").join(right, [*keys, *buckets])
    gap = norm([F.col(x) - F.col("_m" + x) for x in coords])
    return (both.withColumn("_d", gap).where(F.col("_d") < F.col("_tol"))
            .groupBy(*keys, "slave").agg(F.min(F.struct("_d", "master")).alias("_n"))
            .select(*keys, "slave", "_n.master"))


def pair_boundary_nodes(classified: DataFrame, dim: int) -> DataFrame:
    """Slave-master pairs of faces, edges and corners: ``kind, axis, slave, master``."""
    parts = []
    for a in axes(dim):
        others = [o for o in axes(dim) if o != a]
        on_face = classified.where((F.col("n_faces") == 1) & (F.col(f"on_{a}") != 0))
        cols = ["sample_id", "node_id", "_tol", *others]
        found = _matched(on_face.where(F.col(f"on_{a}") > 0).select(*cols),
                         on_face.where(F.col(f"on_{a}") < 0).select(*cols), others, ["sample_id"])
        parts.append(found.select("sample_id", F.lit("face").alias("kind"), F.lit(a).alias("axis"), "slave", "master"))
        if dim == 3:
            on_edge = classified.where((F.col("n_faces") == 2) & (F.col(f"on_{a}") == 0))
            is_master = (F.col(f"on_{others[0]}") < 0) & (F.col(f"on_{others[1]}") < 0)
            cols = ["sample_id", "node_id", "_tol", a]
            found = _matched(on_edge.where(~is_master).select(*cols), on_edge.where(is_master).select(*cols),
                             [a], ["sample_id"])
            parts.append(found.select("sample_id", F.lit("edge").alias("kind"), F.lit(a).alias("axis"), "slave", "master"))
    corners = classified.where(F.col("n_faces") == dim).groupBy("sample_id", "name").agg(F.min("node_id").alias("node_id"))
    origin = "".join(f"{a}-" for a in axes(dim))
    master = corners.where(F.col("name") == origin).select("sample_id", F.col("node_id").alias("master"))
    parts.append(corners.where(F.col("name") != origin).join(master, "sample_id").select(
        "sample_id", F.lit("corner").alias("kind"), F.lit(None).cast("string").alias("axis"),
        F.col("node_id").alias("slave"), "master"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def unmatched_nodes(classified: DataFrame, pairs: DataFrame, dim: int) -> DataFrame:
    """Slave nodes of faces and edges without a partner: ``axis, node_id``."""
    parts = []
    for a in axes(dim):
        slave = (F.col("n_faces") == 1) & (F.col(f"on_{a}") > 0)
        if dim == 3:
            o = [x for x in axes(3) if x != a]
            slave = slave | ((F.col("n_faces") == 2) & (F.col(f"on_{a}") == 0)
                             & ~((F.col(f"on_{o[0]}") < 0) & (F.col(f"on_{o[1]}") < 0)))
        parts.append(classified.where(slave).select("sample_id", F.lit(a).alias("axis"), "node_id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    matched = pairs.where("kind <> 'corner'").select("sample_id", "axis", F.col("slave").alias("node_id"))
    return out.join(matched, ["sample_id", "axis", "node_id"], "left_anti")


def conformity(classified: DataFrame, unmatched: DataFrame, dim: int) -> DataFrame:
    """Per sample: whether every slave has a partner, and a message per direction that does not match."""
    counts = classified.groupBy("sample_id").agg(
        *[F.sum((F.col(f"on_{a}") < 0).cast("long")).alias(f"_neg_{a}") for a in axes(dim)],
        *[F.sum((F.col(f"on_{a}") > 0).cast("long")).alias(f"_pos_{a}") for a in axes(dim)])
    missing = unmatched.groupBy("sample_id").agg(
        *[F.sum((F.col("axis") == a).cast("long")).alias(f"_miss_{a}") for a in axes(dim)])
    both = attach(counts, missing, how="left")
    parts = [F.when(F.col(f"_miss_{a}") > 0, F.format_string(
        f"direction {a}: %d nodes on {a}- and %d on {a}+, %d without a partner",
        F.col(f"_neg_{a}"), F.col(f"_pos_{a}"), F.col(f"_miss_{a}"))) for a in axes(dim)]
    message = F.concat_ws("; ", *parts)
    return both.select("sample_id", (message == "").alias("is_conforming"), message.alias("mismatch"))


# --- constraints ------------------------------------------------------------------------


def separations(pairs: DataFrame, nodes: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Whole boxes between slave and master along each axis (``k_x ..``), read off the coordinates."""
    at = lambda p: nodes.select("sample_id", F.col("node_id").alias(p), *[F.col(a).alias(f"_{p}_{a}") for a in axes(dim)])
    both = pairs.join(at("slave"), ["sample_id", "slave"]).join(at("master"), ["sample_id", "master"])
    both = attach_box(both, samples, dim)
    return both.select(*pairs.columns, *[F.rint((F.col(f"_slave_{a}") - F.col(f"_master_{a}")) / F.col(f"l{a}"))
                                         .cast("long").alias(f"k_{a}") for a in axes(dim)])


def constraint_terms(separated: DataFrame, dim: int) -> DataFrame:
    """Terms of slave - master - sum(k * reference) = 0 per pair and degree of freedom."""
    terms = F.array(
        F.struct(F.lit("slave").alias("term"), F.col("slave").alias("node_id"), F.lit(1.0).alias("coefficient")),
        F.struct(F.lit("master").alias("term"), F.col("master").alias("node_id"), F.lit(-1.0).alias("coefficient")),
        *[F.struct(F.lit(f"reference_{a}").alias("term"), F.lit(None).cast("long").alias("node_id"),
                   (-F.col(f"k_{a}")).cast("double").alias("coefficient")) for a in axes(dim)])
    used = F.filter(terms, lambda t: t["coefficient"] != 0)
    dofs = F.array(*[F.lit(k + 1) for k in range(dim)])
    return (separated.withColumn("dof", F.explode(dofs)).withColumn("_t", F.explode(used))
            .select("sample_id", "slave", "master", "dof", "_t.term", "_t.node_id", "_t.coefficient"))


def pattern_of(dim: int) -> Column:
    """Bit per axis along which a pair is separated."""
    mask = None
    for k, a in enumerate(axes(dim)):
        bit = F.when(F.col(f"k_{a}") != 0, 1 << k).otherwise(0)
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def patterns(separated: DataFrame, dim: int, order: Sequence[str]) -> DataFrame:
    """Consecutive runs of pairs with the same separation pattern, in the given order."""
    numbered = number_rows(separated.withColumn("pattern", pattern_of(dim)), ["sample_id"], order, "_n")
    flagged = over_halo(numbered, ["sample_id"], "_n", {"_prev": lambda w: F.lag("pattern").over(w)}, before=1)
    starts = F.coalesce((F.col("pattern") != F.col("_prev")).cast("long"), F.lit(0).cast("long"))
    runs = running(flagged, ["sample_id"], "_n", {"run": starts})
    return runs.groupBy("sample_id", "run", "pattern").agg(F.count(F.lit(1)).alias("n_pairs"), F.min("_n").alias("start"))


def reference_loading(samples: DataFrame, gradient: Sequence[Sequence[float]], dim: int) -> DataFrame:
    """Displacement of each reference node: its column of the gradient times its side of the box."""
    rows = F.array(*[F.struct(F.lit(a).alias("reference"), *[(F.lit(float(gradient[i][j])) * F.col(f"l{a}")).alias(f"u{b}")
                                                            for i, b in enumerate(axes(dim))])
                     for j, a in enumerate(axes(dim))])
    return samples.select("sample_id", F.explode(rows).alias("_r")).select("sample_id", "_r.*")


# --- cells ------------------------------------------------------------------------------


def cell_measures(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """Area of triangles and quadrilaterals (shoelace), volume of tetrahedra, on corner nodes.

    Hexahedra of a grid are split into five tetrahedra of their corners.
    """
    corners = F.when(F.col("cell_type").startswith("hexa"), 8).when(
        F.col("cell_type").startswith("triangle"), 3).otherwise(4)
    ends = cells.select("sample_id", "block", "cell_id", "cell_type", "phase", corners.alias("_n"),
                        F.posexplode(F.slice("conn", 1, corners)).alias("_p", "node_id"))
    placed = ends.join(nodes.select("sample_id", "node_id", "x", "y", "z"), ["sample_id", "node_id"])
    points = [F.max(F.when(F.col("_p") == k, F.col(a))).alias(f"_{a}{k}") for k in range(8) for a in "xyz"]
    wide = placed.groupBy("sample_id", "block", "cell_id", "cell_type", "phase").agg(*points)

    def at(k: int, a: str) -> Column:
        return F.col(f"_{a}{k}")

    def shoelace(n: int) -> Column:
        total = None
        for k in range(n):
            q = (k + 1) % n
            term = at(k, "x") * at(q, "y") - at(q, "x") * at(k, "y")
            total = term if total is None else total + term
        return 0.5 * F.abs(total)

    def tetra(p: int, q: int, s: int, t: int) -> Column:
        u, v, w = ([at(k, a) - at(p, a) for a in "xyz"] for k in (q, s, t))
        det = (u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0]))
        return F.abs(det) / 6

    hexa = tetra(0, 1, 3, 4) + tetra(1, 2, 3, 6) + tetra(1, 4, 5, 6) + tetra(3, 4, 6, 7) + tetra(1, 3, 4, 6)
    measure = (F.when(F.col("cell_type").startswith("tetra"), tetra(0, 1, 2, 3))
               .when(F.col("cell_type").startswith("hexa"), hexa)
               .when(F.col("cell_type").startswith("quad"), shoelace(4)).otherwise(shoelace(3)))
    return wide.select("sample_id", "block", "cell_id", "cell_type", "phase", measure.alias("measure"))


def fill_check(measures: DataFrame, nodes: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Whether the cells cover the box to a millionth and no node lies outside it."""
    whole = None
    for b in box(dim):
        whole = F.col(b) if whole is None else whole * F.col(b)
    covered = measures.groupBy("sample_id").agg(F.sum("measure").alias("covered"))
    outside = F.lit(False)
    for a in axes(dim):
        outside = outside | (F.col(a) < -FILL_TOL * F.col(f"l{a}")) | (F.col(a) > (1 + FILL_TOL) * F.col(f"l{a}"))
    out = attach_box(nodes, samples, dim).groupBy("sample_id").agg(F.bool_or(outside).alias("outside"))
    both = attach(attach(samples.select("sample_id", whole.alias("volume")), covered), out)
    off = F.abs(F.col("covered") - F.col("volume")) > FILL_TOL * F.col("volume")
    return both.withColumn("fills", ~off & ~F.col("outside"))


def phase_blocks(cells: DataFrame) -> DataFrame:
    """Cells per (block, type, phase), with the first and last row of each group."""
    return cells.groupBy("sample_id", "block", "cell_type", "phase").agg(
        F.count(F.lit(1)).alias("n_cells"), F.min("cell_id").alias("first_cell"), F.max("cell_id").alias("last_cell"))


def element_groups(cells: DataFrame, samples: DataFrame) -> DataFrame:
    """Group per (block, phase): ids in block-then-phase order, type ids by first use, matrix material first.

    Only the distinct groups of a sample - its blocks times its phases - are ordered.
    """
    groups = attach(phase_blocks(cells), samples.select("sample_id", "matrix_phase"))
    by = Window.partitionBy("sample_id")
    first = groups.groupBy("sample_id", "cell_type").agg(F.min("block").alias("_first"))
    types = first.withColumn("element_type_id", F.row_number().over(by.orderBy("_first", "cell_type")).cast("long")).drop("_first")
    number = F.col("phase").cast("string").try_cast("int")
    is_matrix = F.col("phase").cast("string") == F.col("matrix_phase")
    materials = groups.select("sample_id", "phase", "matrix_phase").distinct().withColumn(
        "material_id", F.row_number().over(by.orderBy(is_matrix.desc(), number.asc_nulls_last(), "phase")).cast("long")).drop("matrix_phase")
    return (groups.withColumn("group_id", F.row_number().over(by.orderBy("block", number.asc_nulls_last(), "phase")).cast("long"))
            .join(types, ["sample_id", "cell_type"]).join(materials, ["sample_id", "phase"])
            .select("sample_id", "group_id", "block", "cell_type", "phase", "element_type_id", "material_id", "n_cells"))


def phase_order(phases: DataFrame) -> DataFrame:
    """Phase names in order: as numbers where they are numbers, then by name."""
    by = Window.partitionBy("sample_id").orderBy(F.col("phase").try_cast("int").asc_nulls_last(), "phase")
    return phases.select("sample_id", "phase").distinct().withColumn("position", F.row_number().over(by).cast("long"))


def renumber(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """Ids after removals: an id less the number of removed ids at or below it."""
    ids = nodes.select("sample_id", "node_id", F.lit(0).cast("long").alias("_gone"))
    gone = removed.select("sample_id", "node_id").distinct().withColumn("_hit", F.lit(1).cast("long"))
    marked = ids.join(gone, ["sample_id", "node_id"], "left")
    out = running(marked, ["sample_id"], "node_id", {"_below": F.coalesce("_hit", F.lit(0).cast("long"))}, sparse=True)
    return out.where("_hit IS NULL").select("sample_id", "node_id", (F.col("node_id") - F.col("_below")).alias("new_id"))


def sort_around(points: DataFrame, keys: Sequence[str], point: str = "point_id") -> DataFrame:
    """Rank of each vertex counter-clockwise about the mean of its group (a polygon's few vertices)."""
    centre = points.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    rows = attach(points, centre, keys).withColumn("_t", F.atan2(F.col("y") - F.col("_my"), F.col("x") - F.col("_mx")))
    ring = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_t", F.col(point).alias("id")))).alias("_r"))
    return ring.select(*keys, F.posexplode("_r").alias("position", "_v")).select(
        *keys, F.col("position").cast("long").alias("position"), F.col("_v.id").alias(point))
