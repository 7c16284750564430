"""Voronoi cells and Minkowski structure metrics in periodic boxes, without a hull library.

Seeds are dealt out in tiles: a sample, or a stretch of a large one with the seeds its cells can reach. A task cuts the cells of
its tiles where they are (``cells``), so neighbours are never listed: a seed is moved once, or once for each tile near it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packstat.functions.ordered import number_rows
from packstat.functions.periodic import axes, min_image, norm, wrap
from packstat.functions.shapes import by_shape
from packstat.operators.cells import Tile, around, parts_of
from packstat.operators.geometry import surface_points, with_erosion
from packstat.operators.spatial import SLACK, attach, box, near_pairs, z_order
from packstat.session import checkpoint, spread, unfolded

EPS = 1e-12
#: Neighbours that join those which bound a 3D cell, at once: the work of a cut grows with the third power of their number.
ADDED = 12
#: Cells of no more neighbours are cut by all of them; cells that are cut together, so that NumPy's calls are few.
WHOLE, TOGETHER = 24, 64
#: Seeds of samples that are one tile, seeds of a stretch of a larger one; cells of a task's tiles that are cut at once, and rows around a tile that are held.
SAMPLE, STRETCH, AT_ONCE, HELD = 2048, 512, 1024, 1 << 18
TILE = ["sample_id", "_tile"]


def _cells_3d(cells: Sequence[np.ndarray]) -> list[tuple[np.ndarray, float, np.ndarray | None]]:
    """Of each 3D cell, from its neighbours' offsets: areas of the facets, the cell's radius and its corners (none if it is open).

    The nearest neighbours all around bound a cell, and only neighbours whose bisector cuts or touches that bound can have a facet:
    some of them join, until all have. Cells of as many neighbours are cut together.
    """
    done: list = [None] * len(cells)
    sizes, units, orders, actives = [], [], [], []
    for offsets in cells:
        size = np.linalg.norm(offsets, axis=1)
        # in units of the furthest neighbour, so that tolerances have none
        units.append(size.max())
        sizes.append(size / units[-1])
        order = np.argsort(sizes[-1])
        orders.append(order)
        if len(order) > WHOLE:
            around = np.unique((np.argmax(np.abs(offsets), axis=1) * 8 + (offsets > 0) @ np.array([1, 2, 4]))[order], return_index=True)[1]
            order = order[np.union1d(around, np.arange(8))]
        actives.append(order)
    todo = list(range(len(cells)))
    while todo:
        todo.sort(key=lambda i: len(actives[i]))
        left = []
        for start in range(0, len(todo), TOGETHER):
            part = todo[start:start + TOGETHER]
            n = len(actives[part[-1]])
            o, size = np.zeros((len(part), n, 3)), np.ones((len(part), n))
            for at, i in enumerate(part):
                o[at, :len(actives[i])], size[at, :len(actives[i])] = cells[i][actives[i]] / units[i], sizes[i][actives[i]]
            areas, radius, corners, ends = _cut_3d(o, size)
            for at, i in enumerate(part):
                order, active, unit = orders[i], actives[i], units[i]
                if not np.isfinite(radius[at]):
                    if len(active) == len(order):
                        done[i] = np.zeros(len(sizes[i])), np.inf, None
                        continue
                    there = np.isin(order, active)
                    there[:2 * len(active)] = True
                else:
                    own = corners[ends[at]:ends[at + 1]]
                    there = np.ones(len(order), bool)
                    if len(active) < len(order):
                        # what cuts or touches the cell left so far; it only shrinks, so the others are out for good
                        order = orders[i] = order[(own @ cells[i][order].T).max(axis=0) / unit >= sizes[i][order] ** 2 / 2 * (1 - 1e-9)]
                        there = np.isin(order, active)
                    if there.all():
                        full = np.zeros(len(sizes[i]))
                        full[active] = areas[at, :len(active)]
                        done[i] = full * unit * unit, radius[at] * unit, own * unit
                        continue
                    there[np.flatnonzero(~there)[:ADDED]] = True
                actives[i] = order[there]
                left.append(i)
        todo = left
    return done


def _cut_3d(o: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Facet areas and radius of the cell that each row's neighbours cut (infinite: it is open); corners, and where those of each cell begin.

    In the bisector plane of j every other k is a line; the facet's edge on it is the interval
    the remaining lines l leave, and the area follows from the edges and their distances. Rows are filled up with offsets of zero, which cut nothing.
    """
    cells, many = size.shape
    n = o / size[..., None]
    helper = np.where(np.abs(n[..., :1]) < 0.9, np.array([1.0, 0, 0]), np.array([0, 1.0, 0]))
    u = np.cross(n, helper)
    long = np.linalg.norm(u, axis=2)
    u /= np.where(long > 0, long, 1.0)[..., None]
    v = np.cross(n, u)
    other = o.transpose(0, 2, 1)
    x, y = (u @ other).reshape(-1, many), (v @ other).reshape(-1, many)
    apart = np.repeat(size, many, axis=0)
    c = (apart ** 2 - (o @ other).reshape(-1, many)) / 2
    length = np.hypot(x, y)
    flat = length <= EPS * apart
    dead = np.any(flat & (c < -EPS * apart ** 2), axis=1)
    # a bisector parallel to the plane draws no line on it: one out of the way of all others
    length[flat] = 1.0
    x, y, c = np.where(flat, 0.0, x / length), np.where(flat, 0.0, y / length), np.where(flat, 1e300, c / length)
    near = np.where(flat, 0.0, c)
    lo, hi, blocked = np.empty_like(c), np.empty_like(c), np.empty_like(flat)
    rows = max(1, (1 << 16) // (many * many))
    met = np.tri(many, k=-1, dtype=bool)[None]
    for k in range(0, len(x), rows):
        at = slice(k, k + rows)
        den = x[at, :, None] * y[at, None, :]
        den -= y[at, :, None] * x[at, None, :]
        num = x[at, :, None] * x[at, None, :]
        num += y[at, :, None] * y[at, None, :]
        num *= -near[at, :, None]
        num += c[at, None, :]
        # a line outside another's half plane, or on a line already met, carries no edge
        blocked[at] = np.any((np.abs(den) <= EPS) & ((num < -EPS) | ((np.abs(num) <= EPS) & met)), axis=2)
        with np.errstate(divide="ignore", invalid="ignore"):
            num /= den
        hi[at] = np.min(np.where(den > EPS, num, np.inf), axis=2)
        lo[at] = np.max(np.where(den < -EPS, num, -np.inf), axis=2)
    blocked |= flat | dead[:, None]
    with np.errstate(invalid="ignore"):
        on = (~blocked & (hi - lo > EPS)).reshape(cells, many * many)
    ends = (np.isfinite(hi) & np.isfinite(lo)).reshape(on.shape)
    closed = on.any(axis=1) & ~(on & ~ends).any(axis=1)
    on = (on & closed[:, None]).reshape(-1, many)
    hi, lo, c = np.where(on, hi, 0.0), np.where(on, lo, 0.0), np.where(on, c, 0.0)
    j, k = np.nonzero(on)
    u, v, mid = u.reshape(-1, 3)[j], v.reshape(-1, 3)[j], o.reshape(-1, 3)[j] / 2
    tips = []
    for t in (lo[j, k], hi[j, k]):
        along = (c[j, k] * x[j, k] - t * y[j, k])[:, None] * u + (c[j, k] * y[j, k] + t * x[j, k])[:, None] * v
        tips.append(mid + along)
    # the two ends of an edge one after the other, so that those of a cell stay together
    corners = np.stack(tips, axis=1).reshape(-1, 3)
    begins = np.searchsorted(j // many, np.arange(cells + 1)) * 2
    radius = np.full(cells, np.inf)
    for i in np.flatnonzero(closed):
        radius[i] = np.linalg.norm(corners[begins[i]:begins[i + 1]], axis=1).max()
    return 0.5 * np.sum(c * (hi - lo), axis=1).reshape(cells, many), radius, corners, begins


def _intervals(o: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of one 2D cell: the parts of its neighbours' bisectors that no other neighbour cuts off."""
    x, y, d = o[:, 0], o[:, 1], np.hypot(o[:, 0], o[:, 1])
    den = (x[:, None] * y[None] - y[:, None] * x[None]) / d[:, None]
    num = (d * d - o[:, :2] @ o[:, :2].T) / 2
    flat = np.abs(den) <= EPS * d
    with np.errstate(divide="ignore", invalid="ignore"):
        t = num / den
    lo = np.max(np.where(~flat & (den < 0), t, -np.inf), axis=1)
    hi = np.min(np.where(~flat & (den > 0), t, np.inf), axis=1)
    return lo, np.where((flat & (num < -EPS * d * d)).any(axis=1), -np.inf, hi)


def _faces(samples: pa.Array, ids: list[pa.Array], tiles: list[Tile], dim: int) -> Iterator[pa.RecordBatch]:
    """Facets of the cells of some tiles, a row for each seed at the place of the neighbour."""
    for numbers, some, part in parts_of(tiles):
        yield _faces_of(samples.take(pa.array(numbers)), [ids[t] for t in numbers], some, part, dim)


def _faces_of(samples: pa.Array, ids: list[pa.Array], tiles: list[Tile], part: tuple, dim: int) -> pa.RecordBatch:
    cells, tile, row, places, boxes = part
    if dim == 2:
        lo, hi = cells.ends()
        with np.errstate(invalid="ignore"):
            on = hi - lo > EPS
    else:
        areas = cells.areas()
        on = areas > EPS * areas.max(axis=1, initial=0)[:, None]
    on &= ~(cells.torn | cells.outgrown)[:, None]
    cell, plane = np.nonzero(on)
    label = cells.label[cell, plane]
    faces = np.concatenate([np.stack([np.eye(3)[a], -np.eye(3)[a]]) for a in range(3)])
    turned = faces[np.where(label < 0, -1 - label, 0)]
    place = np.full(len(label), -1)
    place[label >= 0], turned[label >= 0] = places[label[label >= 0]], boxes[label[label >= 0]]
    offset = cells.offset[cell, plane]
    values = [lo[cell, plane], hi[cell, plane]] if dim == 2 else [areas[cell, plane]]
    for i in np.flatnonzero(cells.torn & ~cells.outgrown):
        o, q, moved = around(tiles[tile[i]], row[i], 4 * cells.reach2[i] * (1 + 1e-9))
        if dim == 2:
            found = _intervals(o)
            keep = found[1] - found[0] > EPS
        else:
            found = _cells_3d([o])[0][:1]
            keep = found[0] > EPS * max(found[0].max(), 0)
        cell, place, turned, offset = np.append(cell, np.full(keep.sum(), i)), np.append(place, q[keep]), np.append(turned, moved[keep], axis=0), np.append(offset, o[keep], axis=0)
        values = [np.append(v, f[keep]) for v, f in zip(values, found)]
    # from places to seeds
    seeds = np.cumsum([0] + [len(t.points) for t in tiles])
    begin = np.cumsum([0] + [len(t.at) for t in tiles])
    order = np.concatenate([t.order + k for t, k in zip(tiles, seeds)])
    first = np.concatenate([t.first[:-1] + k for t, k in zip(tiles, seeds)])
    many = np.concatenate([np.diff(t.first) for t in tiles])
    own = np.concatenate([t.own + k for t, k in zip(tiles, seeds)])[cell]
    turns = np.concatenate([t.turns for t in tiles])
    itself = np.concatenate([t.place + k for t, k in zip(tiles, begin)])[own]
    place = np.where(place < 0, itself, place + begin[tile[cell]])
    n = many[place]
    rep = np.repeat(np.arange(len(place)), n)
    other = order[first[place][rep] + np.arange(len(rep)) - (np.cumsum(n) - n)[rep]]
    image = (turned[rep] + turns[own[rep]] - turns[other]).astype(np.int32)
    every = pa.concat_arrays(ids)
    offset = offset[rep]
    out = {"sample_id": samples.take(pa.array(tile[cell][rep])), "i": every.take(pa.array(own[rep])), "j": every.take(pa.array(other))}
    out |= {f"image_{a}": pa.array(image[:, k]) for k, a in enumerate(axes(dim))} | {f"d{a}": pa.array(offset[:, k]) for k, a in enumerate(axes(dim))}
    out |= {"d": pa.array(np.sqrt((offset ** 2).sum(axis=1)))} | {v: pa.array(x[rep]) for v, x in zip(("lo", "hi") if dim == 2 else ("area",), values)}
    return pa.RecordBatch.from_pydict(out)


def _tile(rows: pa.Table, dim: int) -> Tile:
    points = np.stack([rows.column(a).to_numpy() if a in axes(dim) else np.zeros(rows.num_rows) for a in "xyz"], axis=1)
    sides = np.array([rows.column(b)[0].as_py() for b in box(dim)] + [0.0] * (3 - dim))
    # a seed without an id bounds others, but its cell has no name
    return Tile(points, np.flatnonzero(pc.and_(rows.column("_own"), pc.is_valid(rows.column("seed_id"))).to_numpy(zero_copy_only=False)), sides, dim)


def _fewer(rows: pa.Table, dim: int) -> pa.Table:
    """A tile without those rows around it that no cell has a facet with: cells only shrink, so they never will."""
    tile = _tile(rows, dim)
    keep = rows.column("_own").to_numpy(zero_copy_only=False).copy()
    used = np.zeros(len(tile.at), bool)
    for _, (one,), (cells, _, row, places, _) in parts_of([tile]):
        labels = cells.label[~(cells.torn | cells.outgrown)]
        used[places[labels[labels >= 0]]] = True
        for i in np.flatnonzero(cells.torn & ~cells.outgrown):
            q = around(one, row[i], 4 * cells.reach2[i] * (1 + 1e-9))[1]
            used[q[q >= 0]] = True
    return rows.filter(pa.array(keep | used[tile.place]))


def _groups(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.Table]:
    """The rows of one tile after the other; of those around a tile no more are held than its cells may need."""
    held, most = None, HELD
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows
        new = np.zeros(max(rows.num_rows - 1, 0), bool)
        for k in TILE:
            new |= pc.not_equal(rows.column(k).slice(1), rows.column(k).slice(0, max(rows.num_rows - 1, 0))).to_numpy()
        ends = np.flatnonzero(new) + 1
        for a, b in zip([0, *ends[:-1]], ends):
            yield rows.slice(a, b - a)
        if len(ends):
            rows, most = rows.slice(ends[-1]), HELD
        if rows.num_rows > most:
            rows = _fewer(rows, dim)
            most = max(HELD, 2 * rows.num_rows)
        held = rows if rows.num_rows else None
    if held is not None:
        yield held


def _cut(rows: DataFrame, dim: int, sizes: bool = False) -> DataFrame:
    """Facets of the cells of the rows marked ``_own`` by tile; with ``sizes``: how far from a seed of the tile others can touch its cell."""
    keys = {f: rows.schema[f].dataType.simpleString() for f in ("sample_id", "seed_id")}

    def facets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, tiles = [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if tiles:
                yield from _faces(pa.concat_arrays(names), ids, tiles, dim)
            names.clear(), ids.clear(), tiles.clear()

        for group in _groups(batches, dim):
            group = group.combine_chunks()
            names.append(group.column("sample_id").slice(0, 1).combine_chunks())
            ids.append(group.column("seed_id").combine_chunks())
            tiles.append(_tile(group, dim))
            if sum(len(t.own) for t in tiles) >= AT_ONCE or sum(len(t.points) for t in tiles) >= HELD:
                yield from done()
        yield from done()

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, dim):
            group = group.combine_chunks()
            reach2 = np.concatenate([[0.0], *[cells.reach2[~cells.outgrown] for _, _, (cells, *_) in parts_of([_tile(group, dim)])]])
            yield pa.RecordBatch.from_pydict({k: group.column(k).slice(0, 1).combine_chunks() for k in TILE} | {"_need": pa.array([2.0 * float(np.sqrt(reach2.max()))])})

    dealt = spread(rows, *TILE).sortWithinPartitions(*TILE, F.desc("_own"))
    if sizes:
        return dealt.mapInArrow(needs, f"sample_id {keys['sample_id']}, _tile bigint, _need double")
    values = ", ".join([f"image_{a} int" for a in axes(dim)] + [f"d{a} double" for a in axes(dim)] + ["d double"] + (["lo double", "hi double"] if dim == 2 else ["area double"]))
    return dealt.mapInArrow(facets, f"sample_id {keys['sample_id']}, i {keys['seed_id']}, j {keys['seed_id']}, {values}")


def _stretches(rows: DataFrame, dim: int) -> DataFrame:
    """Seeds of large samples by tile: stretches of a curve through the box, cut in two where the curve jumps furthest."""
    placed = z_order(rows.withColumns({f"c{a}": F.col(a) for a in axes(dim)}), dim)
    numbered = number_rows(placed.select("sample_id", "seed_id", *axes(dim), "_code"), ["sample_id"], ["_code", "seed_id", *axes(dim)], "_pos")
    stretch = Window.partitionBy("sample_id", "_stretch")
    ends = numbered.withColumn("_stretch", F.floor(F.col("_pos") / STRETCH).cast("long")).withColumns({"_lo": F.min("_code").over(stretch), "_hi": F.max("_code").over(stretch)})
    ends = ends.withColumn("_bit", F.length(F.bin(F.col("_lo").bitwiseXOR(F.col("_hi")))) - 1)
    upper = F.expr("_lo <> _hi AND shiftright(_code, _bit) = shiftright(_hi, _bit)").cast("long")
    return checkpoint(ends.select("sample_id", (2 * F.col("_stretch") + upper).alias("_tile"), "seed_id", *axes(dim)))


def _with_halo(seeds: DataFrame, tiles: DataFrame, facts: DataFrame, wanted: DataFrame, dim: int) -> DataFrame:
    """Seeds of the wanted tiles and those within ``_reach`` of their bounds, images included."""
    at = [f"c{a}" for a in axes(dim)]
    keep = ["_half", "_r", *[f"_e{a}" for a in axes(dim)], *at]
    both = tiles.join(unfolded(wanted.select(*TILE, F.col("_reach").alias("_r"))), TILE, "left").withColumn("_r", F.coalesce("_r", F.lit(0.0)))
    both = checkpoint(both.withColumnRenamed("_tile", "particle_id"))
    # grids count their cells, times 2^14, in 64 bits, so none is smaller than this
    least = 2 * norm([F.col(b) for b in box(dim)]) / (1 << 18)
    pairs = near_pairs(attach(both, facts.select("sample_id", least.alias("_least"))), facts, dim, F.greatest((F.col("_half") + F.col("_r")) * (1 + 1e-6), "_least"), keep)
    sides = [pairs.select("sample_id", F.col(f"{x}_particle_id").alias("_for"), F.col(f"{y}_particle_id").alias("_tile"), *[F.col(f"{x}_{k}").alias(k) for k in keep],
                          F.col(f"{y}__half").alias("_other"), "d") for x, y in ("ab", "ba")]
    own = both.select("sample_id", F.col("particle_id").alias("_for"), F.col("particle_id").alias("_tile"), *keep, F.lit(0.0).alias("_other"), F.lit(0.0).alias("d"))
    near = sides[0].unionByName(sides[1]).unionByName(own).where((F.col("_r") > 0) & (F.col("d") <= (F.col("_half") + F.col("_r") + F.col("_other")) * (1 + 1e-6)))
    rows = attach(seeds.join(unfolded(near), TILE), facts)
    gaps = norm([F.greatest(F.abs(min_image(F.col(a) - F.col(f"c{a}"), F.col(f"l{a}"))) - F.col(f"_e{a}"), F.lit(0.0)) for a in axes(dim)])
    return rows.where(gaps <= F.col("_r")).select("sample_id", F.col("_for").alias("_tile"), (F.col("_for") == F.col("_tile")).alias("_own"), "seed_id", *axes(dim), *box(dim))


def _large(rows: DataFrame, facts: DataFrame, dim: int) -> DataFrame:
    """Rows for ``_cut`` of samples that are many tiles. A tile first looks as far as some seeds lie apart; its cells then tell how far it must."""
    seeds = _stretches(rows, dim)
    placed = attach(seeds, facts)
    ends = [f(wrap(F.col(a), F.col(f"l{a}"))).alias(f"_{n}{a}") for a in axes(dim) for n, f in (("lo", F.min), ("hi", F.max))]
    tiles = placed.groupBy(*TILE).agg(*ends, F.count(F.lit(1)).alias("_many"), F.first("_all").alias("_all"))
    half = [(F.col(f"_hi{a}") - F.col(f"_lo{a}")) / 2 for a in axes(dim)]
    apart = F.lit(1.0)
    for e in half:
        apart = apart * 2 * e
    first = F.greatest(4 * F.pow(apart / F.col("_many"), F.lit(1 / dim)), 2 * F.greatest(*half) / F.col("_many"))
    tiles = checkpoint(tiles.select(*TILE, "_all", *[((F.col(f"_hi{a}") + F.col(f"_lo{a}")) / 2).alias(f"c{a}") for a in axes(dim)],
                                    *[(e * SLACK).alias(f"_e{a}") for e, a in zip(half, axes(dim))], (norm(half) * SLACK).alias("_half"),
                                    F.when(first > 0, F.least(first, F.col("_all"))).otherwise(F.col("_all") / 1024).alias("_reach")))
    left, known = tiles.select(*TILE, "_all", "_reach"), None
    while True:
        need = _cut(_with_halo(seeds, tiles, facts, left, dim), dim, sizes=True)
        most = F.greatest(4 * F.col("_reach"), F.col("_all") / 1024)
        looked = checkpoint(left.join(unfolded(need), TILE).select(*TILE, "_all", (F.col("_need") * SLACK <= most).alias("_known"), F.least(F.col("_need") * SLACK, most).alias("_reach")))
        sure = looked.where("_known").select(*TILE, "_reach")
        known = sure if known is None else known.unionByName(sure)
        left = looked.where("NOT _known").drop("_known")
        if left.isEmpty():
            return _with_halo(seeds, tiles, facts, known, dim)


def _facets(seeds: DataFrame, samples: DataFrame, dim: int) -> DataFrame:
    """Facets of every cell. They are cut as they are read: a plan that reads them twice cuts them twice."""
    there = F.lit(True)
    for a in axes(dim):
        there = there & (F.abs(a) < float("inf"))
    seeds = checkpoint(seeds.select("sample_id", F.col("seed_id").cast("bigint") if dim == 3 else "seed_id", *axes(dim)).where(there))
    n = seeds.groupBy("sample_id").agg(F.count(F.lit(1)).alias("_n"))
    sides = samples.select("sample_id", *box(dim)).where(" AND ".join(f"{b} > 0" for b in box(dim)))
    facts = checkpoint(attach(sides, n).withColumn("_all", 2 * norm([F.col(b) for b in box(dim)])))
    rows = attach(seeds, facts)
    out = _cut(rows.where(F.col("_n") <= SAMPLE).select("sample_id", F.lit(0).cast("long").alias("_tile"), F.lit(True).alias("_own"), "seed_id", *axes(dim), *box(dim)), dim)
    if not facts.where(F.col("_n") > SAMPLE).isEmpty():
        out = out.unionByName(_cut(_large(rows.where(F.col("_n") > SAMPLE), facts.drop("_n"), dim), dim))
    # the seed's own images close every cell
    return out.withColumn("closed", F.lit(True))


def voronoi_2d(seeds: DataFrame, samples: DataFrame) -> DataFrame:
    """Edges of the cells of the seeds in their boxes (nine images).

    ``i, j, image_x, image_y``: whose edge, with whom, in which image; ``nx, ny, length``;
    ``lo, hi``: its ends along the bisector from the midpoint; open edges have null ends.
    """
    out = _facets(seeds, samples, 2)
    return out.select("sample_id", "i", "j", "image_x", "image_y", (F.col("dx") / F.col("d")).alias("nx"),
                      (F.col("dy") / F.col("d")).alias("ny"), "d", "lo", "hi", (F.col("hi") - F.col("lo")).alias("length"), "closed")


def voronoi_3d(seeds: DataFrame, samples: DataFrame) -> DataFrame:
    """Facets of the cells (27 images): neighbour, outward normal, area."""
    out = _facets(seeds, samples, 3)
    return out.select("sample_id", "i", "j", "image_x", "image_y", "image_z",
                      *[(F.col(f"d{a}") / F.col("d")).alias(f"n{a}") for a in "xyz"], "d", "area", "closed")


def closed_cells(facets: DataFrame, cell: str = "i") -> DataFrame:
    """Facets of the cells without a vertex at infinity."""
    open_ = facets.where("NOT closed").select("sample_id", cell).distinct()
    return facets.join(open_, ["sample_id", cell], "left_anti")


def cells_2d(edges: DataFrame, cell: str = "i") -> DataFrame:
    """Per cell: edges, perimeter, area."""
    return edges.groupBy("sample_id", cell).agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum("length").alias("perimeter"),
        (F.sum(F.col("d") / 2 * F.col("length")) / 2).alias("area"))


def cells_3d(facets: DataFrame, cell: str = "i") -> DataFrame:
    """Per cell: facets, surface area, volume."""
    return facets.groupBy("sample_id", cell).agg(
        F.count(F.lit(1)).alias("n_facets"), F.sum("area").alias("area"),
        (F.sum(F.col("d") / 2 * F.col("area")) / 3).alias("volume"))


def seeds_of(particles: DataFrame, dim: int) -> DataFrame:
    return particles.select("sample_id", F.col("particle_id").alias("seed_id"),
                            *[F.col(f"c{a}").alias(a) for a in axes(dim)])


def _surface_seeds(particles: DataFrame, dim: int, n: int) -> DataFrame:
    """Surface points of all particles, eroded by the least critical thickness of their sample."""
    thin = with_erosion(particles).groupBy("sample_id").agg(F.min("erosion").alias("_erosion"))
    # particles are moved, not the many points they unfold to
    points = surface_points(spread(attach(particles, thin), "sample_id", "particle_id"), n, F.col("_erosion"))
    number = F.col("k") if dim == 2 else F.col("theta_k") * n + F.col("k")
    per = n if dim == 2 else n * n
    # points that coincide (a fully eroded disk, the poles of a sphere) are one seed
    return (points.withColumn("seed_id", F.col("particle_id") * per + number)
            .groupBy("sample_id", "particle_id", *[F.round(F.col(a), 12).alias(f"_{a}") for a in axes(dim)])
            .agg(F.min("seed_id").alias("seed_id"), *[F.min_by(a, "seed_id").alias(a) for a in axes(dim)])
            .select("sample_id", "seed_id", *axes(dim)))


def _between_particles(facets: DataFrame, per: int, dim: int) -> DataFrame:
    """Facets between different particles (or images), by particle."""
    i, j = F.floor(F.col("i") / per).cast("long"), F.floor(F.col("j") / per).cast("long")
    same = i == j
    for a in axes(dim):
        same = same & (F.col(f"image_{a}") == 0)
    return facets.where(~same).withColumn("particle_id", i).withColumn("neighbor_id", j)


def set_voronoi_2d(particles: DataFrame, samples: DataFrame, n: int = 10) -> DataFrame:
    """Edges of the set Voronoi cells of whole particles, from n surface seeds each."""
    return _between_particles(voronoi_2d(_surface_seeds(particles, 2, n), samples), n, 2)


def set_voronoi_3d(particles: DataFrame, samples: DataFrame, n: int) -> DataFrame:
    """Facets of the set Voronoi cells, from n * n surface seeds each."""
    return _between_particles(voronoi_3d(_surface_seeds(particles, 3, n), samples), n * n, 3)


def seed_problems(particles: DataFrame) -> DataFrame:
    """Particles that have no surface seeds: cylinders carry neither surface points nor an erosion."""
    erosion = by_shape(particles, lambda s, c: s.erosion(c) if s.erosion else None)
    return particles.where(erosion.isNull()).select(
        "sample_id", "particle_id", F.concat(F.lit("a "), F.col("shape"), F.lit(" has no surface points")).alias("message"))


# --- Minkowski structure metrics --------------------------------------------------------


def imt_2d(edges: DataFrame, cell: str = "i", order: int = 6) -> DataFrame:
    """psi_s = sum of length * exp(i s theta) over the edge normals; ``q_s`` = |psi_s| / psi_0."""
    theta = F.atan2("ny", "nx")
    sums = []
    for s in range(order + 1):
        sums += [F.sum(F.col("length") * F.cos(s * theta)).alias(f"re_{s}"),
                 F.sum(F.col("length") * F.sin(s * theta)).alias(f"im_{s}")]
    out = edges.groupBy("sample_id", cell).agg(*sums)
    return out.select("sample_id", cell, F.col("re_0").alias("perimeter"), *[
        (F.hypot(f"re_{s}", f"im_{s}") / F.col("re_0")).alias(f"q_{s}") for s in range(1, order + 1)])


def _legendre(order: int) -> dict[tuple[int, int], np.ndarray]:
    """Coefficients in z of P_l^m without its sine factor, by the usual recurrence in l."""
    table: dict[tuple[int, int], np.ndarray] = {}
    z = np.array([0.0, 1.0])
    for m in range(order + 1):
        table[m, m] = np.array([float(np.prod(np.arange(1, 2 * m, 2)))])
        for deg in range(m + 1, order + 1):
            up = (2 * deg - 1) * np.convolve(z, table[deg - 1, m])
            if deg - 2 >= m:
                down = (deg + m - 1) * table[deg - 2, m]
                up[:len(down)] -= down
            table[deg, m] = up / (deg - m)
    return table


def _polynomial(z: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(float(coefficients[-1]))
    for c in coefficients[-2::-1]:
        out = out * z + F.lit(float(c))
    return out


def imt_3d(facets: DataFrame, cell: str = "i", order: int = 6, unit_q0: bool = False) -> DataFrame:
    """``q_l`` of the facet normals weighted by area, q_0 being the surface area (or one).

    One sum per spherical harmonic with m >= 0, the others being their conjugates: cells need
    no pairs of facets and aggregate before the shuffle.
    """
    powers = [(F.lit(1.0), F.lit(0.0))]
    rows = facets.select("sample_id", cell, "nx", "ny", "nz", "area")
    for m in range(1, order + 1):
        re, im = F.col(f"_c{m - 1}") if m > 1 else powers[0][0], F.col(f"_s{m - 1}") if m > 1 else powers[0][1]
        rows = rows.withColumn(f"_c{m}", re * F.col("nx") - im * F.col("ny")).withColumn(
            f"_s{m}", re * F.col("ny") + im * F.col("nx"))
    table, sums = _legendre(order), [F.sum("area").alias("_area")]
    for (deg, m), poly in table.items():
        value = F.col("area") * _polynomial(F.col("nz"), poly)
        sums.append(F.sum(value * (F.col(f"_c{m}") if m else 1.0)).alias(f"_re_{deg}_{m}"))
        if m:
            sums.append(F.sum(value * F.col(f"_s{m}")).alias(f"_im_{deg}_{m}"))
    out = rows.groupBy("sample_id", cell).agg(*sums)
    q = []
    for deg in range(1, order + 1):
        total = F.col(f"_re_{deg}_0") * F.col(f"_re_{deg}_0")
        for m in range(1, deg + 1):
            # 4 pi / (2l + 1) times the squared norm of Y_lm is (l - m)! / (l + m)!, twice for +-m
            weight = 2.0 / float(np.prod(np.arange(deg - m + 1, deg + m + 1, dtype=float)))
            total = total + weight * (F.col(f"_re_{deg}_{m}") * F.col(f"_re_{deg}_{m}")
                                      + F.col(f"_im_{deg}_{m}") * F.col(f"_im_{deg}_{m}"))
        q.append((F.sqrt(total) / F.col("_area")).alias(f"q_{deg}"))
    return out.select("sample_id", cell, F.col("_area").alias("area"),
                      (F.lit(1.0) if unit_q0 else F.col("_area")).alias("q_0"), *q)
