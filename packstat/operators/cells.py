"""Voronoi cells of many seeds at once, in NumPy.

A cell begins as the box around its seed, which the seed's own images cut out, and loses what lies beyond the bisector of one
neighbour after the other, the nearest first, until the next one is too far to reach any of its corners. Corners are triples
of planes that know the corners across their edges, so a cut touches only what it takes away and what it leaves open.
2D cells are boxes of no height.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np

#: Corners and planes a cell has room for at first; neighbours after which a cell is cut alone, so that the others need no such room.
ROOM, MOST = 32, 128
#: Distances that are held at once, and neighbours of a cell that are sorted first.
HELD, FIRST = 1 << 20, {2: 40, 3: 128}
NEAREST = ((0, 0, 0),)
OTHERS = {2: tuple((x, y, 0) for x in (0, 1) for y in (0, 1))[1:], 3: tuple((x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1))[1:]}
SIGNS = np.array([(x, y, z) for x in (1, -1) for y in (1, -1) for z in (1, -1)])


class Cells:
    """Boxes of the given sides around their seeds, to be cut.

    ``corner`` (3, cell, slot) and ``far`` (its square, 0 for a free slot); ``planes`` of a corner, turning the same way in all,
    and ``across``: the slot of the corner beyond the edge of a plane and the next one. ``offset`` and ``label`` of a cell's
    planes: the neighbours that cut it so far, after six for the faces of the box (labels -1 to -6: +x, -x, +y, ...).
    """

    def __init__(self, sides: np.ndarray, most: int | None = None) -> None:
        m, self.most = len(sides), most
        self.corner, self.far = np.zeros((3, m, ROOM)), np.zeros((m, ROOM))
        self.planes, self.across = np.zeros((m, ROOM, 3), np.int32), np.zeros((m, ROOM, 3), np.int32)
        self.free, self.n_free, self.top = np.zeros((m, ROOM), np.int32), np.zeros(m, np.int64), np.full(m, 8)
        self.offset, self.label, self.n_planes = np.zeros((m, ROOM, 3)), np.full((m, ROOM), -1, np.int64), np.full(m, 6)
        self.label[:, :6] = -1 - np.arange(6)
        for a in range(3):
            self.offset[:, 2 * a, a], self.offset[:, 2 * a + 1, a] = sides[:, a], -sides[:, a]
        for k, signs in enumerate(SIGNS):
            self.corner[:, :, k] = (sides * signs / 2).T
            order = [0, 1, 2] if signs.prod() > 0 else [0, 2, 1]
            for e in range(3):
                self.planes[:, k, e] = 2 * order[e] + (signs[order[e]] < 0)
                self.across[:, k, e] = k ^ (4 >> order[(e + 2) % 3])
        self.far[:, :8] = (self.corner[:, :, :8] ** 2).sum(axis=0)
        self.reach2 = self.far.max(axis=1)
        #: Cells that rounding has left without a closed surface: to be cut by other means.
        self.torn = np.zeros(m, bool)
        #: Cells that more than ``most`` planes have cut: not cut any further.
        self.outgrown = np.zeros(m, bool)

    def _more_room(self, corners: int, planes: int) -> None:
        def wider(x: np.ndarray, axis: int, n: int, value: int = 0) -> np.ndarray:
            more = [(0, 0)] * x.ndim
            more[axis] = (0, max(0, n - x.shape[axis]))
            return np.pad(x, more, constant_values=value)

        if corners > self.far.shape[1]:
            n = max(corners, 2 * self.far.shape[1])
            self.corner, self.far, self.free = wider(self.corner, 2, n), wider(self.far, 1, n), wider(self.free, 1, n)
            self.planes, self.across = wider(self.planes, 1, n), wider(self.across, 1, n)
        if planes > self.label.shape[1]:
            n = max(planes, 2 * self.label.shape[1])
            self.offset, self.label = wider(self.offset, 1, n), wider(self.label, 1, n, -1)

    def cut(self, g: np.ndarray, o: np.ndarray, label: np.ndarray) -> None:
        """Cut each of the cells ``g`` by one neighbour."""
        o2 = np.einsum("ij,ij->i", o, o)
        size = np.sqrt(o2)
        c = self.corner if len(g) == len(self.far) else self.corner[:, g]
        d = c[0] * o[:, :1]
        d += c[1] * o[:, 1:2]
        d += c[2] * o[:, 2:]
        d -= o2[:, None] / 2
        beyond = d > (size * (1e-12 * size + 4e-15 * np.sqrt(self.reach2[g])))[:, None]
        hit = np.flatnonzero(beyond.any(axis=1))
        if self.most is not None:
            over = self.n_planes[g[hit]] >= self.most
            self.outgrown[g[hit[over]]] = True
            hit = hit[~over]
        if not len(hit):
            return
        if len(hit) < len(g):
            g, o, label, d, beyond = g[hit], o[hit], label[hit], d[hit], beyond[hit]
        cell, gone = np.nonzero(beyond)
        at = g[cell]
        planes, across = self.planes[at, gone], self.across[at, gone]
        # edges between a corner that goes and one that stays
        row, e = np.nonzero(~beyond[cell[:, None], across])
        own, a, b, stays, goes = cell[row], planes[row, e], planes[row, (e + 1) % 3], across[row, e], gone[row]
        to = g[own]
        n_gone, n_new = np.bincount(cell, minlength=len(g)), np.bincount(own, minlength=len(g))
        begin, begin_new = np.cumsum(n_gone) - n_gone, np.cumsum(n_new) - n_new
        rank, rank_new = np.arange(len(cell)) - begin[cell], np.arange(len(own)) - begin_new[own]
        # new corners take the slots of those that go, then free ones, then new ones
        new = gone[np.minimum(begin[own] + rank_new, len(gone) - 1)]
        rest = np.flatnonzero(rank_new >= n_gone[own])
        more, free = rank_new[rest] - n_gone[own[rest]], self.n_free[to[rest]]
        new[rest] = np.where(more < free, self.free[to[rest], np.maximum(free - 1 - more, 0)], self.top[to[rest]] + more - free)
        short = np.maximum(n_new - n_gone, 0)
        taken = np.minimum(short, self.n_free[g])
        self.top[g] += short - taken
        self.n_free[g] -= taken
        self._more_room(int(self.top[g].max()), int(self.n_planes[g].max()) + 1)
        spare = np.flatnonzero(rank >= n_new[cell])
        self.free[at[spare], self.n_free[at[spare]] + rank[spare] - n_new[cell[spare]]] = gone[spare]
        self.n_free[g] += np.maximum(n_gone - n_new, 0)
        # where the edges meet the bisector
        near, past = np.minimum(d[own, stays], 0), d[own, goes]
        v = self.corner[:, to, stays]
        v = v + (self.corner[:, to, goes] - v) * (near / (near - past))
        p = self.n_planes[g]
        self.offset[g, p], self.label[g, p] = o, label
        self.n_planes[g] += 1
        # the new face is a ring: who starts and who ends at a plane
        starts, ends = np.full((len(g), self.label.shape[1]), -1), np.full((len(g), self.label.shape[1]), -1)
        starts[own, a], ends[own, b] = new, new
        following, before = starts[own, b], ends[own, a]
        beside = self.planes[to, stays]
        side = np.argmax(beside == b[:, None], axis=1)
        torn = (starts[own, a] != new) | (ends[own, b] != new) | (following < 0) | (before < 0) | (beside[np.arange(len(own)), (side + 1) % 3] != a)
        self.corner[:, at, gone], self.far[at, gone] = 0.0, 0.0
        self.corner[:, to, new], self.far[to, new] = v, (v * v).sum(axis=0)
        self.across[to, stays, side] = new
        self.planes[to, new] = np.stack([a, b, p[own]], axis=1)
        self.across[to, new] = np.stack([stays, following, before], axis=1)
        if torn.any():
            self.torn[to[torn]] = True
        self.reach2[g] = np.where(self.torn[g], self.reach2[g], self.far[g].max(axis=1))

    def areas(self) -> np.ndarray:
        """Areas of the faces (cell, plane), from the triangles between their middle and their edges."""
        cell, slot = np.nonzero(self.far)
        planes, across = self.planes[cell, slot], self.across[cell, slot]
        out = np.zeros(self.label.size)
        for e in range(3):
            o = self.offset[cell, planes[:, e]]
            u, v = self.corner[:, cell, slot].T - o / 2, self.corner[:, cell, across[:, e]].T - o / 2
            size = np.sqrt(np.einsum("ij,ij->i", o, o))
            twice = np.einsum("ij,ij->i", o, np.cross(u, v)) / np.where(size > 0, size, 1.0)
            out += np.bincount(cell * self.label.shape[1] + planes[:, e], twice, minlength=len(out))
        return np.abs(out.reshape(self.label.shape)) / 2

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Of 2D cells: the ends (cell, plane) of the edges along their bisectors, from the midpoints."""
        cell, slot = np.nonzero(self.far)
        lo, hi = np.full(self.label.size, np.inf), np.full(self.label.size, -np.inf)
        x, y = self.corner[0, cell, slot], self.corner[1, cell, slot]
        for e in range(3):
            plane = self.planes[cell, slot, e]
            # the planes above and below a flat box have no offset
            keep = (plane != 4) & (plane != 5)
            o = self.offset[cell[keep], plane[keep]]
            t = (y[keep] * o[:, 0] - x[keep] * o[:, 1]) / np.hypot(o[:, 0], o[:, 1])
            at = cell[keep] * self.label.shape[1] + plane[keep]
            np.minimum.at(lo, at, t)
            np.maximum.at(hi, at, t)
        return lo.reshape(self.label.shape), hi.reshape(self.label.shape)


class Tile:
    """Places in a periodic box, and the seeds among them whose cells are wanted.

    Seeds at the same place are one for the cells; ``seeds`` are those of place ``q`` at ``first[q]:first[q + 1]`` of ``order``.
    """

    def __init__(self, points: np.ndarray, own: np.ndarray, sides: np.ndarray, dim: int) -> None:
        self.points, self.sides, self.dim = points, sides, dim
        self.box = np.where(np.arange(3) < dim, sides, 1.0)
        #: Whole boxes from the place in the box to the seed.
        self.turns = np.where(np.arange(3) < dim, np.floor(points / self.box), 0.0)
        inside = points - self.turns * self.box
        if len(np.unique(inside[:, 0])) == len(inside):
            self.order, self.place = np.arange(len(inside)), np.arange(len(inside))
        else:
            self.place = np.unique(inside, axis=0, return_inverse=True)[1].reshape(-1)
            self.order = np.argsort(self.place, kind="stable")
        n = int(self.place.max()) + 1 if len(inside) else 0
        self.first = np.searchsorted(self.place[self.order], np.arange(n + 1))
        self.at = inside[self.order[self.first[:-1]]]
        self.own = own

    def between(self, rows: np.ndarray, image: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Offsets from own seeds to the first seed of places, moved by so many boxes."""
        other = self.points[self.order[self.first[q]]]
        return other + image * np.where(np.arange(3) < self.dim, self.sides, 0.0) - self.points[self.own[rows]]

    def apart(self, rows: np.ndarray, far: tuple) -> tuple[np.ndarray, list, list]:
        """Squared distances (row, place for each of ``far``) to images, infinite to the seed itself; where those lie and the signs of their offsets.

        An image is the nearest along an axis, or the next beyond it on the other side where ``far`` has a one. There are no others
        to care for: cells lie in boxes around their seeds, and these must meet.
        """
        near, beyond, boxes, signs = [], [], [], []
        here = self.points[self.own[rows]] - self.turns[self.own[rows]] * self.box
        for a in range(self.dim):
            d = self.at[None, :, a] - here[:, a, None]
            n = np.rint(d / self.sides[a])
            d -= n * self.sides[a]
            signs.append(np.where(d < 0, -1.0, 1.0))
            boxes.append(n)
            beyond.append((d - signs[-1] * self.sides[a]) ** 2 if far is not NEAREST else None)
            near.append(d * d)
        itself = sum(near) == 0
        total = np.concatenate([sum(beyond[a] if on[a] else near[a] for a in range(self.dim)) for on in far], axis=1)
        total[np.tile(itself, (1, len(far)))] = np.inf
        return total, boxes, signs

    def image(self, rows: np.ndarray, q: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """Boxes between the first seed of a place and its image, which lies ``boxes`` from its place, as an own seed sees it."""
        return boxes + self.turns[self.own[rows]] - self.turns[self.order[self.first[q]]]


def _in_turn(cells: Cells, at: np.ndarray, d2: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> None:
    """Cut the cells ``at`` by their neighbours in the order of the columns, as long as these can reach a corner."""
    for k in range(d2.shape[1]):
        on = np.flatnonzero((d2[:, k] < 4 * cells.reach2[at]) & ~cells.torn[at] & ~cells.outgrown[at])
        if not len(on):
            return
        cells.cut(at[on], offsets[on, k], labels[on, k])


def _blocks(tiles: list[Tile], held: int):
    """Rows of own seeds, few enough that their distances fit."""
    for t, tile in enumerate(tiles):
        step = max(1, held // max(1, len(tile.at)))
        for k in range(0, len(tile.own), step):
            yield t, np.arange(k, min(k + step, len(tile.own)))


def _neighbors(tile: Tile, rows: np.ndarray, far: tuple, least: np.ndarray | None = None, most: np.ndarray | None = None) -> tuple:
    """Images around own seeds by distance: d2, offsets, places, boxes, and whether there are more. With ``most``: all from ``least`` to there."""
    d2, boxes, signs = tile.apart(rows, far)
    n = min(FIRST[tile.dim], d2.shape[1])
    if most is not None:
        d2[~((d2 >= least[:, None]) & (d2 < most[:, None]))] = np.inf
        n = int(np.isfinite(d2).sum(axis=1).max(initial=0))
    near = np.argpartition(d2, n - 1, axis=1)[:, :n] if 0 < n < d2.shape[1] else np.tile(np.arange(n), (len(rows), 1))
    near = np.take_along_axis(near, np.argsort(np.take_along_axis(d2, near, axis=1), axis=1), axis=1)
    found = np.take_along_axis(d2, near, axis=1)
    on, q = np.array(far)[near // max(1, len(tile.at))], near % max(1, len(tile.at))
    lies = np.zeros((*near.shape, 3))
    for a in range(tile.dim):
        lies[..., a] = -(np.take_along_axis(boxes[a], q, axis=1) + on[..., a] * np.take_along_axis(signs[a], q, axis=1))
    which = np.broadcast_to(rows[:, None], near.shape)
    return found, tile.between(which, tile.image(which, q, lies), q), q, lies, n < d2.shape[1]


class Neighbors:
    """What labels of planes stand for: places of tiles and their images."""

    def __init__(self) -> None:
        self.n, self.parts = 0, []

    def add(self, places: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """Labels of the given places, which lie ``boxes`` away."""
        self.parts.append((places.reshape(-1), boxes.reshape(-1, 3)))
        labels = self.n + np.arange(places.size)
        self.n += places.size
        return labels.reshape(places.shape)

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        faces = np.zeros((0,), np.int64), np.zeros((0, 3))
        return tuple(np.concatenate(x) for x in zip(faces, *self.parts))


def parts_of(tiles: list[Tile]) -> Iterator[tuple]:
    """``cells_of`` the tiles, then of each cell that has outgrown them, with the numbers of the tiles."""
    part = cells_of(tiles, MOST)
    yield np.arange(len(tiles)), tiles, part
    for i in np.flatnonzero(part[0].outgrown):
        alone = copy(tiles[part[1][i]])
        alone.own = alone.own[part[2][i]:part[2][i] + 1]
        yield part[1][i:i + 1], [alone], cells_of([alone], None)


def cells_of(tiles: list[Tile], most: int | None) -> tuple[Cells, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the own seeds of some tiles one after the other; per cell its tile and row; place and boxes of each label."""
    tile_of = np.repeat(np.arange(len(tiles)), [len(t.own) for t in tiles])
    row_of = np.concatenate([np.arange(len(t.own)) for t in tiles]) if tiles else np.zeros(0, int)
    begin = np.cumsum([0] + [len(t.own) for t in tiles])
    cells = Cells(np.stack([tiles[t].sides for t in tile_of]) if len(tile_of) else np.zeros((0, 3)), most)
    names = Neighbors()

    def cut(found: list[tuple]) -> None:
        """``found``: cells, then d2, offsets, places, boxes of their neighbours, a row each."""
        width = max((x[1].shape[1] for x in found), default=0)
        if not width:
            return
        at = np.concatenate([x[0] for x in found])
        d2, offsets, labels = np.full((len(at), width), np.inf), np.zeros((len(at), width, 3)), np.zeros((len(at), width), np.int64)
        k = 0
        for own, d, o, q, boxes in found:
            d2[k:k + len(own), :d.shape[1]], offsets[k:k + len(own), :d.shape[1]] = d, o
            labels[k:k + len(own), :d.shape[1]] = names.add(q, boxes)
            k += len(own)
        _in_turn(cells, at, d2, offsets, labels)

    first, last = [], np.full(len(tile_of), np.inf)
    for t, rows in _blocks(tiles, HELD):
        *found, more = _neighbors(tiles[t], rows, NEAREST)
        first.append((begin[t] + rows, *found))
        if more:
            last[begin[t] + rows] = found[0][:, -1]
    cut(first)
    # cells that further neighbours can reach, and those so wide that other images can
    for t, rows in _blocks(tiles, HELD):
        left = rows[(last[begin[t] + rows] < 4 * cells.reach2[begin[t] + rows]) & ~(cells.torn | cells.outgrown)[begin[t] + rows]]
        if len(left):
            cut([(begin[t] + left, *_neighbors(tiles[t], left, NEAREST, last[begin[t] + left], 4 * cells.reach2[begin[t] + left])[:4])])
    wide = []
    for t, rows in _blocks(tiles, HELD // 8):
        most = 4 * cells.reach2[begin[t] + rows]
        left = rows[(most >= (tiles[t].sides[:tiles[t].dim].min() / 2) ** 2 * (1 - 1e-9)) & ~(cells.torn | cells.outgrown)[begin[t] + rows]]
        if len(left):
            wide.append((begin[t] + left, *_neighbors(tiles[t], left, OTHERS[tiles[t].dim], np.zeros(len(left)), 4 * cells.reach2[begin[t] + left])[:4]))
            if sum(x[1].size for x in wide) >= HELD // 4:
                cut(wide)
                wide = []
    cut(wide)
    return (cells, tile_of, row_of, *names.all())


def around(tile: Tile, row: int, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All neighbours of an own seed nearer than the root of ``most``: offsets, places, boxes; the faces of its box first, with places of -1."""
    faces = np.stack([s * np.eye(3)[a] for a in range(tile.dim) for s in (1.0, -1.0)])
    parts = [(faces * tile.sides, np.full(len(faces), -1), faces)]
    for far in (NEAREST, OTHERS[tile.dim]):
        d2, o, q, boxes, _ = _neighbors(tile, np.array([row]), far, np.zeros(1), np.array([most]))
        keep = np.isfinite(d2[0])
        parts.append((o[0][keep], q[0][keep], boxes[0][keep]))
    return tuple(np.concatenate(x) for x in zip(*parts))
