"""Overlays of polygons: what of an outline others cover, what two polygons have in common, and polygons made valid."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from cartosieve.functions.arrangement import ON_LINE, Cut, Segments, cut, extents, odd_crossings, parts_of

COORD = pa.struct([(c, pa.float64()) for c in "xyz"])
SHAPE = pa.struct([("type", pa.string()), ("parts", pa.list_(pa.struct([("part", pa.int32()), ("ring", pa.int32()), ("coords", pa.list_(COORD))])))])


def shapes(kinds: list[str | None], parts: list[list[tuple[int, int, np.ndarray]]]) -> pa.StructArray:
    """Geometry of kinds and their parts: (part, ring, (n, 2) coordinates)."""
    flat = [p for own in parts for p in own]
    xy = np.concatenate([np.asarray(p[2], float).reshape(-1, 2) for p in flat]) if flat else np.zeros((0, 2))
    coords = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1]), pa.nulls(len(xy), pa.float64())], fields=list(COORD))
    ends = lambda sizes: pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), pa.int32())
    lines = pa.ListArray.from_arrays(ends([len(np.asarray(p[2]).reshape(-1, 2)) for p in flat]), coords)
    part = pa.StructArray.from_arrays([pa.array([p[0] for p in flat], pa.int32()), pa.array([p[1] for p in flat], pa.int32()), lines], fields=list(SHAPE.field("parts").type.value_type))
    return pa.StructArray.from_arrays([pa.array(kinds, pa.string()), pa.ListArray.from_arrays(ends([len(own) for own in parts]), part)], fields=list(SHAPE))


def lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values))


def covered(a: Segments, b: Segments, jobs: int, keep_shared: bool) -> Cut:
    """Oriented edges of pairs of polygons -> the stretches of a's outlines that are none of their union's: inside b, between the two, or, unless keep_shared, along both."""
    found = cut(a, b, jobs, np.ones(jobs, bool))
    gone = (found.side > 0) | ((found.side == 0) & (~found.same if keep_shared else True))
    return Cut(*(column[gone] for column in found))


def common_parts(a: Segments, b: Segments, jobs: int) -> tuple[np.ndarray, np.ndarray]:
    """(job, (n, 4)): the outline of what pairs of polygons have in common, its inside on the left: parts of either inside the other, and those along both."""
    out = []
    for own, other, shared in ((a, b, True), (b, a, False)):
        found = cut(own, other, jobs, np.ones(jobs, bool))
        kept = (found.side > 0) | (found.same & shared)
        out.append((found.job[kept], found.part[kept]))
    return np.concatenate([j for j, _ in out]), np.concatenate([p for _, p in out])


def traced(part: np.ndarray, grain: float) -> list[list[np.ndarray]]:
    """Polygons, each its outer ring and then its holes, from an outline with the inside on its left.

    It is followed from corner to corner by the sharpest left turn, so that parts that touch in a point stay apart, and a ring that comes to a corner again
    is cut there. Corners nearer than the grain are one; edges that lie on each other count once.
    """
    begin, end = ([tuple(k) for k in np.round(part[:, c] / grain).astype(np.int64).tolist()] for c in (slice(0, 2), slice(2, 4)))
    unique = {(b, e): i for i, (b, e) in enumerate(zip(begin, end, strict=True)) if b != e}
    leaving: dict[tuple, list[int]] = {}
    for i in unique.values():
        leaving.setdefault(begin[i], []).append(i)
    angle = np.arctan2(part[:, 3] - part[:, 1], part[:, 2] - part[:, 0]).tolist()
    turn = 2 * np.pi
    loops, free = [], set(unique.values())
    for first in sorted(free):
        now, loop = first, []
        while now in free:
            free.discard(now)
            loop.append(now)
            ahead = leaving.get(end[now])
            if not ahead:
                break
            back = angle[now] + np.pi - 1e-9
            now = min(ahead, key=lambda i: (back - angle[i]) % turn) if len(ahead) > 1 else ahead[0]
        for ring_edges in simple_loops(loop, begin):
            if len(ring_edges) < 3:
                continue
            points = part[ring_edges, :2]
            ring = np.concatenate((points, points[:1]))
            x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
            area = (x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2
            if abs(area) > grain * grain:
                loops.append((area, ring))
    outer = sorted(((a, r) for a, r in loops if a > 0), key=lambda x: x[0])
    found, holes = [[r] for _, r in outer], [r for a, r in loops if a < 0]
    if holes and outer:
        at = np.array([(h[0] + h[1]) / 2 for h in holes])
        for k in range(len(outer) - 1, -1, -1):  # the smallest that holds it is the last to say so
            r = outer[k][1]
            low, high = r.min(axis=0), r.max(axis=0)
            near = np.flatnonzero(((at >= low) & (at <= high)).all(axis=1))
            none = np.zeros(len(r) - 1, np.int64)
            inside = near[odd_crossings(at[near], np.zeros(len(near), np.int64), Segments(np.concatenate((r[:-1], r[1:]), axis=1), none, none))]
            if k == len(outer) - 1:
                holder = np.full(len(holes), -1)
            holder[inside] = k
        for h, k in zip(holes, holder.tolist(), strict=True):
            if k >= 0:
                found[k].append(h)
    return found


def simple_loops(loop: list[int], corner: dict | list) -> list[list[int]]:
    """A ring of edges, in order, cut wherever it comes to the corner of an edge again."""
    out, path, at = [], [], {}
    for e in loop:
        if corner[e] in at:
            k = at[corner[e]]
            out.append(path[k:])
            for gone in path[k:]:
                at.pop(corner[gone], None)
            del path[k:]
        at[corner[e]] = len(path)
        path.append(e)
    return [*out, path] if path else out


def left_parts(edges: Segments, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((n, 4), ring): whole edges, and of those at `place` the stretches from low to high; where low is not a number the edge is not whole. In the order of the edges."""
    whole, some = np.ones(len(edges.job), bool), ~np.isnan(low)
    whole[place] = False
    at = np.concatenate((np.flatnonzero(whole), place[some]))
    lo, hi = np.concatenate((np.zeros(len(at) - some.sum()), low[some])), np.concatenate((np.ones(len(at) - some.sum()), high[some]))
    order = np.lexsort((lo, at))
    at, lo, hi = at[order], lo[order, None], hi[order, None]
    first, last = edges.s[at, :2], edges.s[at, 2:]
    return np.concatenate((first + lo * (last - first), np.where(hi == 1, last, first + hi * (last - first))), axis=1), edges.ring[at]


class Joined(NamedTuple):
    """Rings, the lowest corner first and last, and lines of parts that go on with each other."""

    number: np.ndarray  # of the first of its parts: those of a line are numbered in order
    ring: np.ndarray  # that they are from
    closed: np.ndarray
    area: pa.Array  # of rings
    sizes: np.ndarray  # how many numbers of xy
    xy: np.ndarray
    corners: np.ndarray  # (n, 4): both ends on the grid
    angles: np.ndarray  # (n, 2): the first direction and the last


def joined_pieces(part: np.ndarray, ring: np.ndarray, low: np.ndarray, grain: float) -> Joined:
    """Parts in the order of their rings -> what they form: all that is left of a ring goes on from part to part where the corner on the grid is the same. A ring that comes to a corner again is cut there."""
    grid = np.round((part - np.tile(low, 2)) / grain).astype(np.int64)
    real = (grid[:, :2] != grid[:, 2:]).any(axis=1)
    part, ring, grid = part[real], ring[real], grid[real]
    n = len(part)
    first = np.flatnonzero(np.concatenate(([True], ring[1:] != ring[:-1]))) if n else np.zeros(0, np.int64)
    m = np.diff(np.concatenate((first, [n])))
    of = np.repeat(np.arange(len(first)), m)
    after = np.arange(1, n + 1)
    after[first + m - 1] = first
    begins = np.zeros(n, bool)
    begins[after] = (grid[:, 2:] != grid[after, :2]).any(axis=1)
    at = np.flatnonzero(begins)
    broken, which = np.unique(of[at], return_index=True)
    origin = first.copy()
    origin[broken] = at[which]
    order = np.lexsort(((np.arange(n) - origin[of]) % m[of], of))
    part, grid, begins = part[order], grid[order], begins[order]
    begins[first] = True
    line, at = np.cumsum(begins) - 1, np.flatnonzero(begins)
    size = np.diff(np.concatenate((at, [n])))
    closed = ~np.isin(of[at], broken)

    x, y = part[:, 0], part[:, 1]
    lowest = np.lexsort((y, x, line))[at] if n else at
    turn = np.where(closed, lowest - at, 0)
    taken = at[line] + (np.arange(n) - at[line] + turn[line]) % size[line]
    xy, last = np.empty((n + len(at), 2)), at + size + np.arange(len(at))
    xy[np.arange(n) + line] = part[taken, :2]
    xy[last] = np.where(closed[:, None], part[lowest, :2], part[at + size - 1, 2:])
    number, own, sizes = at, ring[first][of[at]], size + 1

    by_place = np.lexsort((grid[:, 1], grid[:, 0], line))
    same = (grid[by_place[1:], :2] == grid[by_place[:-1], :2]).all(axis=1) & (line[by_place[1:]] == line[by_place[:-1]])
    again = np.unique(line[by_place[1:]][same])
    again = again[closed[again]]
    corners, step = np.concatenate((grid[at, :2], grid[at + size - 1, 2:]), axis=1), part[:, 2:] - part[:, :2]
    angle = np.arctan2(step[:, 1], step[:, 0])
    angles = np.stack((angle[at], angle[at + size - 1]), axis=1)
    if len(again):  # rings that come to a corner again
        keep = np.ones(len(at), bool)
        keep[again] = False
        loops = [(k, loop) for k in again.tolist() for loop in simple_loops(list(range(at[k], at[k] + size[k])), dict(zip(range(at[k], at[k] + size[k]), map(tuple, grid[at[k] : at[k] + size[k], :2].tolist()), strict=True)))]
        of_loop = np.array([k for k, _ in loops])
        turned = [loop[i:] + loop[: i + 1] for _, loop in loops for i in [min(range(len(loop)), key=lambda j: tuple(part[loop[j], :2]))]]  # noqa: B023
        xy = np.concatenate((xy[np.repeat(keep, sizes)], part[np.concatenate(turned), :2]))
        number, own, sizes = np.concatenate((number[keep], [min(loop) for _, loop in loops])), np.concatenate((own[keep], own[of_loop])), np.concatenate((sizes[keep], [len(loop) for loop in turned]))
        closed, corners, angles = (np.concatenate((c[keep], c[of_loop])) for c in (closed, corners, angles))
    begin = np.cumsum(sizes) - sizes
    area = np.zeros(len(sizes))
    if len(sizes):
        moved = xy - np.repeat(xy[begin], sizes, axis=0)
        cross = np.concatenate((moved[:-1, 0] * moved[1:, 1] - moved[1:, 0] * moved[:-1, 1], [0.0]))
        cross[begin[1:] - 1] = 0.0
        area = np.add.reduceat(cross, begin) / 2
    return Joined(number, own, closed, pa.array(area, mask=~closed), 2 * sizes, xy, corners, angles)


def intersections(a: Segments, b: Segments, jobs: int) -> list[list[list[np.ndarray]]]:
    """What pairs of polygons have in common, as polygons."""
    job, part = common_parts(a, b, jobs)
    order = np.argsort(job, kind="stable")
    bounds = np.searchsorted(job[order], np.arange(jobs + 1))
    out = []
    for k in range(jobs):
        own = part[order[bounds[k] : bounds[k + 1]]]
        if not len(own):
            out.append([])
            continue
        origin = own[:, :2].min(axis=0)
        moved = own - np.tile(origin, 2)
        polygons = traced(moved, 1e3 * ON_LINE * max(np.abs(moved).max(), 1e-300))
        out.append([[r + origin for r in polygon] for polygon in polygons])
    return out


def valid(edges: Segments, jobs: int) -> list[list[list[np.ndarray]]]:
    """Polygons, each its outer ring and then its holes, that cover what the closed rings of each job cover by even and odd crossings, without crossing themselves.

    All edges of a job are cut where they meet; the parts that have the inside on one side only, turned to have it on the left, are traced.
    """
    if not len(edges.job):
        return [[] for _ in range(jobs)]
    low, high = extents(jobs, edges)
    low = np.where(np.isfinite(low), low, 0.0)
    own = Segments(edges.s - np.tile(low[edges.job], 2), edges.job, edges.ring)
    on = ON_LINE * np.where(np.isfinite(high), high - low, 0.0).max(axis=1)
    segment, _, _, part, _, _ = parts_of(own, own, jobs, on, own=True)
    job = own.job[segment]
    step, middle = part[:, 2:] - part[:, :2], (part[:, :2] + part[:, 2:]) / 2
    aside = 1e3 * on[job, None] * np.stack((-step[:, 1], step[:, 0]), axis=1) / np.hypot(step[:, 0], step[:, 1])[:, None]
    left, right = odd_crossings(middle + aside, job, own), odd_crossings(middle - aside, job, own)
    border = left != right
    part = np.where(left[:, None], part, part[:, [2, 3, 0, 1]])[border]
    bounds = np.searchsorted(job[border], np.arange(jobs + 1))  # parts are in the order of their jobs
    return [[[r + low[k] for r in polygon] for polygon in traced(part[bounds[k] : bounds[k + 1]], 1e3 * on[k])] for k in range(jobs)]


def valid_polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """valid, of the rings of one shape; they need not be closed."""
    closed = [np.concatenate((r, r[:1])) if len(r) and (r[0] != r[-1]).any() else r for r in rings if len(r) > 2]
    edges = np.concatenate([np.concatenate((r[:-1], r[1:]), axis=1) for r in closed]) if closed else np.zeros((0, 4))
    edges = edges[(edges[:, :2] != edges[:, 2:]).any(axis=1)]
    job = np.zeros(len(edges), np.int64)
    return valid(Segments(edges, job, job), 1)[0]
