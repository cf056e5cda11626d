"""Rings that cross or touch themselves as polygons that do not: split where they meet, kept where they turn around a place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rings
from ..storage import kept
from .vector import FEW_POINTS, crossing

_RINGS = "array<array<array<struct<x: double, y: double>>>>"


def _meetings(a: np.ndarray, b: np.ndarray) -> list[list[float]]:
    """For each edge from a to b the shares of its length at which others meet it, its ends included."""
    out: list[list[float]] = [[0.0, 1.0] for _ in a]
    way = b - a
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(low[:, 0], kind="stable")
    begins = low[order, 0]
    for k, i in enumerate(order.tolist()):
        near = order[k + 1 : np.searchsorted(begins, high[i, 0], "right")]
        near = near[(low[near, 1] <= high[i, 1]) & (high[near, 1] >= low[i, 1])]
        if not len(near):
            continue
        from_i = a[near] - a[i]
        cross = way[i, 0] * way[near, 1] - way[i, 1] * way[near, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (from_i[:, 0] * way[near, 1] - from_i[:, 1] * way[near, 0]) / cross
            u = (from_i[:, 0] * way[i, 1] - from_i[:, 1] * way[i, 0]) / cross
        e = 1e-12
        met = (cross != 0) & (t >= -e) & (t <= 1 + e) & (u >= -e) & (u <= 1 + e)
        for j, s, v in zip(near[met].tolist(), t[met].tolist(), u[met].tolist(), strict=True):
            out[i].append(min(1.0, max(0.0, s)))
            out[j].append(min(1.0, max(0.0, v)))
        for j in near[(cross == 0) & (from_i[:, 0] * way[i, 1] == from_i[:, 1] * way[i, 0])].tolist():  # along one line
            for x, y in ((i, j), (j, i)):
                size = way[x] @ way[x]
                out[x] += [float(s) for s in ((a[y] - a[x]) @ way[x] / size, (b[y] - a[x]) @ way[x] / size) if 0 < s < 1]
    return out


def _cycles(start: np.ndarray, end: np.ndarray, place: np.ndarray) -> list[list[int]]:
    """Closed walks along directed edges; where several go on, the one that stays with the face on the left."""
    angle = np.arctan2(place[end, 1] - place[start, 1], place[end, 0] - place[start, 0])
    out: dict[int, list[int]] = {}
    for e, s in enumerate(start.tolist()):
        out.setdefault(s, []).append(e)
    left, found = set(range(len(start))), []
    for first in range(len(start)):
        if first not in left:
            continue
        walk, e = [], first
        while e in left:
            left.discard(e)
            walk.append(int(start[e]))
            back = angle[e] + np.pi
            e = min((x for x in out[int(end[e])] if x in left or x == first), key=lambda x: (back - angle[x]) % (2 * np.pi) or 2 * np.pi, default=first)
            if e == first:
                break
        path: list[int] = []
        where: dict[int, int] = {}
        for name in walk:  # a walk that comes back to a place parts there: a hole may touch its outline
            if name in where:
                k = where[name]
                found.append(path[k:])
                for gone in path[k:]:
                    del where[gone]
                del path[k:]
            where[name] = len(path)
            path.append(name)
        found.append(path)
    return found


def _area(p: np.ndarray) -> float:
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def _holds(ring: np.ndarray, point: np.ndarray) -> bool:
    p, q = ring, np.roll(ring, -1, axis=0)
    spans = (p[:, 1] > point[1]) != (q[:, 1] > point[1])
    x = p[spans, 0] + (point[1] - p[spans, 1]) * (q[spans, 0] - p[spans, 0]) / (q[spans, 1] - p[spans, 1])
    return int((x > point[0]).sum()) % 2 == 1


def polygons_of(points: list[tuple[float, float]]) -> list[list[list[tuple[float, float]]]]:
    """The polygons of a ring, each its outline and then its holes, closed: all places that the ring turns around.

    Edges are split where they meet; of equal pieces only the turns that are left over count, so spikes and repeated points
    vanish. A piece belongs to an outline if the ring turns around one side of it and not around the other. Polygons
    come by their least corner; a ring without area gives none.
    """
    p = np.array(points, float).reshape(-1, 2)
    p = p[np.isfinite(p).all(axis=1)]
    p = p[np.concatenate([[True], (np.diff(p, axis=0) != 0).any(axis=1)])] if len(p) else p
    if len(p) < 4:
        return []
    a, b = p[:-1], p[1:]
    unit = max(1e-300, float(np.abs(p - p[0]).max())) * 1e-9
    names: dict[tuple[int, int], int] = {}
    places: list[np.ndarray] = []
    turns: dict[tuple[int, int], int] = {}
    for i, shares in enumerate(_meetings(a, b)):
        last = None
        for s in sorted(set(shares)):
            at = b[i] if s == 1 else a[i] + s * (b[i] - a[i])
            name = names.setdefault(tuple(np.round((at - p[0]) / unit).astype(np.int64).tolist()), len(places))
            if name == len(places):
                places.append(at)
            if last is not None and last != name:
                turns[min(last, name), max(last, name)] = turns.get((min(last, name), max(last, name)), 0) + (1 if last < name else -1)
            last = name
    place = np.array(places)
    edges = np.array([(s, e, n) for (s, e), n in turns.items() if n], np.int64).reshape(-1, 3)
    if not len(edges):
        return []
    # Turns around both sides of a piece, seen from its middle to the right; the axes are leant so that no piece lies level.
    lean = (place - p[0]) @ np.array([[1.0, 0.6180339887], [-0.4142135623, 1.0]])
    up = lean[edges[:, 0], 1] < lean[edges[:, 1], 1]
    start, end, n = np.where(up, edges[:, 0], edges[:, 1]), np.where(up, edges[:, 1], edges[:, 0]), np.where(up, edges[:, 2], -edges[:, 2])
    s, e = lean[start], lean[end]
    right = np.zeros(len(n), np.int64)
    for k, (x, y) in enumerate(((s + e) / 2).tolist()):
        spans = (s[:, 1] <= y) & (e[:, 1] > y)
        spans[k] = False
        across = s[spans, 0] + (y - s[spans, 1]) * (e[spans, 0] - s[spans, 0]) / (e[spans, 1] - s[spans, 1])
        right[k] = n[spans][across > x].sum()
    in_left, in_right = right + n != 0, right != 0
    side = in_left != in_right
    start, end = np.where(in_left, start, end)[side], np.where(in_left, end, start)[side]
    walks = [place[w] for w in _cycles(start, end, place)]
    sized = [(w, _area(w)) for w in walks if abs(_area(w)) > unit * unit]
    shells = sorted(((w, x) for w, x in sized if x > 0), key=lambda x: tuple(x[0][np.lexsort((x[0][:, 1], x[0][:, 0]))[0]]))
    out = [[w] for w, _ in shells]
    for hole, _ in (x for x in sized if x[1] < 0):
        middle = (hole[0] + hole[1]) / 2
        around = [k for k, (w, _) in enumerate(shells) if _holds(w, middle)]
        if around:
            out[min(around, key=lambda k: shells[k][1])].append(hole)
    return [[[tuple(c) for c in np.vstack([r, r[:1]]).tolist()] for r in polygon] for polygon in out]


#: Pieces of a ring's edges up to which it is repaired along with others of its batch; pairs of edges that are looked at in one go.
FEW_PIECES, PAIRS = 128, 1 << 18


def _each(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For owners of n elements each, from first on, all pairs of owner and element."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) + np.repeat(first - np.cumsum(n) + n, n)


def _pairs(first: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """_each() in runs of owners that have about PAIRS pairs."""
    ends, k = np.cumsum(n), 0
    while k < len(n):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
        owner, element = _each(first[k:to], n[k:to])
        yield owner + k, element
        k = to


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where rows in order differ from the one before."""
    out = np.ones(len(columns[0]), np.bool_)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _shares(a: np.ndarray, b: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_meetings() of the edges of many rings: edge and share, in order."""
    way, low, high, k = b - a, np.minimum(a, b), np.maximum(a, b), np.arange(len(a))
    edges, shares = [k, k], [np.zeros(len(a)), np.ones(len(a))]
    for i, j in _pairs(k + 1, np.searchsorted(own, own, "right") - k - 1):
        near = (low[i] <= high[j]).all(axis=1) & (low[j] <= high[i]).all(axis=1)
        i, j = i[near], j[near]
        later = low[j, 0] < low[i, 0]
        i, j = np.where(later, j, i), np.where(later, i, j)
        from_i = a[j] - a[i]
        cross = way[i, 0] * way[j, 1] - way[i, 1] * way[j, 0]
        t = (from_i[:, 0] * way[j, 1] - from_i[:, 1] * way[j, 0]) / cross
        u = (from_i[:, 0] * way[i, 1] - from_i[:, 1] * way[i, 0]) / cross
        e = 1e-12
        met = (cross != 0) & (t >= -e) & (t <= 1 + e) & (u >= -e) & (u <= 1 + e)
        edges += [i[met], j[met]]
        shares += [np.clip(t[met], 0.0, 1.0), np.clip(u[met], 0.0, 1.0)]
        line = (cross == 0) & (from_i[:, 0] * way[i, 1] == from_i[:, 1] * way[i, 0])
        for x, y in ((i[line], j[line]), (j[line], i[line])):
            for end in (a, b):
                s = ((end[y] - a[x]) * way[x]).sum(axis=1) / (way[x] ** 2).sum(axis=1)
                edges.append(x[(s > 0) & (s < 1)])
                shares.append(s[(s > 0) & (s < 1)])
    edge, share = np.concatenate(edges), np.concatenate(shares)
    order = np.lexsort((share, edge))
    edge, share = edge[order], share[order]
    once = _begins(edge, share)
    return edge[once], share[once]


def _follow(start: np.ndarray, end: np.ndarray, place: np.ndarray, ring: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The edge after each, as _cycles() chooses it; odd is set for rings of which an edge has no follower or two have the same."""
    angle = np.arctan2(place[end, 1] - place[start, 1], place[end, 0] - place[start, 0])
    order = np.argsort(start, kind="stable")
    low, high = (np.searchsorted(start[order], end, side) for side in ("left", "right"))
    out = np.arange(len(start))
    for e, x in _pairs(low, high - low):
        turn = (angle[e] + np.pi - angle[order[x]]) % (2 * np.pi)
        best = np.lexsort((x, np.where(turn == 0, 2 * np.pi, turn), e))
        best = best[_begins(e[best])]
        out[e[best]] = order[x[best]]
    odd[ring[(high == low) | (np.bincount(out, minlength=len(out))[out] > 1)]] = True
    return out


@np.errstate(all="ignore")
def _outlines(p: np.ndarray, ring: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """polygons_of() of n rings, given as points and the ring of each, for rings whose polygons have no holes and do not touch themselves.

    Returns the ring and the number of points of each polygon, the points, and for each ring whether it is none of these
    or has many points or pieces, and so has no polygons here.
    """
    odd, none = np.bincount(ring, minlength=n) > FEW_POINTS, np.zeros(0, np.int64)
    there = np.isfinite(p).all(axis=1) & ~odd[ring]
    p, ring = p[there], ring[there]
    once = _begins(ring, p[:, 0], p[:, 1])
    p, ring = p[once], ring[once]
    many = np.bincount(ring, minlength=n)[ring] > 3
    p, ring = p[many], ring[many]
    if not len(p):
        return none, none, p, odd
    origin = p[np.minimum(np.searchsorted(ring, np.arange(n)), len(p) - 1)]
    unit = np.full(n, 1e-300)
    np.maximum.at(unit, ring, np.abs(p - origin[ring]).max(axis=1))
    unit *= 1e-9
    at = np.flatnonzero(ring[1:] == ring[:-1])
    a, b, own = p[at], p[at + 1], ring[at]
    edge, share = _shares(a, b, own)
    met = np.where(share[:, None] == 1, b[edge], a[edge] + share[:, None] * (b[edge] - a[edge]))
    own = own[edge]
    x, y = np.round((met - origin[own]) / unit[own, None]).astype(np.int64).T
    order = np.lexsort((y, x, own))
    new = _begins(own[order], x[order], y[order])
    first = order[new]
    rank = np.argsort(first)
    name = np.empty(len(met), np.int64)
    name[order] = np.argsort(rank)[np.cumsum(new) - 1]
    place, owner = met[first[rank]], own[first[rank]]
    step = np.flatnonzero((edge[1:] == edge[:-1]) & (name[1:] != name[:-1]))
    low, high = np.minimum(name[step], name[step + 1]), np.maximum(name[step], name[step + 1])
    _, first, group = np.unique(low * len(place) + high, return_index=True, return_inverse=True)
    turns = np.bincount(group, np.where(name[step] < name[step + 1], 1, -1)).astype(np.int64)
    order = np.argsort(first)
    start, end, turns = low[first[order]], high[first[order]], turns[order]
    odd |= np.bincount(owner[start[turns != 0]], minlength=n) > FEW_PIECES
    left = (turns != 0) & ~odd[owner[start]]
    start, end, turns = start[left], end[left], turns[left]
    own, away = owner[start], place - origin[owner]
    lean_x, lean_y = away[:, 0] - 0.4142135623 * away[:, 1], 0.6180339887 * away[:, 0] + away[:, 1]
    up = lean_y[start] < lean_y[end]
    start, end, turns = np.where(up, start, end), np.where(up, end, start), np.where(up, turns, -turns)
    sx, sy, ex, ey = lean_x[start], lean_y[start], lean_x[end], lean_y[end]
    right = np.zeros(len(start), np.int64)
    low, high = np.searchsorted(own, own, "left"), np.searchsorted(own, own, "right")
    for i, j in _pairs(low, high - low):
        level = (sy[i] + ey[i]) / 2
        spans = (sy[j] <= level) & (ey[j] > level) & (i != j)
        i, j, level = i[spans], j[spans], level[spans]
        beyond = sx[j] + (level - sy[j]) * (ex[j] - sx[j]) / (ey[j] - sy[j]) > (sx[i] + ex[i]) / 2
        np.add.at(right, i[beyond], turns[j[beyond]])
    in_left, in_right = right + turns != 0, right != 0
    side = in_left != in_right
    start, end, own = np.where(in_left, start, end)[side], np.where(in_left, end, start)[side], own[side]
    follower = _follow(start, end, place, own, odd)
    # A walk is named by its first edge; its edges are put in order from there on.
    follower = np.where(odd[own], np.arange(len(own)), follower)
    walk, jump = np.arange(len(own)), follower
    for _ in range(FEW_PIECES.bit_length()):
        walk, jump = np.minimum(walk, walk[jump]), jump[jump]
    back, here, k = np.zeros(len(own), np.int64), np.flatnonzero(walk == np.arange(len(own))), 0
    while len(here):
        back[here], k = k, k + 1
        here = follower[here]
        here = here[walk[here] != here]
    order = np.lexsort((back, walk))
    order = order[~odd[own[order]]]
    walk, start, end, own = walk[order], start[order], end[order], own[order]
    seen = np.lexsort((start, walk))
    odd[own[seen[~_begins(walk[seen], start[seen])]]] = True
    begin = np.flatnonzero(_begins(walk)) if len(walk) else none
    if not len(begin):
        return none, none, p[:0], odd
    s, e = place[start], place[end]
    area = np.add.reduceat(s[:, 0] * e[:, 1] - e[:, 0] * s[:, 1], begin) / 2
    sized = np.abs(area) > unit[own[begin]] ** 2
    odd[own[begin[sized & (area < 0)]]] = True
    size = np.diff(np.append(begin, len(walk)))
    good = sized & ~odd[own[begin]]
    begin, size = begin[good], size[good]
    if not len(begin):
        return none, none, p[:0], odd
    shell, corner = _each(begin, size)
    order = np.lexsort((s[corner, 1], s[corner, 0], shell))
    least = s[corner[order[_begins(shell[order])]]]
    order = np.lexsort((least[:, 1], least[:, 0], own[begin]))
    begin, size = begin[order], size[order]
    shell, corner = _each(begin, size + 1)  # closed
    corner = np.where(corner == (begin + size)[shell], begin[shell], corner)
    return own[begin], size + 1, s[corner], odd


def polygons_of_each(p: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """polygons_of() of many rings, given as all points and the number of each ring's.

    Returns the number of each ring's polygons, of each polygon's rings, of each of those rings' points, and the points. Rings
    are repaired many at a time; those whose polygons have holes or touch themselves, or that have many points or pieces, one by one.
    """
    own, points, corners, odd = _outlines(p, np.repeat(np.arange(len(size)), size), len(size))
    rings_, first = np.ones(len(own), np.int64), np.cumsum(size) - size
    alone = [(k, polygon) for k in np.flatnonzero(odd).tolist() for polygon in polygons_of(p[first[k] : first[k] + size[k]].tolist())]
    if alone:
        own, rings_ = np.append(own, [k for k, _ in alone]), np.append(rings_, [len(polygon) for _, polygon in alone])
        points = np.append(points, [len(r) for _, polygon in alone for r in polygon])
        corners = np.vstack([corners, *(np.array(r) for _, polygon in alone for r in polygon)])
        order = np.argsort(own, kind="stable")
        _, ring = _each((np.cumsum(rings_) - rings_)[order], rings_[order])
        _, corner = _each((np.cumsum(points) - points)[ring], points[ring])
        own, rings_, points, corners = own[order], rings_[order], points[ring], corners[corner]
    return np.bincount(own, minlength=len(size)), rings_, points, corners


@np.errstate(all="ignore")
def faulty(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of many rings, given as polygons_of_each() takes them, cross or touch themselves: what rings.self_crossing() and touching() tell of one."""
    n, ring = len(size), np.repeat(np.arange(len(size)), size)
    out = np.zeros(n, np.bool_)
    at = np.flatnonzero((ring[1:] == ring[:-1]) & (size[ring[1:]] > 4))
    a, b, own, k = p[at], p[at + 1], ring[at], np.arange(len(at))
    turn = lambda u, v, w: np.sign((v[:, 0] - u[:, 0]) * (w[:, 1] - u[:, 1]) - (v[:, 1] - u[:, 1]) * (w[:, 0] - u[:, 0]))
    for i, j in _pairs(k + 1, np.searchsorted(own, own, "right") - k - 1):
        met = (turn(a[i], b[i], a[j]) * turn(a[i], b[i], b[j]) < 0) & (turn(a[j], b[j], a[i]) * turn(a[j], b[j], b[i]) < 0)
        out[own[i[met]]] = True
    columns = [ring, *np.nan_to_num(p, posinf=np.inf, neginf=-np.inf).T, *np.isnan(p).T]
    columns = [c[_begins(*columns)] for c in columns]
    order = np.lexsort(columns[::-1])
    distinct = columns[0][order[_begins(*(c[order] for c in columns))]]
    once = np.bincount(columns[0], minlength=n)
    return out | (once > 1) & (np.bincount(distinct, minlength=n) < once - 1)


def _polygons(ring: Column, all_: bool) -> Column:
    """The polygons of rings, or null for those that neither cross nor touch themselves, if not all_ are to be repaired."""

    @F.arrow_udf(_RINGS)
    def mend(column: pa.Array) -> pa.Array:
        x, y = (c.to_numpy(zero_copy_only=False) for c in column.flatten().flatten())
        p, size = np.column_stack([x, y]).astype(float), column.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        bad = np.ones(len(size), np.bool_) if all_ else faulty(p, size)
        polygons, rings_, points, corners = polygons_of_each(p[np.repeat(bad, size)], np.where(bad, size, 0))
        out = pa.StructArray.from_arrays([pa.array(corners[:, 0]), pa.array(corners[:, 1])], ["x", "y"])
        for n, none in ((points, None), (rings_, None), (polygons, pa.array(~bad | column.is_null().to_numpy(zero_copy_only=False)))):
            out = pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), out, mask=none)
        return out

    return mend(ring)


def touching(ring: Column) -> Column:
    """Whether a ring comes back to a corner: spikes and rings that touch themselves; points repeated in a row do not count."""
    once = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    return (F.size(once) > 1) & (F.size(F.array_distinct(once)) < F.size(once) - 1)


def invalid(parts_: DataFrame, *keys: str) -> DataFrame:
    """keys of the rings that cross or touch themselves."""
    return crossing(parts_, *keys).unionByName(parts_.where(touching(F.col("ring"))).select(*keys)).distinct()


def repaired(parts_: DataFrame, *keys: str) -> DataFrame:
    """All columns of parts_, piece (from 0) and rings (an outline and its holes) in place of ring, which keys name.

    Rings that cross or touch themselves become the polygons of what they turn around, none if they have no area; the others
    stay as they are. Rings of few points are judged and repaired many at a time in one pass of their rows; longer ones meet what
    crossing() finds by their keys. What the pass makes is kept, so that whatever reads it again, as dealing by ranges
    does, repairs nothing a second time.
    """
    rest, whole = [c for c in parts_.columns if c != "ring"], F.array(F.array("ring"))
    rows = parts_.withColumn("_long", F.coalesce(F.size("ring") > FEW_POINTS, F.lit(False)))
    once = kept(rows.select(*rest, "_long", F.posexplode(F.coalesce(_polygons(F.when(~F.col("_long"), F.col("ring")), all_=False), whole)).alias("piece", "rings")))
    few, many = once.where("not _long").drop("_long"), once.where("_long").select(*rest, F.get("rings", F.lit(0)).alias("ring"))
    if many.isEmpty():
        return few
    bad = invalid(many, *keys)
    good = many.join(bad, list(keys), "left_anti").select(*rest, F.lit(0).alias("piece"), F.array("ring").alias("rings"))
    mended = many.join(bad, list(keys), "left_semi").select(*rest, F.posexplode(_polygons(F.col("ring"), all_=True)).alias("piece", "rings"))
    return few.unionByName(good).unionByName(mended)


def area(polygon: Column) -> Column:
    """The area of an outline without its holes."""
    holes = F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0)))
    return rings.area(F.get(polygon, F.lit(0))) - F.aggregate(holes, F.lit(0.0), lambda s, hole: s + rings.area(hole))
