"""The slow double of the outline operators: rings, chains and predicates one by one, in plain Python."""

from __future__ import annotations

from collections import defaultdict

Point = tuple[int, int]
FALLBACKS = (1.0, 0.5, 0.25, 0.125, 0.0)


class OutlineError(ValueError):
    """A region has no outer ring, or more than one."""


def trace_rings(edges: list[tuple[Point, Point]]) -> list[list[Point]]:
    """Closed rings from directed unit edges: from the least edge on, right turns first; a ring ends on reaching its start."""
    out: dict[Point, list[Point]] = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    rings = []
    for a, b in sorted(edges):
        if b not in out[a]:
            continue
        out[a].remove(b)
        ring, before, at = [a], a, b
        while at != a:
            ring.append(at)
            dx, dy = at[0] - before[0], at[1] - before[1]
            for turn in ((-dy, dx), (dx, dy), (dy, -dx), (-dx, -dy)):  # right, straight, left, back
                then = (at[0] + turn[0], at[1] + turn[1])
                if then in out[at]:
                    break
            else:
                raise OutlineError("a boundary does not close")
            out[at].remove(then)
            before, at = at, then
        rings.append(ring)
    return rings


def twice_area(ring: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], *ring[:1]]))


def classify_rings(rings: list[list[Point]]) -> tuple[list[Point], list[list[Point]]]:
    """The outer ring and the holes, by signed area."""
    areas = [twice_area(r) for r in rings]
    outer = [r for r, a in zip(rings, areas) if a > 0]
    if len(outer) != 1 or 0 in areas:
        raise OutlineError("a region needs exactly one outer ring and no empty one")
    return outer[0], sorted((r for r, a in zip(rings, areas) if a < 0), key=lambda r: (min(r), r))


def drop_straight(ring: list[Point]) -> list[Point]:
    """Without the points between two edges of one direction."""
    n = len(ring)
    return [p for i, p in enumerate(ring) if (p[0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - p[1]) != (p[1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - p[0])]


def _distance2(p: Point, a: Point, b: Point) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    t = 0.0 if not length else max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / length))
    return (p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2


def simplify_chain(points: list[Point], tolerance: float) -> list[Point]:
    """Douglas-Peucker with a stack; the first farthest point splits a part if it is farther than the tolerance."""
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        a, b = stack.pop()
        best, at = tolerance * tolerance, -1
        for i in range(a + 1, b):
            if (d := _distance2(points[i], points[a], points[b])) > best:
                best, at = d, i
        if at >= 0:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def simplify_ring(ring: list[Point], tolerance: float) -> list[Point]:
    """A closed ring as two chains between its first point and the farthest one; three points at least stay."""
    if len(ring) <= 3 or tolerance <= 0:
        return ring
    far = max(range(1, len(ring)), key=lambda i: ((ring[i][0] - ring[0][0]) ** 2 + (ring[i][1] - ring[0][1]) ** 2, -i))
    out = simplify_chain(ring[: far + 1], tolerance)[:-1] + simplify_chain([*ring[far:], ring[0]], tolerance)[:-1]
    if len(out) < 3 or not twice_area(out):
        third = max((i for i in range(len(ring)) if i not in (0, far)), key=lambda i: (_distance2(ring[i], ring[0], ring[far]), -i))
        out = [ring[i] for i in sorted({0, far, third})]
    return out


def boundary_chains(ring: list[Point], others: list[int | None]) -> list[list[Point]]:
    """A ring cut where the region beyond changes; ``others[i]`` lies beyond the edge from point i. One chain if it never does."""
    n = len(ring)
    cuts = [i for i in range(n) if others[i] != others[i - 1]]
    if not cuts:
        return [ring]
    return [[ring[k % n] for k in range(a, b + 1)] for a, b in zip(cuts, [*cuts[1:], cuts[0] + n])]


def canonical_chain(chain: list[Point]) -> list[Point]:
    """The lesser of a chain and its reverse, so that both sides of a border get one form."""
    return min(chain, chain[::-1])


def canonical_ring(ring: list[Point]) -> list[Point]:
    """A ring from its least point on, in the lesser direction."""
    at = ring.index(min(ring))
    forward = ring[at:] + ring[:at]
    return min(forward, [forward[0], *forward[:0:-1]])


def _orient(a: Point, b: Point, c: Point) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def on_segment(p: Point, a: Point, b: Point) -> bool:
    return _orient(a, b, p) == 0 and min(a[0], b[0]) <= p[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= p[1] <= max(a[1], b[1])


def crosses(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two segments cross inside both."""
    return _orient(a, b, c) * _orient(a, b, d) < 0 and _orient(c, d, a) * _orient(c, d, b) < 0


def ring_is_valid(ring: list[Point]) -> bool:
    """Three distinct points, an area, and no edges that cross, overlap or touch except at one shared corner."""
    n = len(ring)
    if len(set(ring)) < 3 or not twice_area(ring):
        return False
    edges = [(ring[i], ring[(i + 1) % n]) for i in range(n)]
    order = sorted(range(n), key=lambda i: min(edges[i][0][0], edges[i][1][0]))
    active: list[int] = []
    for i in order:  # a sweep over x
        a, b = edges[i]
        active = [j for j in active if max(edges[j][0][0], edges[j][1][0]) >= min(a[0], b[0])]
        for j in active:
            c, d = edges[j]
            if max(c[1], d[1]) < min(a[1], b[1]) or min(c[1], d[1]) > max(a[1], b[1]):
                continue
            if crosses(a, b, c, d):
                return False
            shared = {a, b} & {c, d}
            if len(shared) == 2 or any(on_segment(p, c, d) for p in {a, b} - shared) or any(on_segment(p, a, b) for p in {c, d} - shared):
                return False
        active.append(i)
    return True


def point_inside(p: tuple[float, float], rings: list[list[Point]]) -> bool:
    """Strictly inside by the even-odd rule over outer ring and holes; points on an edge are not."""
    inside = False
    for ring in rings:
        for a, b in zip(ring, [*ring[1:], *ring[:1]]):
            if on_segment(p, a, b):
                return False
            if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
                inside = not inside
    return inside


def areas_overlap(a: list[list[Point]], b: list[list[Point]]) -> bool:
    """Whether two outlines (outer ring, then holes) share area: a proper crossing, or a sample of one inside the other."""
    segments = [[(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))] for rings in (a, b)]
    for p, q in segments[0]:
        for r, s in segments[1]:
            if max(p[0], q[0]) >= min(r[0], s[0]) and max(r[0], s[0]) >= min(p[0], q[0]) and crosses(p, q, r, s):
                return True
    for own, other in ((0, b), (1, a)):
        for p, q in segments[own]:
            if point_inside(p, other) or point_inside(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), other):
                return True
    return {frozenset(s) for s in segments[0]} == {frozenset(s) for s in segments[1]}


def _box(ring: list[Point]) -> tuple[int, int, int, int]:
    return min(p[0] for p in ring), min(p[1] for p in ring), max(p[0] for p in ring), max(p[1] for p in ring)


def invalid_regions(outlines: dict[int, list[list[Point]]], cell: int = 16) -> set[int]:
    """Regions with an invalid ring or with area in common with another; pairs are met through grid cells of their boxes."""
    bad = {r for r, rings in outlines.items() if not all(map(ring_is_valid, rings))}
    cells: dict[Point, list[int]] = defaultdict(list)
    boxes = {r: _box(rings[0]) for r, rings in outlines.items()}
    for r, (x0, y0, x1, y1) in boxes.items():
        for cx in range(int(x0) // cell, int(x1) // cell + 1):
            for cy in range(int(y0) // cell, int(y1) // cell + 1):
                cells[cx, cy].append(r)
    pairs = {(a, b) for found in cells.values() for i, a in enumerate(sorted(found)) for b in sorted(found)[i + 1 :]}
    for a, b in pairs:
        (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = boxes[a], boxes[b]
        if ax0 < bx1 and bx0 < ax1 and ay0 < by1 and by0 < ay1 and areas_overlap(outlines[a], outlines[b]):
            bad |= {a, b}
    return bad


def simplify_together(rings: dict[int, list[tuple[list[Point], list[int | None]]]], tolerance: float) -> dict[int, list[list[Point]]]:
    """Outlines of one image, simplified chain by chain so that neighbours keep one border.

    Chains of regions that come out invalid step down in tolerance until all is valid.
    """
    chains = {r: [boundary_chains(ring, others) for ring, others in found] for r, found in rings.items()}
    whole = {r: [len(parts) == 1 and parts[0] is ring for parts, (ring, _) in zip(chains[r], found)] for r, found in rings.items()}
    key = lambda part, closed: tuple(canonical_ring(part) if closed else canonical_chain(part))
    level: dict[tuple, int] = {key(p, c): 0 for r in chains for parts, c in zip(chains[r], whole[r]) for p in parts}
    users: dict[tuple, set[int]] = defaultdict(set)
    for r in chains:
        for parts, closed in zip(chains[r], whole[r]):
            for p in parts:
                users[key(p, closed)].add(r)
    while True:
        done: dict[tuple, list[Point]] = {}
        out: dict[int, list[list[Point]]] = {}
        for r in chains:
            out[r] = []
            for parts, closed in zip(chains[r], whole[r]):
                ring: list[Point] = []
                for p in parts:
                    k = key(p, closed)
                    if k not in done:
                        t = tolerance * FALLBACKS[level[k]]
                        done[k] = simplify_ring(list(k), t) if closed else (simplify_chain(list(k), t) if t > 0 else list(k))
                    short = done[k]
                    if closed:
                        ring = short if (twice_area(short) > 0) == (twice_area(p) > 0) else short[::-1]
                    else:
                        ring += (short if list(k) == p else short[::-1])[:-1]
                out[r].append(ring)
        bad = invalid_regions(out)
        lower = [k for k, regions in users.items() if regions & bad and level[k] < len(FALLBACKS) - 1]
        if not lower:
            return out
        for k in lower:
            level[k] += 1
