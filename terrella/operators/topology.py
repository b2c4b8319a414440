"""Arrangements of pairs of geometries: the nodes where two meet, the edges between nodes, and on which side of each edge they lie.

Many pairs are arranged at once, told apart by a group number, so that small ones share the cost of array operations.
Segments that can meet are found by a grid whose cells shrink until few segments share one. Meetings within a tolerance are
one node. Around a node, edges in angular order say whether an edge lies inside the other polygon; along edges that touch it
nowhere, this carries on; only a component without any contact needs a ray. So all work but sorting is in proportion to the
segments, the cells they cross and the meetings.
"""

from __future__ import annotations

import numpy as np

#: Below so many pairs of segments all are tried; above, the grid; entries of segments in cells at most.
FEW, MOST_ENTRIES = 1 << 15, 8_000_000
#: Relative tolerances: of a point on a segment, and of points that are one node.
ON, ONE = 1e-12, 1e-9


def _in_cells(s: np.ndarray, size: float, low: np.ndarray, pad: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells that each segment may touch, and the segment: a segment is cut to pieces no longer than a cell, a piece touches four at most."""
    d = s[:, 2:] - s[:, :2]
    n = np.maximum(np.ceil(np.abs(d).max(1) / size), 1).astype(np.int64)
    which = np.repeat(np.arange(len(s)), n)
    k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    p = s[which, :2] + d[which] * (k / n[which])[:, None]
    q = s[which, :2] + d[which] * ((k + 1) / n[which])[:, None]
    a = np.floor((np.minimum(p, q) - pad - low) / size).astype(np.int64)
    b = np.floor((np.maximum(p, q) + pad - low) / size).astype(np.int64)
    cells, ids = [], []
    for dx in (0, 1):
        for dy in (0, 1):
            ok = (a[:, 0] + dx <= b[:, 0]) & (a[:, 1] + dy <= b[:, 1])
            cells.append((a[ok, 0] + dx) << 32 | (a[ok, 1] + dy))
            ids.append(which[ok])
    return np.concatenate(cells), np.concatenate(ids)


def meeting_pairs(s: np.ndarray, t: np.ndarray, pad: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a segment of s and one of t that may meet, each pair once."""
    if not len(s) or not len(t):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(s) * len(t) <= FEW:
        i, j = (x.ravel() for x in np.indices((len(s), len(t))))
    else:
        both = np.concatenate([s, t])
        low = both.reshape(-1, 2).min(0) - pad
        span = float((both.reshape(-1, 2).max(0) - low).max())
        size = max(float(np.abs(both[:, 2:] - both[:, :2]).max(1).mean()), span * 1e-6, 8 * pad)
        before = np.inf
        while True:
            (cs, i), (ct, j) = _in_cells(s, size, low, pad), _in_cells(t, size, low, pad)
            order = np.argsort(ct, kind="stable")
            ct, j = ct[order], j[order]
            first, last = np.searchsorted(ct, cs, "left"), np.searchsorted(ct, cs, "right")
            count = int((last - first).sum())
            entries = len(cs) + len(ct)
            if count <= 4 * entries or entries * 4 > MOST_ENTRIES or count > 0.7 * before:
                break
            before, size = count, size / 3
        n = last - first
        i = np.repeat(i, n)
        j = j[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(count)]
        key = np.sort(i * len(t) + j)
        i, j = np.divmod(key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key, len(t))
    a, b = s[i], t[j]
    near = np.ones(len(i), bool)
    for k in (0, 1):
        near &= (np.minimum(a[:, k], a[:, k + 2]) <= np.maximum(b[:, k], b[:, k + 2]) + pad) & (np.minimum(b[:, k], b[:, k + 2]) <= np.maximum(a[:, k], a[:, k + 2]) + pad)
    return i[near], j[near]


def pairs_by_group(s: np.ndarray, t: np.ndarray, pad: np.ndarray, gs: np.ndarray, gt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``meeting_pairs`` within groups, of segments ordered by group; ``pad`` by group."""
    ns, nt = np.bincount(gs, minlength=len(pad)), np.bincount(gt, minlength=len(pad))
    fs, ft = np.cumsum(ns) - ns, np.cumsum(nt) - nt
    few = ns * nt <= FEW
    i = np.flatnonzero(few[gs] & (nt[gs] > 0)) if len(s) else np.zeros(0, np.int64)
    n = nt[gs[i]]
    a = np.repeat(i, n)
    b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ft[gs[i]], n)
    near = np.ones(len(a), bool)
    for k in (0, 1):
        near &= (np.minimum(s[a, k], s[a, k + 2]) <= np.maximum(t[b, k], t[b, k + 2]) + pad[gs[a]]) & (np.minimum(t[b, k], t[b, k + 2]) <= np.maximum(s[a, k], s[a, k + 2]) + pad[gs[a]])
    found = [(a[near], b[near])]
    for g in np.flatnonzero(~few).tolist():
        x, y = meeting_pairs(s[fs[g] : fs[g] + ns[g]], t[ft[g] : ft[g] + nt[g]], float(pad[g]))
        found.append((x + fs[g], y + ft[g]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]


def meetings(s: np.ndarray, t: np.ndarray, eps: float | np.ndarray, gs: np.ndarray | None = None, gt: np.ndarray | None = None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Where segments meet: for s and for t, the segment, the place along it and the point's number; and the new points.

    Points are numbered: ends of s, ends of t (a segment's start and end in turn), then crossings. ``gs``, ``gt``: groups of the
    segments, which are ordered by them and meet within one alone; ``eps`` is then by group.
    """
    i, j = meeting_pairs(s, t, eps) if gs is None else pairs_by_group(s, t, eps, gs, gt)
    eps = eps if gs is None else eps[gs[i]]
    p, d, u, e = s[i, :2], s[i, 2:] - s[i, :2], t[j, :2], t[j, 2:] - t[j, :2]
    out: tuple[list, list] = ([], [])
    ended = np.zeros(len(i), bool)
    for side, (base, along, seg, other, shift) in enumerate(((p, d, i, (u, u + e, j), 2 * len(s)), (u, e, j, (p, p + d, i), 0))):
        length = np.maximum((along**2).sum(1), 1e-300)
        for end in (0, 1):
            at = (other[end] - base) if end == 0 else (t[j, 2:] if side == 0 else s[i, 2:]) - base
            place = np.clip((at * along).sum(1) / length, 0, 1)
            on = ((at - place[:, None] * along) ** 2).sum(1) <= eps * eps
            ended |= on
            out[side].append((seg[on], place[on], shift + 2 * other[2][on] + end))
    span = _cross(d, e)
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y = _cross(u - p, e) / span, _cross(u - p, d) / span
    hit = ~ended & (span != 0) & (x > 0) & (x < 1) & (y > 0) & (y < 1)
    number = 2 * (len(s) + len(t)) + np.arange(int(hit.sum()))
    out[0].append((i[hit], x[hit], number))
    out[1].append((j[hit], y[hit], number))
    return *(tuple(map(np.concatenate, zip(*o))) for o in out), p[hit] + d[hit] * x[hit, None]


def numbered(points: np.ndarray, tol: float | np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Of each point the first of those that are the same within a tolerance: any two within half of it share one of four grids' cells."""
    label = np.arange(len(points))
    if not len(points):
        return label
    for _ in range(2):
        for shift in ((0.0, 0.0), (0.5, 0.5), (0.5, 0.0), (0.0, 0.5)):
            cell = np.floor(points / tol + shift).astype(np.int64)
            if group is not None:
                cell = np.column_stack([cell, group])
            order = np.lexsort(cell.T)
            new = np.ones(len(order), bool)
            new[1:] = (cell[order[1:]] != cell[order[:-1]]).any(1)
            least = np.minimum.reduceat(label[order], np.flatnonzero(new))
            label[order] = least[np.cumsum(new) - 1]
    return label


def components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least node reachable from each node."""
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]
    return label


def winding_inside(points: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether each point lies inside directed closed edges, by crossings of a ray; in blocks, so that memory is bounded."""
    out = np.zeros(len(points), bool)
    block = max(1, 2_000_000 // max(len(s), 1))
    x0, y0, x1, y1 = s.T
    for k in range(0, len(points), block):
        x, y = points[k : k + block, 0, None], points[k : k + block, 1, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
        out[k : k + block] = hit.sum(1) % 2 == 1
    return out


def winding_by_group(points: np.ndarray, s: np.ndarray, g: np.ndarray, gs: np.ndarray, groups: int) -> np.ndarray:
    """``winding_inside`` of points with the segments of their own groups, which are ordered by group."""
    n = np.bincount(gs, minlength=groups)
    first, out = np.cumsum(n) - n, np.zeros(len(points), bool)
    ends = np.cumsum(n[g])
    for a in range(0, len(points)):
        if n[g[a]] > FEW:
            out[a] = winding_inside(points[a : a + 1], s[first[g[a]] : first[g[a]] + n[g[a]]])[0]
    rest = np.flatnonzero(n[g] <= FEW)
    for block in np.split(rest, np.flatnonzero(np.diff(ends[rest] // 2_000_000)) + 1):
        k = n[g[block]]
        at = np.repeat(np.arange(len(block)), k)
        x0, y0, x1, y1 = s[np.repeat(first[g[block]], k) + np.arange(len(at)) - np.repeat(np.cumsum(k) - k, k)].T
        x, y = points[block][at].T
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
        out[block] = np.bincount(at[hit], minlength=len(block)) % 2 == 1
    return out


class Arrangement:
    """Two sets of segments, areas (directed, interior to the left) or lines; in groups, each a pair of its own.

    ``xy``: nodes; ``u``, ``v``: an edge's nodes, the lower first; ``on``: by source, whether an edge is one of its segments;
    ``left``, ``right``: by source, whether an area lies on that side of u to v; ``ends``: by source, how many segments end at a node;
    ``group``: of every edge. Segments are ordered by group; ``scale``, the size of coordinates, is by group.
    """

    def __init__(self, s: np.ndarray, t: np.ndarray, areal: tuple[bool, bool], scale: np.ndarray, gs: np.ndarray, gt: np.ndarray):
        self.groups = len(scale)
        (si, sx, sp), (ti, tx, tp), new = meetings(s, t, ON * scale, gs, gt)
        both = np.concatenate([s, t])
        points = np.concatenate([both.reshape(-1, 2), new])
        n, m = len(s), len(both)
        group = np.concatenate([np.repeat(np.concatenate([gs, gt]), 2), gs[si[sp >= 2 * m]]])
        tol = (ONE * scale)[group][:, None]
        seg = np.concatenate([si, ti + n, np.arange(m), np.arange(m)])
        at = np.concatenate([sx, tx, np.zeros(m), np.ones(m)])
        point = np.concatenate([sp, tp, 2 * np.arange(m), 2 * np.arange(m) + 1])
        node = numbered(points, tol, group)
        used, node = np.unique(node, return_inverse=True)
        self.node_group = group[used]
        self.xy = points[used]
        k = len(used)
        self.ends = [np.bincount(node[a:b], minlength=k) for a, b in ((0, 2 * n), (2 * n, 2 * m))]
        order = np.lexsort((at, seg))
        seg, stop = seg[order], node[point[order]]
        step = (seg[1:] == seg[:-1]) & (stop[1:] != stop[:-1])
        a, b, source = stop[:-1][step], stop[1:][step], (seg[1:][step] >= n).astype(np.int64)
        key, edge = np.unique(np.minimum(a, b) * k + np.maximum(a, b), return_inverse=True)
        self.u, self.v = np.divmod(key, max(k, 1))
        self.group = self.node_group[self.u]
        way = np.where(a < b, 1, -1)
        self.on = [np.bincount(edge[source == i], minlength=len(key)) > 0 for i in (0, 1)]
        self.left, self.right = [None, None], [None, None]
        for i, (own, mine, is_area) in enumerate(zip((s, t), (gs, gt), areal)):
            if is_area:
                net = np.bincount(edge[source == i], way[source == i], minlength=len(key)).astype(np.int64)
                self.left[i], self.right[i] = self._sides(net, own, mine)
            else:
                self.left[i] = self.right[i] = np.zeros(len(key), bool)

    def _half_edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Half-edges counter-clockwise around their origins, and where each origin's begin: 2e leaves u, 2e + 1 leaves v."""
        if not hasattr(self, "_around"):
            d = self.xy[self.v] - self.xy[self.u]
            origin = np.stack([self.u, self.v], 1).ravel()
            angle = np.stack([np.arctan2(d[:, 1], d[:, 0]), np.arctan2(-d[:, 1], -d[:, 0])], 1).ravel()
            order = np.lexsort((angle, origin))
            self._around = origin, order, np.flatnonzero(np.concatenate([[True], origin[order[1:]] != origin[order[:-1]]])) if len(order) else np.zeros(0, np.int64)
        return self._around

    def _sides(self, net: np.ndarray, own: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the area lies left and right of every edge: ``net`` has the direction of its boundary, 0 where an edge is none."""
        edge = net != 0
        left, right = net > 0, net < 0
        rest = np.flatnonzero(~edge)
        if not len(rest):
            return left, right
        origin, order, starts = self._half_edges()
        # the sector behind a half-edge is that to its left
        sector = np.stack([left, right], 1).ravel()[order]
        marks = np.where(np.repeat(edge, 2)[order], np.arange(len(order)), -1)
        group = np.cumsum(np.bincount(starts, minlength=len(order))) - 1
        last = np.maximum.accumulate(marks)
        final = np.maximum.reduceat(marks, starts)[group]
        last = np.where(last >= starts[group], last, final)
        known = np.full(len(order), -1, np.int8)
        known[order] = np.where(last >= 0, sector[last], -1)
        inside = known.reshape(-1, 2).max(1)  # -1 where neither end touches the boundary
        touched = np.zeros(len(self.xy), bool)
        touched[self.u[edge]] = touched[self.v[edge]] = True
        u, v = self.u[rest], self.v[rest]
        free = ~touched[u] & ~touched[v]
        label = components(len(self.xy), u[free], v[free])
        state = np.full(len(self.xy), -1, np.int8)
        for a, b in ((u, v), (v, u)):
            half = ~touched[a] & touched[b]
            state[label[a[half]]] = inside[rest[half]]
        lone = np.unique(label[np.concatenate([u[~touched[u]], v[~touched[v]]])])
        lone = lone[state[lone] < 0]
        state[lone] = winding_by_group(self.xy[lone], own, self.node_group[lone], mine, self.groups)
        mine = np.where(~touched[u], state[label[u]], np.where(~touched[v], state[label[v]], inside[rest]))
        left[rest] = right[rest] = mine > 0
        return left, right

    def area(self, op) -> np.ndarray:
        """Directed edges (nodes from, to) around the area that ``op`` makes of the two, interior to the left."""
        a, b = op(self.left[0], self.left[1]), op(self.right[0], self.right[1])
        ahead, back = a & ~b, b & ~a
        return np.concatenate([np.stack([self.u[ahead], self.v[ahead]], 1), np.stack([self.v[back], self.u[back]], 1)])

    def member(self, i: int) -> np.ndarray:
        """Whether an edge belongs to a source: as a segment, on its boundary or inside it."""
        return self.on[i] | self.left[i] | self.right[i]

    def lines(self, op) -> np.ndarray:
        """Edges (nodes) that ``op`` makes of the two and that no area of its result covers."""
        covered = op(self.left[0], self.left[1]) | op(self.right[0], self.right[1])
        keep = op(self.member(0), self.member(1)) & ~covered
        return np.stack([self.u[keep], self.v[keep]], 1)

    def common_nodes(self) -> np.ndarray:
        """Nodes that belong to both sources."""
        at = []
        for i in (0, 1):
            m = np.zeros(len(self.xy), bool)
            e = self.member(i)
            m[self.u[e]] = m[self.v[e]] = True
            at.append(m)
        return np.flatnonzero(at[0] & at[1])


def rings(xy: np.ndarray, edges: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Closed rings of directed edges, and a node of each; where several edges go on, the leftmost, so areas that touch at a point stay apart."""
    if not len(edges):
        return [], []
    a, b = edges.T
    n = len(edges)
    d, back = xy[b] - xy[a], xy[a] - xy[b]
    # at a node, clockwise: edges that arrive (by the way back) and edges that leave
    node = np.concatenate([b, a])
    angle = np.concatenate([np.arctan2(back[:, 1], back[:, 0]), np.arctan2(d[:, 1], d[:, 0])])
    order = np.lexsort((np.arange(2 * n) < n, -angle, node))  # the way straight back comes last
    starts = np.flatnonzero(np.concatenate([[True], node[order[1:]] != node[order[:-1]]]))
    group = np.cumsum(np.bincount(starts, minlength=2 * n)) - 1
    leaves = np.where(order >= n, np.arange(2 * n), 4 * n)
    ahead = np.minimum.accumulate(leaves[::-1])[::-1]
    end = np.append(starts[1:], 2 * n)[group]
    ahead = np.where(ahead < end, ahead, np.minimum.reduceat(leaves, starts)[group])
    onward = np.full(n, -1)
    arrives = order < n
    there = arrives & (ahead < 4 * n)
    onward[order[there]] = order[ahead[there]] - n
    onward, out, heads, seen = onward.tolist(), [], [], [False] * n
    for first in range(n):
        path, e = [], first
        while e >= 0 and not seen[e]:
            seen[e] = True
            path.append(e)
            e = onward[e]
        if e == first and len(path) > 2:
            r = xy[a[path]]
            out.append(np.concatenate([r, r[:1]]))
            heads.append(int(a[first]))
    return out, heads


def paths(xy: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Lines through edges, from node to node where other than two meet."""
    if not len(edges):
        return []
    near: dict[int, list[tuple[int, int]]] = {}
    for i, (a, b) in enumerate(edges.tolist()):
        near.setdefault(a, []).append((i, b))
        near.setdefault(b, []).append((i, a))
    used, out = [False] * len(edges), []
    for start in [x for x in near if len(near[x]) != 2] + list(near):
        for i, b in near[start]:
            if used[i]:
                continue
            path, at = [start], b
            used[i] = True
            path.append(at)
            while len(near[at]) == 2 and at != start:
                go = [(k, x) for k, x in near[at] if not used[k]]
                if not go:
                    break
                used[go[0][0]] = True
                at = go[0][1]
                path.append(at)
            out.append(xy[path])
    return out
