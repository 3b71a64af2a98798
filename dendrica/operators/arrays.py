"""One neuron as arrays: what a task does on a whole forest, of a size that a neuron has, without joins or scratch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

K = "neuron_id"
#: Distances or candidates held at once.
CHUNK = 1 << 21
#: What no id is.
NONE = -(1 << 63)


def dealt(df: DataFrame) -> DataFrame:
    """df by neuron, in one partition more than shuffles have: small tables may need much work, and the planner drops
    a repartition equal to an exchange below it, whose small partitions it then merges."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) + 1, K)


def each(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(key, table) of each neuron."""
    return dealt(df).groupBy(K).applyInArrow(run, schema)


def both(left: DataFrame, right: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(key, left table, right table) of each neuron of either side."""
    a, b = (dealt(df.toDF(*df.columns)) for df in (left, right))
    return a.groupBy(K).cogroup(b.groupBy(K)).applyInArrow(run, schema)


def table(key: tuple[pa.Scalar, ...], cols: dict) -> pa.Table:
    n, k = len(next(iter(cols.values()))), key[0].as_py()
    own = pa.nulls(n, pa.int64()) if k is None else pa.array(np.full(n, k, np.int64))
    return pa.table({K: own} | {c: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for c, v in cols.items()})


def whole(t: pa.Table, name: str) -> np.ndarray:
    c = t.column(name)
    return (c.fill_null(NONE) if c.null_count else c).to_numpy().astype(np.int64)


def real(t: pa.Table, *names: str) -> np.ndarray:
    """Columns side by side; null is NaN."""
    return np.stack([t.column(c).to_numpy().astype(float) for c in names], 1) if t.num_rows else np.zeros((0, len(names)))


class Forest:
    """Nodes by id. up: place of the parent, -1 where none is present; root: the parent is -1; table: the rows in this order."""

    def __init__(self, key: tuple[pa.Scalar, ...], t: pa.Table):
        ids = whole(t, "id")
        self.place = np.argsort(ids, kind="stable")
        self.table, self.ids = t.take(pa.array(self.place)), ids[self.place]
        parent = whole(self.table, "parent")
        self.root, n = parent == -1, len(ids)
        at = np.minimum(np.searchsorted(self.ids, parent), n - 1) if n else parent
        self.up = np.where((self.ids[at] == parent) & (parent != NONE) & key[0].is_valid, at, -1) if n else np.zeros(0, np.int64)
        self.parent = parent
        self.n = n

    def xyz(self) -> np.ndarray:
        return real(self.table, *"xyz")

    def below(self) -> list[list[int]]:
        """Places of each node's children, by id."""
        out: list[list[int]] = [[] for _ in range(self.n)]
        for i, u in enumerate(self.up.tolist()):
            if u >= 0:
                out[u].append(i)
        return out

    def order(self) -> list[int]:
        """Places, each parent before its children; those on a cycle are left out."""
        below, out = self.below(), np.flatnonzero(self.up < 0).tolist()
        for i in out:
            out += below[i]
        return out

    def childless(self) -> np.ndarray:
        out = np.ones(self.n, bool)
        out[self.up[self.up >= 0]] = False
        return out

    def sizes(self, p: np.ndarray) -> np.ndarray:
        """Length of each node's edge to its parent; 0 without one."""
        return np.where(self.up >= 0, distance(p, p[self.up]), 0.0) if self.n else np.zeros(0)

    def path(self, i: int) -> list[int]:
        """Places from a node up to its root."""
        out, up = [], self.up
        while i >= 0:
            out.append(i)
            if len(out) > self.n:
                raise ValueError("cycle of parents")
            i = int(up[i])
        return out

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Place of each id; -1 where absent."""
        if not self.n:
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.ids, ids), self.n - 1)
        return np.where((self.ids[at] == ids) & (ids != NONE), at, -1)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    x, y, z = p[:, 0] - q[:, 0], p[:, 1] - q[:, 1], p[:, 2] - q[:, 2]
    return np.sqrt(x * x + y * y + z * z)


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each of `counts` repeated so often, and the number of the repeat from 0."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def neighbours(p: np.ndarray, q: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) that hold all pairs of finite points within reach, and others of neighbouring cells; all of one i come together."""
    if not len(p) or not len(q):
        return
    if len(p) * len(q) <= 1 << 14:
        yield np.repeat(np.arange(len(p)), len(q)), np.tile(np.arange(len(q)), len(p))
        return
    cells, sizes = [], []
    for c in range(3):
        cell = np.floor(np.concatenate([p[:, c], q[:, c]]) / (reach * (1 + 1e-9)))
        cell -= cell.min()
        if cell.max() < 1 << 18:
            cells.append(cell.astype(np.int64) + 1)
        else:
            # Cells apart stay apart, however far: ranks with one gap.
            value, at = np.unique(cell, return_inverse=True)
            cells.append((1 + np.concatenate([[0], np.cumsum(np.where(np.diff(value) <= 1, 1, 2))]))[at])
        sizes.append(int(cells[-1].max()) + 2)
    code = (cells[2] * sizes[1] + cells[1]) * sizes[0] + cells[0]
    a, b = code[: len(p)], code[len(p) :]
    rows, cols = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[rows], b[cols]
    off = np.array([(k * sizes[1] + j) * sizes[0] for k in (-1, 0, 1) for j in (-1, 0, 1)])
    low = np.stack([np.searchsorted(b, a + o - 1) for o in off], 1)
    n = np.stack([np.searchsorted(b, a + o + 1, "right") for o in off], 1) - low
    total = np.cumsum(n.sum(1))
    start = 0
    while start < len(a):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + CHUNK, "right")))
        owner, k = spread(n[start:stop].reshape(-1))
        yield rows[start + owner // 9], cols[low[start:stop].reshape(-1)[owner] + k]
        start = stop


def pairs_within(ids: np.ndarray, p: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places i, j and distance of finite points nearer than reach, the lesser id first."""
    ok = np.flatnonzero(np.isfinite(p).all(1))
    out = [(ok[:0], ok[:0], np.zeros(0))]
    for i, j in neighbours(p[ok], p[ok], reach) if reach > 0 else ():
        i, j = ok[i], ok[j]
        some = ids[i] < ids[j]
        i, j = i[some], j[some]
        d = distance(p[i], p[j])
        near = d < reach
        out.append((i[near], j[near], d[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(start: np.ndarray, stop: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and number of runs of at most `size`, of consecutive places from each start up to its stop."""
    owner, k = spread(-(-(stop - start) // size))
    first = start[owner] + k * size
    return first, np.minimum(size, stop[owner] - first)


class Blocks:
    """Runs of at most `size` consecutive points, each with one of them in its middle and how far the others lie from that."""

    def __init__(self, p: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int):
        self.first, self.count = _runs(start, stop, size)
        of, k = spread(self.count)
        self.center = p[self.first + (self.count - 1) // 2]
        apart = distance(p.take(self.first[of] + k, axis=0), self.center.take(of, axis=0))
        self.radius = np.maximum.reduceat(apart, np.cumsum(self.count) - self.count) if len(apart) else apart

    @classmethod
    def near(cls, p: np.ndarray, gap: float, size: int) -> Blocks:
        """Blocks that end where the next point lies farther off than gap."""
        cut = np.flatnonzero(distance(p[1:], p[:-1]) > gap) + 1
        return cls(p, np.concatenate([[0], cut]), np.concatenate([cut, [len(p)]]), size)

    def places(self, of: np.ndarray) -> np.ndarray:
        """Places in each of these blocks, the last one repeated where a block is short."""
        return self.first[of, None] + np.minimum(np.arange(self.count.max()), self.count[of, None] - 1)


def _least(a: np.ndarray, b: np.ndarray, mine: Blocks, its: Blocks, i: np.ndarray, j: np.ndarray, best: np.ndarray) -> None:
    """Lowers best to the least distance of a's points in blocks i to b's in blocks j; all of one i come together."""
    step, cols = max(1, CHUNK // 16 // int(mine.count.max())), [np.ascontiguousarray(x) for x in b.T]
    for at in range(0, len(i), step):
        some = i[at : at + step]
        p, q = mine.places(some), its.places(j[at : at + step]).T
        own, d = [a[p, c] for c in range(3)], np.full(p.shape, np.inf)
        for k in q:
            # One of its points in turn: its squares are added up in the order of `distance`.
            x, y, z = (mine_ - its_[k][:, None] for mine_, its_ in zip(own, cols, strict=True))
            x *= x
            y *= y
            z *= z
            x += y
            x += z
            np.minimum(d, x, out=d)
        first = np.flatnonzero(np.diff(some, prepend=-1))
        p = p[first]
        best[p] = np.minimum(best[p], np.sqrt(np.minimum.reduceat(d, first, axis=0)))


def nearest_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each point of a to its nearest of b: inf if b is empty, NaN where a is not finite; points of b that are not take no part.

    Runs of points meet where their middles are near enough; runs of those that find none within reach meet the boxes of runs.
    """
    out, b = np.full(len(a), np.inf), b[np.isfinite(b).all(1)]
    todo = np.flatnonzero(np.isfinite(a).all(1))
    out[~np.isfinite(a).all(1)] = np.nan
    if not len(b) or not len(todo):
        return out
    box, top = np.ptp(b, axis=0), float(max(np.abs(a[todo]).max(), np.abs(b).max()))
    reach = max(float(np.prod(box) / len(b)) ** (1 / 3) / 4, float(box.max()) / len(b) / 4, top * 1e-12, 1e-12)
    while len(todo):
        p, best = a[todo], np.full(len(todo), np.inf)
        last = len(todo) * len(b) <= 1 << 14
        if last or len(todo) * len(b) <= 1 << 28 and len(todo) < len(a):
            _by_boxes(p, b, reach, best)
            last = True
        else:
            mine, its = Blocks.near(p, reach, 4), Blocks.near(b, reach, 4)
            far = (reach + mine.radius.max() + its.radius.max()) * (1 + 1e-9) + top * 1e-12
            for i, j in neighbours(mine.center, its.center, far):
                some = distance(mine.center.take(i, axis=0), its.center.take(j, axis=0)) <= (reach + mine.radius[i] + its.radius[j]) * (1 + 1e-9) + top * 1e-12
                _least(p, b, mine, its, i[some], j[some], best)
        done = (best <= reach) | last
        out[todo[done]] = best[done]
        todo, reach = todo[~done], reach * 2
    return out


def _by_boxes(a: np.ndarray, b: np.ndarray, gap: float, best: np.ndarray) -> None:
    """Lowers best to the distance of each point of a to its nearest of b, both not empty: runs of a without gaps meet the boxes of b's that may hold it."""
    mine, its = Blocks.near(a, gap, 4), Blocks.near(b, gap, 16)
    low, high = (f.reduceat(b, its.first, axis=0) for f in (np.minimum, np.maximum))
    step = max(1, CHUNK // 8 // len(low))
    for at in range(0, len(mine.first), step):
        c = mine.center[at : at + step]
        off = np.zeros((len(c), len(low)))
        for k in range(3):
            x = np.maximum(low[:, k] - c[:, k, None], c[:, k, None] - high[:, k])
            np.maximum(x, 0, out=x)
            off += x * x
        off = np.sqrt(off, out=off)
        q = its.places(off.argmin(1))
        least = np.sqrt(((b[q] - c[:, None]) ** 2).sum(2).min(1))
        reach = (least + 2 * mine.radius[at : at + step]) * (1 + 1e-9)
        i, j = np.nonzero(off <= reach[:, None])
        _least(a, b, mine, its, i + at, j, best)


def resampled(f: Forest, step: float) -> dict[str, np.ndarray]:
    """id, kind (place of the node whose type it has), x, y, z, radius, parent of the forest with a node every step along each chain; roots as they are."""
    p = np.hstack([f.xyz(), real(f.table, "radius")])
    size, order = np.nan_to_num(f.sizes(p[:, :3]), posinf=np.inf), f.order()
    kids = np.bincount(f.up[f.up >= 0], minlength=f.n)
    key = f.root | (kids != 1)
    up, far, start, end = f.up.tolist(), np.zeros(f.n), np.arange(f.n), np.arange(f.n)
    ends = key.tolist()
    for i in order:
        if (u := up[i]) >= 0:
            far[i] = far[u] + size[i]
            start[i] = u if ends[u] or up[u] < 0 else start[u]
    for i in reversed(order):
        if (u := up[i]) >= 0 and not ends[u]:
            end[u] = end[i]
    depth = np.zeros(f.n, np.int64)
    depth[order] = np.arange(len(order))
    seg = np.array([i for i in order if up[i] >= 0], np.int64)
    seg = seg[np.lexsort((depth[seg], f.ids[end[seg]]))]
    above, last = f.up[seg], end[seg] == seg
    s0, s1 = far[above] - far[start[seg]], far[seg] - far[start[seg]]
    low = np.maximum(np.ceil(s0 / step), 1).astype(np.int64)
    n = np.maximum(np.ceil((s1 - np.where(last, 1e-6, 0.0)) / step).astype(np.int64) - low, 0)
    # Each piece gives its inner points, the last of a chain also the chain's end.
    of, k = spread(n + last)
    own = last[of] & (k == n[of])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(own, 1.0, ((low[of] + k) * step - s0[of]) / (s1 - s0)[of])
    at = p[above[of]] + (p[seg[of]] - p[above[of]]) * t[:, None]
    ids = np.where(own, f.ids[seg[of]], (f.ids[-1] if f.n else 0) + np.cumsum(~own))
    new = np.diff(end[seg[of]], prepend=-1) != 0
    parent = np.where(new, f.ids[start[seg[of]]], np.concatenate([ids[:1], ids[:-1]])) if len(ids) else ids
    top = np.flatnonzero(f.root)
    at, ids, parent, kind = np.vstack([at, p[top]]), np.concatenate([ids, f.ids[top]]), np.concatenate([parent, f.parent[top]]), np.concatenate([seg[of], top])
    return {"id": ids.astype(np.int64), "kind": kind, **{c: at[:, i] for i, c in enumerate(("x", "y", "z", "radius"))}, "parent": parent.astype(np.int64)}
