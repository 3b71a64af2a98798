"""Length metric: gold edges matched, one after the other, to routes of the reconstruction that nothing else uses."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .arrays import CHUNK
from .nodes import K

#: The far end of a used stretch stays open by this share of its edge.
OPEN = 0.001


class Tree:
    """One forest as arrays; an edge goes by the place of its lower node."""

    def __init__(self, ids: np.ndarray, parents: np.ndarray, xyz: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.xyz, up = ids[order], xyz[order], parents[order]
        at = np.minimum(np.searchsorted(self.ids, up), max(0, len(up) - 1))
        self.up = np.where((up != -1) & (self.ids[at] == up), at, -1) if len(up) else np.zeros(0, int)
        self.above = self.up.tolist()
        self.size = np.where(self.up >= 0, np.sqrt(((self.xyz - self.xyz[self.up]) ** 2).sum(1)), 0.0) if len(up) else np.zeros(0)

    def downward(self) -> list[int]:
        """Places from the last root on, the last child's subtree first."""
        below = defaultdict(list)
        for i, u in enumerate(self.above):
            below[u].append(i)
        out, todo = [], list(below[-1])
        while todo:
            out.append(i := todo.pop())
            todo += below[i]
        return out

    def path(self, i: int) -> list[int]:
        out, up = [i], self.above
        while (i := up[i]) >= 0:
            out.append(i)
        return out


def closest(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Nearest point to each point of the segment (a, b) beside it."""
    ab = b - a
    sq = (ab**2).sum(-1)
    t = ((points - a) * ab).sum(-1) / np.where(sq < 1e-7, 1.0, sq)
    foot = a + np.where(sq < 1e-7, 0.0, t)[..., None] * ab
    inside = ((foot >= np.minimum(a, b)) & (foot <= np.maximum(a, b))).all(-1)
    nearer = ((points - a) ** 2).sum(-1) < ((points - b) ** 2).sum(-1)
    return np.where(inside[..., None], foot, np.where(nearer[..., None], a, b))


def _near(points: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (point, segment), once each and in order, of all within radius and of others: segments go by pieces about as long as the mean of them is."""
    if len(points) * len(a) <= 1 << 13 or not all(np.isfinite(x).all() for x in (points, a, b)):
        return np.repeat(np.arange(len(points)), len(a)), np.tile(np.arange(len(a)), len(points))
    longest = max(radius, float(size.mean()) / 4, float(size.max()) / 256)
    n = np.ceil(size / longest).astype(np.int64)
    of, k = A.spread(n)
    middles = a[of] + (b[of] - a[of]) * ((k + 0.5) / n[of])[:, None]
    slack = 1e-9 * (1 + max(float(np.abs(x).max()) for x in (points, a, b)))
    codes = [i * len(a) + of[j] for i, j in A.neighbours(points, middles, radius + longest / 2 + slack)]
    return np.divmod(np.unique(np.concatenate([np.zeros(0, np.int64), *codes])), len(a))


def candidates(points: np.ndarray, tree: Tree, radius: float) -> list[list[tuple[int, np.ndarray]]]:
    """For each point the edges within radius, nearest first (ties by id), with their closest points."""
    edges, out = np.flatnonzero(tree.size > 0), [[] for _ in points]
    if not len(edges) or not len(points):
        return out
    a, b = tree.xyz[edges], tree.xyz[tree.up[edges]]
    some, others = _near(points, a, b, tree.size[edges], radius)
    for at in range(0, len(some), CHUNK // 8):
        i, j = some[at : at + CHUNK // 8], others[at : at + CHUNK // 8]
        feet = closest(points[i], a[j], b[j])
        d = np.sqrt(((feet - points[i]) ** 2).sum(-1))
        near = np.flatnonzero(d <= radius)
        for d, i, j, foot in zip(d[near].tolist(), i[near].tolist(), edges[j[near]].tolist(), feet[near], strict=True):
            out[i].append((d, j, foot))
    return [[(e, foot) for _, e, foot in sorted(x, key=lambda v: v[:2])] for x in out]


class Usage:
    """Which stretches (shares from an edge's lower end) of which edges are taken."""

    def __init__(self):
        self.parts, self.whole = defaultdict(list), set()

    def free(self, edge: int, low: float, high: float) -> bool:
        if edge in self.whole:
            return False
        return not (low < high and any(low <= b and a <= high for a, b in self.parts[edge]))

    def take(self, edge: int, low: float, high: float) -> None:
        if low < high:
            self.parts[edge].append((low, high))


def _apart(p: np.ndarray, q: np.ndarray) -> float:
    v = p - q
    return math.sqrt(v.dot(v))


def _route(tree: Tree, a: int, foot_a: np.ndarray, b: int, foot_b: np.ndarray) -> tuple[float, list, list[int]] | None:
    """Length of the way between points of two edges, its end stretches and the edges between; None without a way."""
    share = lambda e, foot: _apart(foot, tree.xyz[e]) / tree.size[e]
    if a == b:
        low, high = sorted((share(a, foot_a), share(b, foot_b)))
        return _apart(foot_a, foot_b), [(a, low, high - OPEN)], []
    above = tree.path(a)
    known = {e: k for k, e in enumerate(above)}
    other = tree.path(b)
    meet = next((k for k, e in enumerate(other) if e in known), None)
    if meet is None or tree.ids[other[meet]] < 1:
        return None
    total, ends, between = 0.0, [], []
    for e, foot, way in ((a, foot_a, above[: known[other[meet]]]), (b, foot_b, other[:meet])):
        if way:  # up over the edge's upper end
            total += _apart(foot, tree.xyz[tree.up[e]]) + float(tree.size[way[1:]].sum())
            ends.append((e, share(e, foot), 1.0 - OPEN))
            between += way[1:]
        else:  # down to its lower end
            total += _apart(foot, tree.xyz[e])
            ends.append((e, 0.0, share(e, foot) - OPEN))
    return total, ends, between


def matched(gold: Tree, pred: Tree, radius: float, ratio: float) -> tuple[float, float]:
    """Length of the gold edges that find a free route of like length, and of those routes."""
    near, used, own, found = candidates(gold.xyz, pred, radius), Usage(), 0.0, 0.0
    for i in gold.downward():
        up, size = int(gold.up[i]), float(gold.size[i])
        if up < 0:
            continue
        pairs = ((a, fa, b, fb) for a, fa in near[i] for b, fb in near[up])
        for way in (_route(pred, *pair) for pair in pairs):
            if way is None or not abs(way[0] - size) < ratio * size:
                continue
            total, ends, between = way
            if any(e in used.whole or used.parts[e] for e in between) or not all(used.free(*end) for end in ends):
                continue
            for end in ends:
                used.take(*end)
            used.whole.update(between)
            own, found = own + size, found + total
            break
    return own, found


def of_pair(radius: float = 2.0, ratio: float = 0.2) -> Callable:
    """What length gives of a pair of forests."""

    def tree(t: pa.Table) -> Tree:
        xyz = np.stack([t.column(c).to_numpy().astype(float) for c in "xyz"], 1)
        return Tree(t.column("id").to_numpy().astype(np.int64), t.column("parent").to_numpy().astype(np.int64), xyz)

    def give(key, left: pa.Table, right: pa.Table) -> dict[str, float]:
        g, p = tree(left), tree(right)
        own, found = (round(v, 8) for v in matched(g, p, radius, ratio))
        a, b = round(float(g.size.sum()), 8), round(float(p.size.sum()), 8)
        recall, precision = min(round(own / a, 8), 1.0) if a else 0.0, min(round(found / b, 8), 1.0) if b else 0.0
        return {"recall": recall, "precision": precision, "f1": 2 * recall * precision / (recall + precision + 1e-6), "TP": own, "FP": b - own, "FN": a - own}

    return give


def length(gold: DataFrame, pred: DataFrame, radius: float = 2.0, ratio: float = 0.2) -> DataFrame:
    """TP, FP and FN as lengths, with recall of gold's length and precision of pred's, each pair of forests in one task.

    Gold edges take their turn from the last tree on, last child first; of equally
    near edges the least id is tried first.
    """
    give = of_pair(radius, ratio)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return A.table(key, {k: pa.array([v], pa.float64()) for k, v in give(key, left, right).items()})

    cols = (K, "id", "parent", *(F.col(c).cast("double").alias(c) for c in "xyz"))
    # Not dealt anew: a neuron takes milliseconds, and forests come in partitions by neuron.
    return gold.select(*cols).toDF(K, "id", "parent", *"xyz").groupBy(K).cogroup(pred.select(*cols).toDF(K, "id", "parent", *"xyz").groupBy(K)).applyInArrow(run, f"{K} bigint, recall double, precision double, f1 double, TP double, FP double, FN double")
