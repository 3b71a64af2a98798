"""Reconstruction metrics for many (gold, pred) pairs at once; a pair is a neuron_id of both forests."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .arrays import CHUNK, nearest_distance
from .length import length, of_pair
from .nodes import K
from .tree import fiber_ends, fibers, resample

def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-cost assignment of min(n, m) pairs, by shortest augmenting paths."""
    if cost.size == 0:
        return np.zeros(0, int), np.zeros(0, int)
    if cost.shape[0] > cost.shape[1]:
        c, r = assign(cost.T)
        order = np.argsort(r)
        return r[order], c[order]
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        best, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[match[j0] - 1, free - 1] - u[match[j0]] - v[free]
            better = reduced < best[free]
            best[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(best[free])]
            delta = best[j1]
            u[match[used]] += delta
            v[used] -= delta
            best[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    cols = np.flatnonzero(match[1:])
    rows = match[1:][cols] - 1
    order = np.argsort(rows)
    return rows[order], cols[order]


def _xyz(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(c).to_numpy().astype(float) for c in "xyz"], 1) if t.num_rows else np.zeros((0, 3))


def _points(key, t: pa.Table, every: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and places of a forest's nodes, resampled at `every`, if given."""
    if every is None:
        return t.column("id").to_numpy(), _xyz(t)
    out = A.resampled(A.Forest(key, t), every)
    return out["id"], np.stack([out[c] for c in "xyz"], 1)


def _apart(key, left: pa.Table, right: pa.Table, every: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of gold's points and of pred's, distances of gold's and of pred's; NaN without a nearest."""
    (ids, g), (more, p) = (_points(key, t, every) for t in (left, right))
    return ids, more, *(np.where(np.isinf(x), np.nan, x) for x in (nearest_distance(g, p), nearest_distance(p, g)))


def _rows(gold: DataFrame, pred: DataFrame, cols: tuple[str, ...], give: Callable, schema: dict[str, pa.DataType]) -> DataFrame:
    """A row of what give(key, left table, right table) gives of each pair, made in its task; none where that is None."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        got = give(key, left, right)
        return A.table(key, {c: pa.array([] if got is None else [got[c]], t) for c, t in schema.items()})

    return A.both(gold.select(K, *cols), pred.select(K, *cols), run, ", ".join([f"{K} bigint", *(f"{c} {'bigint' if t == pa.int64() else 'double'}" for c, t in schema.items())]))


def _columns(every: float | None) -> tuple[str, ...]:
    return ("id", "x", "y", "z") if every is None else ("id", "x", "y", "z", "radius", "parent")


def distances(gold: DataFrame, pred: DataFrame, every: float | None = None) -> DataFrame:
    """neuron_id, side (gold, pred), id, d: each node's distance to the nearest of the other forest, both resampled at `every`, if given; null if that is empty."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, more, g, p = _apart(key, left, right, every)
        ids = np.concatenate([ids, more]) if len(g) + len(p) else np.zeros(0, np.int64)
        return A.table(key, {"side": pa.array(["gold"] * len(g) + ["pred"] * len(p), pa.string()), "id": ids, "d": pa.array(np.concatenate([g, p]), from_pandas=True, type=pa.float64())})

    cols = (K, *_columns(every))
    return A.both(gold.select(*cols), pred.select(*cols), run, f"{K} bigint, side string, id bigint, d double")


def _ssd(min_distance: float = 2.0, resampled: bool = True) -> Callable:
    def give(key, left: pa.Table, right: pa.Table) -> dict[str, float | None] | None:
        _, _, g, p = _apart(key, left, right, min_distance if resampled else None)
        if not len(g) + len(p):
            return None
        known = [x[~np.isnan(x)] for x in (g, p)]
        far = [x[x > min_distance] for x in known]
        mean = lambda x, none: float(x.mean()) if len(x) else none
        half = lambda a, b: None if a is None or b is None else (a + b) / 2
        some = any(len(x) for x in known)
        (a, b), (c, d) = (mean(x, None) for x in known), (mean(x, 0.0) if some else None for x in far)
        share = sum(map(len, far)) / (len(g) + len(p)) if some else None
        return {"sd_gt2pred": a, "sd_pred2gt": b, "ssd_gt2pred": c, "ssd_pred2gt": d, "ssd_percent": share, "sd": half(a, b), "ssd": half(c, d)}

    return give


def ssd(gold: DataFrame, pred: DataFrame, min_distance: float = 2.0, resampled: bool = True) -> DataFrame:
    """Mean distances each way, and means of those beyond min_distance (0 if none), of forests resampled at that step; null where a side is empty."""
    names = ("sd_gt2pred", "sd_pred2gt", "ssd_gt2pred", "ssd_pred2gt", "ssd_percent", "sd", "ssd")
    return _rows(gold, pred, _columns(min_distance if resampled else None), _ssd(min_distance, resampled), dict.fromkeys(names, pa.float64()))


def scored(df: DataFrame, tp, fp, fn) -> DataFrame:
    """With precision, recall and f1; 0 where a denominator is."""
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0))
    tp, fp, fn = (F.col(c).cast("double") for c in (tp, fp, fn))
    out = df.withColumns({"precision": share(tp, tp + fp), "recall": share(tp, tp + fn)})
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def _scores(tp: float, fp: float, fn: float) -> dict[str, float]:
    """What `scored` adds, of one pair."""
    precision, recall = _share(tp, tp + fp), _share(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": _share(2 * precision * recall, precision + recall)}


def _point(threshold: float = 4.0, resample_step: float | None = 2.0) -> Callable:
    def give(key, left: pa.Table, right: pa.Table) -> dict[str, float] | None:
        _, _, g, p = _apart(key, left, right, resample_step)
        if not len(g) + len(p):
            return None
        tp, found = int((p < threshold).sum()), int((g < threshold).sum())
        precision, recall = _share(tp, len(p)), _share(found, len(g))
        counts = {"num_gt": len(g), "num_pred": len(p), "TP": tp, "FP": len(p) - tp, "FN": len(g) - found}
        return counts | {"precision": precision, "recall": recall, "MES": _share(found, len(g) + len(p) - tp), "f1": _share(2 * precision * recall, precision + recall)}

    return give


COUNTS = dict.fromkeys(("num_gt", "num_pred", "TP", "FP", "FN"), pa.int64())


def point(gold: DataFrame, pred: DataFrame, threshold: float = 4.0, resample_step: float | None = 2.0) -> DataFrame:
    """Points of resampled forests matched strictly within threshold: TP are pred's, FN gold's; recall is of gold's."""
    return _rows(gold, pred, _columns(resample_step), _point(threshold, resample_step), COUNTS | dict.fromkeys(("precision", "recall", "MES", "f1"), pa.float64()))


def _keypoint(threshold: float = 5.0) -> Callable:
    def keys(key, t: pa.Table) -> np.ndarray:
        ids, parent = A.whole(t, "id"), A.whole(t, "parent")
        up = np.sort(parent[(parent != -1) & (parent != A.NONE)])
        kids = np.where((ids != A.NONE) & key[0].is_valid, np.searchsorted(up, ids, "right") - np.searchsorted(up, ids), 0)
        own = (parent != -1) & (parent != A.NONE)
        kinds = (own & (kids > 1), kids == 0, (parent == -1) & (kids == 1))
        at = [np.flatnonzero(kind) for kind in kinds]
        order = np.concatenate([x[np.argsort(ids[x], kind="stable")] for x in at])
        return _xyz(t)[order]

    def give(key, left: pa.Table, right: pa.Table) -> dict[str, float] | None:
        g, p = keys(key, left), keys(key, right)
        if not len(g) + len(p):
            return None
        cost = np.sqrt(((g[:, None] - p[None]) ** 2).sum(-1))
        r, c = assign(cost)
        tp = int((cost[r, c] < threshold).sum())
        return {"num_gt": len(g), "num_pred": len(p), "TP": tp, "FP": len(p) - tp, "FN": len(g) - tp} | _scores(tp, len(p) - tp, len(g) - tp)

    return give


def keypoint(gold: DataFrame, pred: DataFrame, threshold: float = 5.0) -> DataFrame:
    """Branches and leaves (and one-child roots) assigned one to one by least total distance; hits lie nearer than threshold."""
    return scored(_rows(gold, pred, ("id", "parent", "x", "y", "z"), _keypoint(threshold), COUNTS), "TP", "FP", "FN")


def sizes(p: np.ndarray) -> np.ndarray:
    """Lengths of a polyline's edges."""
    d = np.diff(p, axis=0)
    d *= d
    return np.sqrt(d[:, 0] + d[:, 1] + d[:, 2])


def steps(p: np.ndarray, every: float, eps: float = 1e-8) -> np.ndarray:
    """Points every so far along a polyline, and its last one."""
    if len(p) < 2:
        return p
    s = np.concatenate([[0], np.cumsum(sizes(p))])
    at = np.arange(0, s[-1], every)
    out = np.stack([np.interp(at, s, p[:, i]) for i in range(3)], 1)
    return out if len(out) and np.linalg.norm(out[-1] - p[-1]) <= eps else np.vstack([out, p[-1:]])


def chained(p: np.ndarray, keys: np.ndarray, every: float) -> np.ndarray:
    """Points every so far along each chain of a fiber, from one key node to the next, and its end; what lies between is gone."""
    at = np.flatnonzero(keys)
    return np.vstack([p[:1], *(steps(p[a : b + 1], every, 1e-6)[1:] for a, b in zip(at[:-1], at[1:], strict=True))]) if len(p) > 1 else p


def near(p: np.ndarray, q: np.ndarray, reach: float, size: int = 32) -> np.ndarray:
    """Whether each point of p lies within reach of one of q. Only runs of points whose boxes are that near are compared."""
    if not len(p) or not len(q):
        return np.zeros(len(p), bool)
    a, b = (np.vstack([x, np.repeat(x[-1:], -len(x) % size, 0)]).reshape(-1, size, 3) for x in (p, q))
    gap = np.maximum(0, np.maximum(a.min(1)[:, None] - b.max(1), b.min(1) - a.max(1)[:, None]))
    i, j = np.nonzero((gap**2).sum(-1) <= reach * reach * (1 + 1e-9) + 1e-9)
    hit, step = np.zeros(a.shape[:2], bool), max(1, CHUNK // (8 * size * size))
    for at in range(0, len(i), step):
        some = i[at : at + step]
        d = np.sqrt(((a[some, :, None] - b[j[at : at + step], None]) ** 2).sum(-1).min(-1))
        first = np.flatnonzero(np.diff(some, prepend=-1))
        hit[some[first]] |= np.logical_or.reduceat(d <= reach, first)
    return hit.reshape(-1)[: len(p)]


def polyline_length(p: np.ndarray) -> float:
    return float(sizes(p).sum())


def overlap(a: np.ndarray, b: np.ndarray, every: float, threshold: float) -> float:
    """Mean, over both directions, of the length of steps whose midpoint lies within threshold of a vertex of the other."""
    if len(a) < 2 or len(b) < 2:
        return 0.0
    a, b = steps(a, every), steps(b, every)

    def one(p: np.ndarray, q: np.ndarray) -> float:
        return float(sizes(p)[near((p[1:] + p[:-1]) / 2, q, threshold)].sum())

    return (one(a, b) + one(b, a)) / 2


def fiber_iou(a: np.ndarray, b: np.ndarray, every: float, threshold: float, least: float = 0.5) -> float:
    la, lb = polyline_length(a), polyline_length(b)
    if not la or not lb or min(la, lb) / max(la, lb) < least:
        return 0.0
    both = overlap(a, b, every, threshold)
    return both / (la + lb - both + 1e-7)


class Laid:
    """Polylines as points every so far, and the middles of their steps: what lines share from their first point on is
    laid once. A piece is a stretch that the same lines share; those lines follow each other in `order`."""

    def __init__(self, lines: list[np.ndarray], every: float):
        self.lines = len(lines)
        self.order = sorted((k for k, p in enumerate(lines) if len(p) > 1), key=lambda k: lines[k].tobytes())
        self.n = len(self.order)
        shared, counts, points, middles, last, known = [], [], [np.zeros((0, 3))], [np.zeros((0, 3))], None, 0
        lengths = [np.zeros(0)]
        for k in self.order:
            p, same = lines[k], 0
            s = np.concatenate([[0], np.cumsum(sizes(p))])
            n = len(np.arange(0, s[-1], every))
            if last is not None:
                m = min(len(p), len(last))
                other = np.flatnonzero((p[:m] != last[:m]).any(1))
                same = int(other[0]) if len(other) else m
            from_ = min(int(np.searchsorted(np.arange(known) * every, s[same - 1], "right")), n) if same else 0
            low = max(same - 1, 0)
            at = np.arange(from_, n) * every
            x = np.stack([np.interp(at, s[low:], p[low:, i]) for i in range(3)], 1)
            before = line[from_ - 1 : from_] if from_ else x[:0]
            tip = x[-1:] if len(x) else before
            if not len(tip) or np.linalg.norm(tip[0] - p[-1]) > 1e-8:
                x = np.vstack([x, p[-1:]])
            line = np.vstack([line[:from_], x]) if from_ else x
            whole = np.vstack([before, x])
            # A middle for each point: the first of a line stands for none and has no length.
            middle = (whole[1:] + whole[:-1]) / 2
            size = sizes(whole)
            points.append(x)
            middles.append(middle if from_ else np.vstack([x[:1], middle]))
            lengths.append(size if from_ else np.concatenate([[0.0], size]))
            shared.append(from_)
            counts.append(len(x))
            last, known = p, n
        self.points, self.middles, self.sizes = np.vstack(points), np.vstack(middles), np.concatenate(lengths)
        self.pieces = self._pieces(shared, counts)

    def _pieces(self, shared: list[int], counts: list[int]) -> np.ndarray:
        """First and last place (not included) of each piece, and first and last line (not included)."""
        out, base = [], 0
        for k, (low, n) in enumerate(zip(shared, counts, strict=True)):
            high, to = low + n, k + 1
            while high > low:
                while to < self.n and shared[to] >= high:
                    to += 1
                down = max(low, shared[to]) if to < self.n else low
                out.append((base + down - low, base + high - low, k, to))
                high = down
            base += n
        return np.array(sorted(out), np.int64).reshape(-1, 4)

    def words(self) -> np.ndarray:
        """Lines of each piece as bits."""
        bits = np.zeros((len(self.pieces), -(-self.n // 64) * 64), np.uint8)
        for row, (*_, a, b) in zip(bits, self.pieces.tolist(), strict=True):
            row[a:b] = 1
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).T.copy()

    def near(self, other: Laid, threshold: float) -> np.ndarray:
        """Length of each polyline's steps whose middles lie within threshold of a point of each of the other's.

        Runs of middles meet runs of points; single ones are compared only where the runs leave it open.
        """
        full = np.zeros((self.lines, other.lines))
        if not self.n or not other.n:
            return full
        start, stop = self.pieces[:, 0], self.pieces[:, 1]
        mine, its = A.Blocks(self.middles, start, stop, 4), A.Blocks(other.points, other.pieces[:, 0], other.pieces[:, 1], 5)
        words = other.words()[:, np.searchsorted(other.pieces[:, 1], its.first, "right")]
        hit, block = (np.zeros((len(words), n), np.uint64) for n in (len(self.middles), len(mine.first)))
        slack = 1e-9 * (1 + max((float(np.abs(x).max()) for x in (self.middles, other.points) if len(x)), default=0.0))
        far = threshold + mine.radius.max(initial=0) + its.radius.max(initial=0) + slack
        for i, j in A.neighbours(mine.center, its.center, far):
            d = A.distance(mine.center.take(i, axis=0), its.center.take(j, axis=0))
            some = d <= threshold + mine.radius[i] + its.radius[j] + slack
            i, j, d = i[some], j[some], d[some]
            sure = d + mine.radius[i] <= threshold - slack
            self._hit(block, i[sure], words[:, j[sure]])
            i, j = i[~sure], j[~sure]
            some = self._new(block, i, words, j)
            i, j = i[some], j[some]
            of, k = A.spread(mine.count[i])
            m, j = mine.first[i[of]] + k, j[of]
            d = A.distance(self.middles.take(m, axis=0), its.center.take(j, axis=0))
            got = d <= threshold
            self._hit(hit, m[got], words[:, j[got]])
            some = ~got & (d <= threshold + its.radius[j] + slack)
            m, j = m[some], j[some]
            some = self._new(hit, m, words, j)
            m, j = m[some], j[some]
            of, k = A.spread(its.count[j])
            got = A.distance(self.middles.take(m[of], axis=0), other.points.take(its.first[j[of]] + k, axis=0)) <= threshold
            self._hit(hit, m[of[got]], words[:, j[of[got]]])
        hit |= np.repeat(block, mine.count, axis=1)
        out = np.zeros((self.n, other.n))
        bits = np.unpackbits(np.ascontiguousarray(hit.T).view(np.uint8), axis=1, count=other.n, bitorder="little")
        for a, b, low, high in self.pieces.tolist():
            out[low:high] += self.sizes[a:b] @ bits[a:b]
        full[np.ix_(self.order, other.order)] = out
        return full

    @staticmethod
    def _hit(hit: np.ndarray, m: np.ndarray, words: np.ndarray) -> None:
        for row, word in zip(hit, words, strict=True):
            np.bitwise_or.at(row, m, word)

    @staticmethod
    def _new(hit: np.ndarray, m: np.ndarray, words: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether a hit by j would be news to m."""
        out = np.zeros(len(m), bool)
        for row, word in zip(hit, words, strict=True):
            out |= (word[j] & ~row[m]) != 0
        return out


def overlaps(g: list[np.ndarray], p: list[np.ndarray], every: float, threshold: float) -> np.ndarray:
    """overlap of each polyline of g with each of p. Fibers of a tree share most of their steps, which are compared once."""
    if not g or not p:
        return np.zeros((len(g), len(p)))
    a, b = Laid(g, every), Laid(p, every)
    return (a.near(b, threshold) + b.near(a, threshold).T) / 2


def _fiber(iou: float = 0.8, threshold: float = 5.0, every: float = 1.0, skip_center: float = 100.0, min_length: float = 5.0, resample_step: float | None = 2.0, with_direction: bool = False) -> Callable:
    def polylines(key, t: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        f = A.Forest(key, t)
        p, kids = f.xyz(), np.bincount(f.up[f.up >= 0], minlength=f.n)
        ways, lines, laid = [np.array(f.path(i)[::-1]) for i in fiber_ends(f)], [], {}
        for w in ways:
            at = np.flatnonzero((kids[w] != 1) | (np.arange(len(w)) == 0))
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) if resample_step is not None else ():
                if w[b] not in laid:
                    laid[w[b]] = steps(p[w[a : b + 1]], resample_step, 1e-6)[1:]
            lines.append(p[w] if resample_step is None else np.vstack([p[w[:1]], *(laid[w[b]] for b in at[1:])]))
        lines = [(x, size) for x in lines if len(x) > 1 and (size := polyline_length(x)) >= min_length]
        return [x for x, _ in lines], np.array([size for _, size in lines], float)

    def give(key, left: pa.Table, right: pa.Table) -> dict[str, float]:
        (g, la), (p, lb) = polylines(key, left), polylines(key, right)
        spots = lambda lines, of: np.array([of(x) for x in lines]).reshape(-1, 1, 3)
        apart = lambda of: np.linalg.norm(spots(g, of) - spots(p, of)[:, 0], axis=2)
        longer = np.maximum(la[:, None], lb)
        ratio = np.divide(np.minimum(la[:, None], lb), longer, out=np.zeros_like(longer), where=longer > 0)
        far = apart(lambda x: x.mean(0)) > skip_center
        if with_direction:
            far |= np.maximum(apart(lambda x: x[0]), apart(lambda x: x[-1])) > longer / 2
        common = overlaps(g, p, every, threshold)
        value = np.where(ratio < 0.5, 0.0, common / (la[:, None] + lb - common + 1e-7))
        value = np.where(ratio < min(0.5, iou), ratio, np.where(far, 0.01, value))
        r, c = assign(1 - value)
        got = value[r, c]
        tp = int((got >= iou).sum())
        whole = {"num_gt": len(g), "num_pred": len(p), "TP": tp, "FP": len(p) - tp, "FN": len(g) - tp}
        real = {"iou_matched": float(got.mean()) if len(got) else 0.0, "iou_all": float(got.sum() / max(len(g), len(p), 1))}
        return whole | real | _scores(tp, len(p) - tp, len(g) - tp)

    return give


def fiber(gold: DataFrame, pred: DataFrame, iou: float = 0.8, threshold: float = 5.0, every: float = 1.0, skip_center: float = 100.0, min_length: float = 5.0, resample_step: float | None = 2.0, with_direction: bool = False) -> DataFrame:
    """Root-to-leaf fibers, resampled from key node to key node, assigned one to one by greatest total IoU; hits reach `iou`. Pairs that cannot are settled by gates; with_direction: also those whose first or last points lie apart."""
    give = _fiber(iou, threshold, every, skip_center, min_length, resample_step, with_direction)
    return scored(_rows(gold, pred, ("id", "parent", "x", "y", "z"), give, COUNTS | dict.fromkeys(("iou_matched", "iou_all"), pa.float64())), "TP", "FP", "FN")


METRICS = {"ssd": ssd, "point": point, "length": length, "keypoint": keypoint, "fiber": fiber}
#: What each metric gives of one pair.
OF_PAIR = {"ssd": _ssd, "point": _point, "length": of_pair, "keypoint": _keypoint, "fiber": _fiber}
#: What ssd gives; the other metrics count.
DISTANCES = ("sd", "sd_gt2pred", "sd_pred2gt", "ssd", "ssd_gt2pred", "ssd_pred2gt", "ssd_percent")


def batch(gold: DataFrame, pred: DataFrame, names: tuple[str, ...] = ("ssd", "length", "keypoint", "fiber"), collect: str = "micro", params: dict[str, dict] | None = None) -> DataFrame:
    """One row a metric over all pairs, each of which meets all metrics in one task: counts added up (micro), or means of the pairs' scores (macro); means of distances either way."""
    gives = {name: OF_PAIR[name](**(params or {}).get(name, {})) for name in names}
    counts = ("TP", "FP", "FN", "precision", "recall", "f1")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = [{"metric": name} | {c: got[c] for c in (DISTANCES if name == "ssd" else counts)} for name, give in gives.items() if (got := give(key, left, right)) is not None]
        return A.table(key, {c: pa.array([r.get(c) for r in rows], pa.string() if c == "metric" else pa.float64()) for c in ("metric", *counts, *DISTANCES)})

    cols = (K, "id", "parent", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "radius")))
    out = A.both(gold.select(*cols), pred.select(*cols), run, ", ".join([f"{K} bigint, metric string", *(f"{c} double" for c in (*counts, *DISTANCES))]))
    grouped, means = out.groupBy("metric"), [F.avg(c).alias(c) for c in DISTANCES]
    if collect == "macro":
        return grouped.agg(F.count("*").alias("n_pairs"), *(F.avg(c).alias(c) for c in ("precision", "recall")), F.avg("f1").alias("f1_score"), *means)
    total = grouped.agg(F.count("*").alias("n_pairs"), *(F.sum(c).alias(c) for c in ("TP", "FP", "FN")), *means)
    total = scored(total, "TP", "FP", "FN").withColumnRenamed("f1", "f1_score")
    none = F.col("TP").isNull()
    return total.withColumns({c: F.when(~none, F.col(c)) for c in ("precision", "recall", "f1_score")})


__all__ = ["METRICS", "assign", "batch", "distances", "fiber", "fibers", "keypoint", "nearest_distance", "point", "resample", "ssd"]
