"""Nearest neighbours by collision-counting hashing with query-centred windows.

Vectors lie in blocks of bounded size: by the signs of their first projections
about the mean, so that near ones meet, and by hash where a block would grow too
large. A block keeps each of its PROJECTIONS random projections as a sorted array
and each vector's rank in it. A query opens a window around its own projection
in every array; a vector whose ranks lie in a threshold's share of the windows
is verified by its exact distance. Virtual rehashing widens all windows at once.

A query meets its own block first: its windows grow until they reach REACH times
the k-th smallest distance verified, or hold all. That distance bounds what is
looked for elsewhere, so in any other block windows of that width are enough:
a block is skipped whole if fewer windows than the threshold meet the ranges of
its arrays, and its arrays are built once for up to QUERIES queries. A vector at
the k-th distance passes the threshold but for a chance of MARGIN standard
deviations, nearer ones more surely.

Ids are whole numbers (other kinds are refused). Null, zero and non-finite
vectors and rows with a null id take no part; vectors of each length are searched
among those of that length. Every row that is a query asks for itself, and is no
candidate of its own; rows that repeat its id are. With no candidates a query has
no rows. Ties go to the smaller id. Other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

PROJECTIONS, WIDEN, SEED = 128, 1.3, 11
#: Half-width of windows in k-th distances, and standard deviations between the threshold and the collisions expected of a vector at that distance.
REACH, MARGIN = 1.5, 1.3
#: Vectors of a block (ranks are 16 bits), and queries that meet it in one task.
BLOCK, QUERIES = 16_384, 65_536
#: Projections whose signs may deal vectors into blocks.
SIGNS = 40


def usable(col: Column) -> Column:
    v = F.col(col) if isinstance(col, str) else col
    numbers = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) > 0) & numbers & F.exists(v, lambda x: x != 0), F.lit(False))


def phi(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS))


def threshold() -> int:
    """Windows that a vector lies in before it is verified."""
    chance = 2 * phi(REACH) - 1
    return max(1, math.floor(PROJECTIONS * chance - MARGIN * math.sqrt(PROJECTIONS * chance * (1 - chance))))


class Block:
    """Sorted projections of some vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, data: np.ndarray) -> None:
        self.rows, self.ids, self.data, self.need = rows, ids, data, threshold()
        self.directions = directions(data.shape[1])
        placed = np.ascontiguousarray((data @ self.directions).T)
        order = np.argsort(placed, axis=1, kind="stable")
        self.line = np.take_along_axis(placed, order, 1)
        # Projections that two or more vectors share have ranks of their own each; windows hold them all or none.
        self.rank = np.empty(placed.shape, np.uint16)
        np.put_along_axis(self.rank, order, np.arange(len(ids), dtype=np.uint16)[None], 1)
        self.low, self.inside = np.empty(placed.shape, np.uint16), np.empty(placed.shape, bool)
        self.verified = 0

    def windows(self, asked: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First rank and number of ranks in each array's window, of queries (projections, queries)."""
        low, high = (np.stack([np.searchsorted(line, x, side) for line, x in zip(self.line, asked + s * width, strict=True)]) for s, side in ((-1, "left"), (1, "right")))
        return low, high - low

    def collisions(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """In how many arrays each vector lies in the window."""
        if (size == len(self.ids)).all():
            return np.full(len(self.ids), PROJECTIONS, np.uint8)
        np.subtract(self.rank, low.astype(np.uint16)[:, None], out=self.low)
        np.less(self.low, size.astype(np.uint16)[:, None], out=self.inside)
        return np.add.reduce(self.inside.view(np.uint8), axis=0, dtype=np.uint8)

    def distances(self, some: np.ndarray, query: np.ndarray) -> np.ndarray:
        self.verified += len(some)
        return np.sqrt(((self.data[some] - query) ** 2).sum(1))

    def best(self, some: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.lexsort((self.ids[some], far))[:k]
        return some[order], far[order]

    def grown(self, rows: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and distances of the k nearest found of each query, its own row apart, by windows that grow."""
        n, asked = len(self.ids), (queries @ self.directions).T
        spread = float(np.median(self.line[:, (3 * n) // 4] - self.line[:, n // 4]))
        width = np.full(len(queries), max(spread / 64, 1e-9))
        out = [(np.zeros(0, np.int64), np.zeros(0)) for _ in queries]
        # A row's own place is done from the start.
        done = [np.isin(self.rows, r) for r in rows]
        active = np.arange(len(queries))
        while len(active):
            low, size = self.windows(asked[:, active], width[active])
            again = []
            for j, q in enumerate(active.tolist()):
                count = self.collisions(low[:, j], size[:, j])
                count[done[q]] = 0
                new = np.flatnonzero(count >= self.need)
                found, far = out[q]
                if len(new):
                    done[q][new] = True
                    found, far = out[q] = self.best(np.append(found, new), np.append(far, self.distances(new, queries[q])), k)
                if (size[:, j] == n).all():
                    continue
                if len(found) < k:
                    width[q] *= WIDEN if 2 * int(count.max()) >= self.need else 2
                elif width[q] >= REACH * far[-1]:
                    continue
                else:
                    width[q] = REACH * far[-1]
                again.append(q)
            active = np.array(again, np.int64)
        return out

    def within(self, queries: np.ndarray, far: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and distances of up to k vectors found that are no further than far from each query; nothing where too few windows meet the arrays."""
        asked, out = (queries @ self.directions).T, []
        low, size = self.windows(asked, REACH * far)
        for j, query in enumerate(queries):
            if np.count_nonzero(size[:, j]) < self.need:
                out.append((np.zeros(0, np.int64), np.zeros(0)))
                continue
            some = np.flatnonzero(self.collisions(low[:, j], size[:, j]) >= self.need)
            d = self.distances(some, query)
            out.append(self.best(some[d <= far[j]], d[d <= far[j]], k))
        return out


def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), float).reshape(n, -1)


def _signs(rows: DataFrame) -> DataFrame:
    """rows(__row, __id, __v, __q, __dim) with __signs: on which side of the mean the first projections lie, a bit each."""

    def summed(batches):
        for b in batches:
            dims = b.column(1).to_numpy()
            for d in np.unique(dims).tolist():
                some = b.filter(pa.array(dims == d))
                yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([matrix(pa.chunked_array([some.column(0)]), some.num_rows).sum(0).tolist()], pa.list_(pa.float64())), pa.array([some.num_rows], pa.int64())], ["d", "s", "n"])

    sums = rows.select("__v", "__dim").mapInArrow(summed, "d int, s array<double>, n bigint").select("d", "n", F.posexplode("s").alias("i", "x"))
    mean = sums.groupBy("d", "i").agg((F.sum("x") / F.sum("n")).alias("m")).groupBy(F.col("d").alias("__dim")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("__mean"))

    def run(batches):
        for b in batches:
            dims, bits = b.column(4).to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                some = b.take(pa.array(at))
                centred = matrix(pa.chunked_array([some.column(2)]), len(at)) - matrix(pa.chunked_array([some.column(5)]), len(at))
                bits[at] = (centred @ directions(d)[:, :SIGNS] > 0) @ (1 << np.arange(SIGNS))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(bits)], ["__row", "__id", "__v", "__q", "__dim", "__signs"])

    return rows.join(mean, "__dim").select("__row", "__id", "__v", "__q", "__dim", "__mean").mapInArrow(run, "__row bigint, __id bigint, __v array<double>, __q boolean, __dim int, __signs bigint")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, key, score: the k nearest found of each row that is_query holds for, among all other rows."""
    if (kind := vectors.schema[key].dataType.simpleString()) not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids must be whole numbers, not {kind}")
    own = vectors.select(F.col(key).cast("long").alias("__id"), F.col(vector).cast("array<double>").alias("__v"), F.coalesce(is_query, F.lit(False)).alias("__q"))
    own = own.where(usable("__v") & F.col("__id").isNotNull()).select(F.monotonically_increasing_id().alias("__row"), "*", F.size("__v").alias("__dim"))
    rows = table(_signs(table(own)))
    # A row for each length of vectors; then one for each block.
    sizes = rows.groupBy("__dim").agg(F.count("*").alias("n"), F.count_if("__q").alias("q"))
    sizes = table(sizes.select("__dim", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / block))).cast("int").alias("bits"), F.greatest(F.lit(1), F.ceil(F.col("q") / QUERIES)).cast("int").alias("chunks")))
    celled = rows.join(sizes, "__dim").withColumn("__cell", F.col("__signs").bitwiseAND(F.expr(f"shiftleft(1L, least(bits, {SIGNS})) - 1")))
    cells = celled.groupBy("__dim", "__cell").agg(F.ceil(F.count("*") / block).cast("int").alias("__subs"))
    blocked = table(celled.join(cells, ["__dim", "__cell"]).select("__row", "__id", "__v", "__q", "__dim", "__cell", F.pmod(F.xxhash64("__row"), F.col("__subs")).cast("int").alias("__sub"), "chunks"))
    of = ["__dim", "__cell", "__sub"]
    pairs, real = pa.list_(pa.int64()), pa.list_(pa.float64())

    def built(t: pa.Table) -> Block:
        return Block(t.column("__row").to_numpy(), t.column("__id").to_numpy(), matrix(t.column("__v"), t.num_rows))

    def first(t):
        b, asks = built(t), t.filter(t.column("__q"))
        found = b.grown(asks.column("__row").to_numpy(), matrix(asks.column("__v"), asks.num_rows), k) if asks.num_rows else []
        far = [float(d[-1]) if len(d) == k else math.inf for _, d in found]
        return asks.select(["__row", "__id", "__v", *of, "chunks"]).append_column("far", pa.array(far, pa.float64())).append_column("ids", pa.array([b.ids[i].tolist() for i, _ in found], pairs)).append_column("scores", pa.array([d.tolist() for _, d in found], real))

    asked = table(blocked.groupBy(*of).applyInArrow(first, "__row bigint, __id bigint, __v array<double>, __dim int, __cell bigint, __sub int, chunks int, far double, ids array<bigint>, scores array<double>"))
    others = table(blocked.select(*of).distinct())
    chunk = F.pmod(F.xxhash64(F.lit(2), "__row"), F.col("chunks")).cast("int").alias("__chunk")
    # The queries against all rows, block by block; each asks in every block but its own.
    away = asked.select(F.col("__row"), F.col("__id"), F.col("__v").alias("v"), "far", "__dim", F.col("__cell").alias("c"), F.col("__sub").alias("s"), chunk).join(others, "__dim").where("c <> __cell OR s <> __sub").drop("c", "s")
    data = blocked.select("__row", "__id", "__v", *of, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("__chunk"))

    def run(left, right):
        out = [[], [], [], []]
        if left.num_rows and right.num_rows:
            b = built(left)
            found = b.within(matrix(right.column("v"), right.num_rows), right.column("far").to_numpy(), k)
            for row, qid, (some, d) in zip(right.column("__row").to_pylist(), right.column("__id").to_pylist(), found, strict=True):
                if len(some):
                    for to, value in zip(out, (row, qid, b.ids[some].tolist(), d.tolist()), strict=True):
                        to.append(value)
        return pa.table([pa.array(x, kind) for x, kind in zip(out, (pa.int64(), pa.int64(), pairs, real), strict=True)], ["__row", "__id", "ids", "scores"])

    met = data.groupBy(*of, "__chunk").cogroup(away.groupBy(*of, "__chunk")).applyInArrow(run, "__row bigint, __id bigint, ids array<bigint>, scores array<double>")
    every = asked.select("__row", "__id", "ids", "scores").unionByName(met).select("__row", F.col("__id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    every = every.select("__row", "query_id", F.col("x.ids").alias(key), F.col("x.scores").alias("score"))
    rank = F.expr(f"CAST(row_number() OVER (PARTITION BY `__row` ORDER BY score, `{key}`) AS INT)")
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
