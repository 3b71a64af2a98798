"""Tree operators: depths by pointer doubling (a forest of depth d takes about log2(d) joins), what needs whole paths or chains a neuron a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import geometry as G
from ..plans.forest import written
from . import arrays as A
from .nodes import K, edges, leaves


def rooted(nodes: DataFrame) -> DataFrame:
    """neuron_id, id, root_id, depth, root_length of every node."""
    length = edges(nodes).select(K, "id", F.col("parent").alias("up"), "length")
    state = nodes.select(K, "id").join(length, [K, "id"], "left").select(K, "id", F.coalesce("up", "id").alias("anc"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.coalesce("length", F.lit(0.0)).alias("len"))
    state, before = written(state), -1
    while (total := state.agg(F.sum("hops")).first()[0] or 0) != before:
        before = total
        step = state.select(K, F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("hops").alias("hops2"), F.col("len").alias("len2"))
        state = written(state.join(step, [K, "anc"]).select(K, "id", F.col("anc2").alias("anc"), (F.col("hops") + F.col("hops2")).alias("hops"), (F.col("len") + F.col("len2")).alias("len")))
    return state.select(K, "id", F.col("anc").alias("root_id"), F.col("hops").alias("depth"), F.col("len").alias("root_length"))


def closure(nodes: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """neuron_id, id, anc, dist: every node, or those of(neuron_id, id), with itself and each ancestor."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table, some: pa.Table | None = None) -> pa.Table:
        f = A.Forest(key, t)
        own = np.arange(f.n) if some is None else np.unique(f.find(A.whole(some, "id")))
        own = own[own >= 0] if key[0].is_valid or some is None else own[:0]
        at, dist, out = own, 0, [np.zeros((3, 0), np.int64)]
        while len(at):
            if dist > f.n:
                raise ValueError("cycle of parents")
            out.append(np.stack([f.ids[own], f.ids[at], np.full(len(at), dist)]))
            up = f.up[at]
            own, at, dist = own[up >= 0], up[up >= 0], dist + 1
        return A.table(key, dict(zip(("id", "anc", "dist"), np.concatenate(out, 1), strict=True)))

    schema, nodes = f"{K} bigint, id bigint, anc bigint, dist bigint", nodes.select(K, "id", "parent")
    return A.each(nodes, run, schema) if of is None else A.both(nodes, of.select(K, "id"), run, schema)


def components(nodes: DataFrame) -> DataFrame:
    """Size of each root's tree."""
    return rooted(nodes).groupBy(K, "root_id").agg(F.count("*").alias("n_nodes"), F.max("depth").alias("depth"))


def fibers(nodes: DataFrame, min_length: float = 0.0, only_from_soma: bool = False) -> DataFrame:
    """A row for each path from a root to a leaf, of two nodes or more."""
    r = rooted(nodes)
    kinds = nodes.select(K, "id", "type")
    ends = leaves(nodes).select(K, "id", F.col("type").alias("leaf_type")).join(r, [K, "id"]).where("depth > 0")
    out = ends.join(kinds.select(K, F.col("id").alias("root_id"), F.col("type").alias("root_type")), [K, "root_id"])
    out = out.where(F.col("root_length") >= min_length)
    if only_from_soma:
        out = out.where("root_type = 1")
    return out.select(K, F.col("id").alias("leaf_id"), "root_id", "root_type", "leaf_type", (F.col("depth") + 1).alias("n_nodes"), F.col("root_length").alias("length"))


def fiber_nodes(nodes: DataFrame) -> DataFrame:
    """neuron_id, leaf_id, pos (0 at the root), id and coordinates of the nodes of each fiber."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        f = A.Forest(key, t)
        ways = [f.path(i)[::-1] for i in fiber_ends(f)]
        at, (leaf, pos) = np.concatenate([np.zeros(0, np.int64), *ways]).astype(np.int64), A.spread(np.array([len(w) for w in ways], np.int64))
        ends = np.array([w[-1] for w in ways], np.int64)
        some = f.table.take(pa.array(at))
        return A.table(key, {"leaf_id": f.ids[ends[leaf]], "pos": pos, "id": f.ids[at]} | {c: some.column(c) for c in "xyz"})

    cols = (F.col(c).cast("double").alias(c) for c in "xyz")
    return A.each(nodes.select(K, "id", "parent", *cols), run, f"{K} bigint, leaf_id bigint, pos bigint, id bigint, x double, y double, z double")


def fiber_ends(f: A.Forest) -> list[int]:
    """Places of childless nodes that are not roots."""
    return np.flatnonzero(f.childless() & ~f.root & (f.parent != A.NONE)).tolist()


def subtrees(nodes: DataFrame) -> DataFrame:
    """Size and length of the subtree below each node; the node's own edge counts."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        f = A.Forest(key, t)
        n, size, up, order = [1] * f.n, np.nan_to_num(f.sizes(f.xyz()), posinf=np.inf).tolist(), f.up.tolist(), f.order()
        for i in reversed(order):
            if (u := up[i]) >= 0:
                n[u] += n[i]
                size[u] += size[i]
        return A.table(key, {"id": f.ids[order], "n_nodes": np.array(n, np.int64)[order], "length": np.array(size, float)[order]})

    return A.each(nodes.select(K, "id", "parent", "x", "y", "z"), run, f"{K} bigint, id bigint, n_nodes bigint, length double")


def lca(nodes: DataFrame, pairs: DataFrame, ids_from: int = 1) -> DataFrame:
    """lca of pairs(neuron_id, u, v): -1 in different trees, or where the answer's id is below ids_from. The deeper end of a pair climbs."""
    pairs = pairs.select(K, "u", "v", *(c for c in pairs.columns if c not in (K, "u", "v")))
    schema = StructType([*pairs.schema.fields, StructField("lca", LongType())])

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        f = A.Forest(key, left)
        depth, up = np.zeros(f.n + 1, np.int64), np.append(f.up, -1)
        for i in f.order():
            depth[i] = depth[up[i]] + 1
        a, b = (f.find(A.whole(right, c)) if key[0].is_valid else np.full(right.num_rows, -1) for c in "uv")
        some = np.flatnonzero((a != b) & (a >= 0) & (b >= 0))
        while len(some):
            da, db = depth[a[some]], depth[b[some]]
            a[some], b[some] = np.where(da >= db, up[a[some]], a[some]), np.where(db >= da, up[b[some]], b[some])
            some = some[(a[some] != b[some]) & (a[some] >= 0) & (b[some] >= 0)]
        found = np.full(len(a), -1)
        met = (a == b) & (a >= 0)
        found[met] = f.ids[a[met]]
        return right.append_column("lca", pa.array(np.where(found >= ids_from, found, -1).astype(np.int64)))

    return A.both(nodes.select(K, "id", "parent"), pairs, run, schema)


def resample(nodes: DataFrame, step: float = 2.0) -> DataFrame:
    """The forest with a node every step along each chain between key nodes (roots, leaves, branches).

    Key nodes keep ids and types; nodes between them are gone. New ones are numbered
    past the neuron's largest id by chain (its end's id) and position, with the type
    of the next old node down. A chain's end always stays; a step that would fall
    within 1e-6 of it is left out.
    """

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        f = A.Forest(key, t)
        out = A.resampled(f, step)
        kind = f.table.column("type").take(pa.array(out.pop("kind")))
        return A.table(key, {"id": out.pop("id"), "type": kind} | {c: pa.array(v, from_pandas=True) for c, v in out.items()})

    real = (F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "radius"))
    kind = nodes.schema["type"].dataType.simpleString()
    return A.each(nodes.select(K, "id", "type", *real, "parent"), run, f"{K} bigint, id bigint, type {kind}, x double, y double, z double, radius double, parent bigint")


def turn_angles(nodes: DataFrame) -> DataFrame:
    """Angle at each node that has a parent and a child, a row for each child."""
    e = edges(nodes)
    nxt = nodes.select(K, F.col("parent").alias("id"), F.col("id").alias("child"), *(F.col(c).alias(f"n{c}") for c in "xyz"))
    return e.join(nxt, [K, "id"]).select(K, "id", "child", G.turn_angle(G.point("p"), G.point(), G.point("n")).alias("angle"))
