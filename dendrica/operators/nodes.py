"""Per-node and relational operators on nodes(neuron_id, id, type, x, y, z, radius, parent)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.matrices import applied
from . import arrays as A

K = "neuron_id"


def rescale(nodes: DataFrame, scale: tuple[float, float, float]) -> DataFrame:
    return nodes.withColumns({c: F.col(c) * s for c, s in zip("xyz", scale, strict=True)})


def add_offset(nodes: DataFrame, offset: tuple[float, float, float]) -> DataFrame:
    return nodes.withColumns({c: F.col(c) + s for c, s in zip("xyz", offset, strict=True)})


def rotate_z(nodes: DataFrame, center: tuple[float, float], angle: float, degrees: bool = True) -> DataFrame:
    return nodes.withColumns(dict(zip("xyz", G.rotate_z(G.point(), center, angle, degrees), strict=True)))


def transform(nodes: DataFrame, matrix) -> DataFrame:
    """Coordinates under a 4x4 matrix; radii stay."""
    return nodes.withColumns(dict(zip("xyz", applied(G.point(), matrix), strict=True)))


def in_roi(nodes: DataFrame, low, high) -> DataFrame:
    """Closed box."""
    return nodes.where(" AND ".join(f"{c} BETWEEN {a} AND {b}" for c, a, b in zip("xyz", low, high, strict=True)))


def in_cube(nodes: DataFrame, start, end) -> DataFrame:
    """Half-open box."""
    return nodes.where(" AND ".join(f"{c} >= {a} AND {c} < {b}" for c, a, b in zip("xyz", start, end, strict=True)))


def roots(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent = -1")


def edges(nodes: DataFrame) -> DataFrame:
    """A row for each node with a present parent: both ends and the length."""
    p = nodes.select(K, F.col("id").alias("parent"), *(F.col(c).alias(f"p{c}") for c in "xyz"))
    return nodes.join(p, [K, "parent"]).select(K, "id", "parent", "type", "x", "y", "z", "px", "py", "pz", G.distance(G.point(), G.point("p")).alias("length"))


def child_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent <> -1").groupBy(K, F.col("parent").alias("id")).agg(F.count("*").alias("n_children"))


def children(nodes: DataFrame) -> DataFrame:
    """Children of each node that has any, in order."""
    return nodes.where("parent <> -1").groupBy(K, F.col("parent").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("children"))


def branches(nodes: DataFrame) -> DataFrame:
    """Nodes, other than roots, of more than one child."""
    return nodes.where("parent <> -1").join(child_counts(nodes).where("n_children > 1"), [K, "id"], "left_semi")


def leaves(nodes: DataFrame, with_isolated_root: bool = False) -> DataFrame:
    """Childless nodes; with_isolated_root: and roots of exactly one child."""
    counts = child_counts(nodes)
    out = nodes.join(counts, [K, "id"], "left_anti")
    if with_isolated_root:
        out = out.unionByName(nodes.where("parent = -1").join(counts.where("n_children = 1"), [K, "id"], "left_semi"))
    return out


def summary(nodes: DataFrame) -> DataFrame:
    """Size, edges, next id, box and length of each neuron."""
    size = nodes.groupBy(K).agg(
        F.count("*").alias("n_nodes"), F.count_if(F.col("parent") != -1).alias("n_edges"), (F.max("id") + 1).alias("next_id"), F.count_if(F.col("parent") == -1).alias("n_roots"),
        *(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in "xyz"),
    )
    return size.join(edges(nodes).groupBy(K).agg(F.sum("length").alias("length")), K, "left").withColumn("length", F.coalesce("length", F.lit(0.0)))


def crop(nodes: DataFrame, start, end) -> DataFrame:
    """Half-open crop, shifted to start and numbered from 1 in order; parents outside become -1."""
    kept = in_cube(nodes, start, end).withColumn("new_id", F.expr(f"row_number() OVER (PARTITION BY {K} ORDER BY id)").cast("long"))
    up = kept.select(K, F.col("id").alias("parent"), F.col("new_id").alias("new_parent"))
    out = kept.join(up, [K, "parent"], "left")
    moved = {c: F.col(c) - s for c, s in zip("xyz", start, strict=True)}
    return out.withColumns(moved).select(K, F.col("new_id").alias("id"), "type", "x", "y", "z", "radius", F.coalesce("new_parent", F.lit(-1)).cast("long").alias("parent"))


def reindex(nodes: DataFrame) -> DataFrame:
    """Ids 1..N by id."""
    numbered = nodes.withColumn("new_id", F.expr(f"row_number() OVER (PARTITION BY {K} ORDER BY id)").cast("long"))
    up = numbered.select(K, F.col("id").alias("parent"), F.col("new_id").alias("new_parent"))
    return numbered.join(up, [K, "parent"], "left").select(K, F.col("new_id").alias("id"), "type", "x", "y", "z", "radius", F.coalesce("new_parent", F.lit(-1)).cast("long").alias("parent"))


def merge(forests: list[DataFrame]) -> DataFrame:
    """Union of forests of the same neurons; with two or more, ids are dealt anew by forest, then id, and an absent parent is an error. Of none, an empty forest."""
    forests = [f for f in forests if f is not None]
    if not forests:
        return SparkSession.active().createDataFrame([], f"{K} bigint, id bigint, type int, x double, y double, z double, radius double, parent bigint")
    if len(forests) == 1:
        return forests[0]
    cols = [K, "id", "type", "x", "y", "z", "radius", "parent"]
    both = None
    for i, f in enumerate(forests):
        part = f.select(*cols).withColumn("src", F.lit(i))
        both = part if both is None else both.unionByName(part)
    numbered = both.withColumn("new_id", F.expr(f"row_number() OVER (PARTITION BY {K} ORDER BY src, id)").cast("long"))
    up = numbered.select(K, "src", F.col("id").alias("parent"), F.col("new_id").alias("new_parent"))
    absent = F.raise_error(F.concat(F.lit("absent parent: "), F.col("parent").cast("string"))).cast("bigint")
    parent = F.when(F.col("parent") == -1, F.lit(-1)).when(F.col("new_parent").isNotNull(), F.col("new_parent")).otherwise(absent)
    return numbered.join(up, [K, "src", "parent"], "left").select(K, F.col("new_id").alias("id"), "type", "x", "y", "z", "radius", parent.cast("long").alias("parent"))


def remove_duplicates(nodes: DataFrame, digits: int = 0, use_radius: bool = False) -> DataFrame:
    """One node a place (rounded half to even), the first by id; parents follow, unknown ones and loops become roots."""
    key = ", ".join(f"bround({c}, {digits})" for c in [*"xyz", *(["radius"] if use_radius else [])])
    keyed = nodes.withColumn("kept", F.expr(f"min(id) OVER (PARTITION BY {K}, {key})"))
    to = keyed.select(K, F.col("id").alias("parent"), F.col("kept").alias("to"))
    out = keyed.where("id = kept").join(to, [K, "parent"], "left")
    parent = F.when(F.col("to").isNull() | (F.col("to") == F.col("id")), -1).otherwise(F.col("to"))
    return out.select(K, "id", "type", "x", "y", "z", "radius", parent.cast("long").alias("parent"))


def remove_nodes(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Without gone(neuron_id, id); their children become roots."""
    kept = nodes.join(gone, [K, "id"], "left_anti")
    up = gone.select(K, F.col("id").alias("parent"), F.lit(True).alias("cut"))
    return kept.join(up, [K, "parent"], "left").withColumn("parent", F.when(F.col("cut"), F.lit(-1)).otherwise(F.col("parent")).cast("long")).drop("cut")


def father_path(nodes: DataFrame, step: int = 5) -> DataFrame:
    """Each node's id and those of its next ancestors, at most step in all."""
    up = nodes.select(K, F.col("id").alias("at"), F.col("parent").alias("next"))
    out = nodes.select(K, "id", F.array("id").alias("path"), F.col("parent").alias("at"))
    for _ in range(step - 1):
        out = out.join(up, [K, "at"], "left").select(K, "id", F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("at"))).alias("path"), F.coalesce("next", F.lit(-1)).alias("at"))
    return out.select(K, "id", "path")


def close_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs a < b of one neuron nearer than threshold: of each neuron, points of neighbouring cells of that width meet."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ids = A.whole(t, "id")
        i, j, d = A.pairs_within(ids, A.real(t, *"xyz"), threshold)
        return A.table(key, {"a": ids[i], "b": ids[j], "dist": d})

    return A.each(nodes.where(f"{K} IS NOT NULL AND id IS NOT NULL").select(K, "id", "x", "y", "z"), run, f"{K} bigint, a bigint, b bigint, dist double")
