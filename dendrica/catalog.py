"""Every registered query of the morphology engine, with its SQL.

The driver's tables hold no neurons; plans.forest derives them from events.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as G
from .functions import matrices
from .operators import edit, length, metrics, nodes, raster, shape, soma, tree
from .plans.forest import GOLD, PRED, forest
from .sources import swc

K = "neuron_id"
LOW, HIGH = (10, 50, 20), (200, 400, 250)
SHAPE = (300, 500, 600)
CENTER = (100.0, 200.0, 150.0)


def _round(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes))


_Q: dict[str, Callable[[DataFrame, Callable[[], DataFrame]], DataFrame]] = {
    "a1_summary": lambda n, p: nodes.summary(n),
    "f1_roots": lambda n, p: nodes.roots(n),
    "f4_roi": lambda n, p: nodes.in_roi(n, LOW, HIGH),
    "f5_cube": lambda n, p: nodes.in_cube(n, LOW, HIGH),
    "f8_branches": lambda n, p: nodes.branches(n),
    "f9_leaves": lambda n, p: nodes.leaves(n),
    "f9_leaves_isolated_roots": lambda n, p: nodes.leaves(n, True),
    "p1_rescale": lambda n, p: nodes.rescale(n, (1.0, 2.0, 0.5)),
    "p2_add_offset": lambda n, p: nodes.add_offset(n, (1.5, -2.0, 3.0)),
    "p3_rotate_z": lambda n, p: nodes.rotate_z(n, (10.0, 20.0), 30.0),
    "p14_transform": lambda n, p: nodes.transform(n, matrices.rotation_matrix(0.5235987755982988, (0, 0, 1), (10, 20, 0))),
    "j1_edges": lambda n, p: nodes.edges(n),
    "j2_children": lambda n, p: nodes.children(n).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ",")),
    "j8_close_pairs": lambda n, p: nodes.close_pairs(n, 25.0),
    "k1_swc_lines": lambda n, p: swc.lines(n, 2),
    "s1_parse": lambda n, p: swc.parse(swc.lines(n, 2).withColumn("ord", F.col("id"))).drop("ord"),
    "k5_crop": lambda n, p: nodes.crop(n, LOW, HIGH),
    "w5_reindex": lambda n, p: nodes.reindex(n.where("id % 3 <> 2")),
    "w9_father_path": lambda n, p: nodes.father_path(n).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ",")),
    "u1_merge": lambda n, p: nodes.merge([n, p()]),
    "u2_remove_duplicates": lambda n, p: nodes.remove_duplicates(n.withColumns({c: F.floor(F.col(c) / 50).cast("double") for c in "xyz"})),
    "t1_rooted": lambda n, p: tree.rooted(n),
    "t4_fibers": lambda n, p: tree.fibers(n),
    "t8_components": lambda n, p: tree.components(n),
    "t9_subtrees": lambda n, p: tree.subtrees(n),
    "t16_lca": lambda n, p: tree.lca(n, n.where("id > 1").select(K, (F.col("id") - 1).alias("u"), F.col("id").alias("v"))),
    "t5_roi_fibers": lambda n, p: shape.roi_fibers(n, LOW, HIGH),
    "t13_rerooted": lambda n, p: shape.rerooted(n, n.groupBy(K).agg(F.max("id").alias("id"))),
    "t15_align_roots": lambda n, p: shape.align_roots(n, p().where("id % 9 = 4").select(K, "x", "y", "z"), 20.0),
    "t19_non_adjacent": lambda n, p: shape.non_adjacent_pairs(n, 40.0),
    "a8_density": lambda n, p: shape.density(n, 40.0),
    "t21_remove_nodes": lambda n, p: nodes.remove_nodes(n, n.where("id % 5 = 3").select(K, "id")),
    "t18_resample": lambda n, p: tree.resample(n, 20.0),
    "g9_turn_angles": lambda n, p: tree.turn_angles(n),
    "g7_segment_distance": lambda n, p: nodes.edges(n).select(K, "id", G.distance_to_segment((F.lit(100.0), F.lit(200.0), F.lit(150.0)), G.point(), G.point("p")).alias("d")),
    "m4_ssd": lambda n, p: metrics.ssd(n, p(), resampled=False),
    "m4_ssd_resampled": lambda n, p: metrics.ssd(n, p()),
    "m5_point": lambda n, p: metrics.point(n, p(), resample_step=None),
    "m5_point_resampled": lambda n, p: metrics.point(n, p()),
    "j6_distances": lambda n, p: metrics.distances(n, p()),
    "m6_keypoint": lambda n, p: metrics.keypoint(n, p()),
    "m7_length": lambda n, p: length.length(n, p(), 8.0, 0.2),
    "m11_fiber": lambda n, p: metrics.fiber(n, p()),
    "m13_batch": lambda n, p: metrics.batch(n, p()),
    "r1_line_voxels": lambda n, p: raster.line_voxels(n, SHAPE),
    "r2_sphere_voxels": lambda n, p: raster.sphere_voxels(n, SHAPE, 2.0),
    "r3_cone_voxels": lambda n, p: raster.cone_voxels(nodes.rescale(n, (0.1, 0.1, 0.1)), (30, 50, 60)),
    "r4_sphere_cone_voxels": lambda n, p: raster.sphere_cone_voxels(nodes.rescale(n, (0.1, 0.1, 0.1)), (30, 50, 60)),
    "r3_cone_voxels_full": lambda n, p: raster.cone_voxels(n, SHAPE),
    "r4_sphere_cone_voxels_full": lambda n, p: raster.sphere_cone_voxels(n, SHAPE),
    "t24_somas": lambda n, p: soma.somas(n),
    "t25_refine_somas": lambda n, p: soma.refine_somas(n, 20.0),
    "t2_preorder": lambda n, p: edit.preorder(n),
    "t3_node_list": lambda n, p: edit.node_list(n),
    "w8_nearest_nodes": lambda n, p: edit.nearest_nodes(n, p().where("id % 9 = 4").select(K, F.col("id").alias("point"), "x", "y", "z"), 3),
    "j7_in_ball": lambda n, p: edit.in_ball(n, CENTER, 150.0),
    "u5_shell": lambda n, p: edit.in_ball(n, CENTER, 150.0, 100.0),
    "f12_without_isolated": lambda n, p: edit.without_isolated(n),
    "f11_valid_edges": lambda n, p: edit.valid_edges(nodes.edges(n).select(K, F.col("id").alias("a"), F.col("parent").alias("b")), n.where("id % 4 <> 1")),
    "t10_subtree_leaves": lambda n, p: edit.subtree_leaves(n, n.where("id % 10 = 3").select(K, "id")),
    "t12_remove_subtrees": lambda n, p: edit.remove_subtrees(n, n.where("id % 10 = 3").select(K, "id")),
    "t22_remove_trees": lambda n, p: edit.remove_trees(n, edit.tree_roots(n, 2)),
    "t20_add_trees": lambda n, p: edit.add_nodes(n, n.withColumns({"id": F.col("id") + 100000, "parent": F.when(F.col("parent") == -1, F.lit(-1)).otherwise(F.col("parent") + 100000).cast("long")})),
    "t26_graph_components": lambda n, p: edit.graph_components(nodes.edges(n).select(K, F.col("id").alias("a"), F.col("parent").alias("b")), n.select(K, "id")),
    "a14_bounds": lambda n, p: edit.bounds(n),
    "u6_unmatched": lambda n, p: edit.unmatched(n.select(K, "id"), p().select(K, "id"), K, "id"),
    "k1_swc_text": lambda n, p: swc.text(n, 2, radius=0.5),
    "r8_adjacency": lambda n, p: raster.adjacency(raster.sphere_voxels(n, SHAPE, 2.0)),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: lambda spark, sf_dir, f=f: _round(f(forest(spark, sf_dir), lambda: forest(spark, sf_dir, PRED))) for name, f in _Q.items()}


_E = "e AS (SELECT n.*, p.x AS px, p.y AS py, p.z AS pz, sqrt((n.x - p.x) ** 2 + (n.y - p.y) ** 2 + (n.z - p.z) ** 2) AS length FROM n JOIN n p ON n.neuron_id = p.neuron_id AND n.parent = p.id)"
_KIDS = "kids AS (SELECT neuron_id, parent AS id, count(*) AS n_children FROM n WHERE parent <> -1 GROUP BY ALL)"
_ALL = "neuron_id, id, type, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, radius, parent"
_R = f"{_E}, r AS (SELECT neuron_id, id, id AS root_id, CAST(0 AS BIGINT) AS depth, CAST(0 AS DOUBLE) AS root_length FROM n WHERE parent = -1 UNION ALL SELECT e.neuron_id, e.id, r.root_id, r.depth + 1, r.root_length + e.length FROM r JOIN e ON r.neuron_id = e.neuron_id AND r.id = e.parent)"
_C = f"{_E}, c AS (SELECT neuron_id, id, id AS anc, CAST(0 AS BIGINT) AS dist FROM n UNION ALL SELECT c.neuron_id, c.id, e.parent, c.dist + 1 FROM c JOIN e ON c.neuron_id = e.neuron_id AND c.anc = e.id)"
_TURNED = """, up AS (SELECT c.neuron_id, c.anc AS id, c.dist, coalesce(lag(c.anc) OVER (PARTITION BY c.neuron_id, c.id ORDER BY c.dist), -1) AS parent FROM c JOIN a ON a.neuron_id = c.neuron_id AND a.id = c.id),
  t AS (SELECT n.neuron_id, n.id, n.type, n.x, n.y, n.z, n.radius, coalesce(up.parent, n.parent) AS parent, CASE WHEN up.dist > 0 THEN 0 ELSE n.id END AS place FROM n LEFT JOIN up ON n.neuron_id = up.neuron_id AND n.id = up.id)"""
_D = """d AS (SELECT g.neuron_id, 'gold' AS side, g.id, min(sqrt((g.x - p.x) ** 2 + (g.y - p.y) ** 2 + (g.z - p.z) ** 2)) AS d FROM n g LEFT JOIN q p ON g.neuron_id = p.neuron_id GROUP BY ALL
  UNION ALL SELECT p.neuron_id, 'pred', p.id, min(sqrt((g.x - p.x) ** 2 + (g.y - p.y) ** 2 + (g.z - p.z) ** 2)) FROM q p LEFT JOIN n g ON g.neuron_id = p.neuron_id GROUP BY ALL)"""
_BOX = {op: " AND ".join(f"{c} >= {a} AND {c} {op} {b}" for c, a, b in zip("xyz", LOW, HIGH, strict=True)) for op in ("<=", "<")}
_LINE = "printf('%d %d %.2f %.2f %.2f %.2f %d', id, type, x, y, z, radius, parent)"
_NUMBERED = "SELECT m.neuron_id, m.new_id AS id, m.type, {x}, m.radius, coalesce(u.new_id, -1) AS parent FROM m LEFT JOIN m u ON m.neuron_id = u.neuron_id AND m.parent = u.id"
_XYZ = "round(m.x, 4) AS x, round(m.y, 4) AS y, round(m.z, 4) AS z"
_SPHERE = f"""s AS (SELECT neuron_id, x, y, z, 2 * radius AS r FROM n), v AS (SELECT DISTINCT neuron_id, CAST(z.g AS INT) AS z, CAST(y.g AS INT) AS y, CAST(x.g AS INT) AS x
  FROM s, LATERAL (SELECT unnest(range(CAST(ceil(s.z - r) AS BIGINT), CAST(floor(s.z + r) AS BIGINT) + 1)) AS g) z, LATERAL (SELECT unnest(range(CAST(ceil(s.y - r) AS BIGINT), CAST(floor(s.y + r) AS BIGINT) + 1)) AS g) y,
  LATERAL (SELECT unnest(range(CAST(ceil(s.x - r) AS BIGINT), CAST(floor(s.x + r) AS BIGINT) + 1)) AS g) x
  WHERE (z.g - s.z) ** 2 + (y.g - s.y) ** 2 + (x.g - s.x) ** 2 <= r * r AND z.g >= 0 AND z.g < {SHAPE[0]} AND y.g >= 0 AND y.g < {SHAPE[1]} AND x.g >= 0 AND x.g < {SHAPE[2]})"""
_AXES = [(c, f"least(o{c} - big, o{c} + u{c} * len - big)", f"greatest(o{c} + big, o{c} + u{c} * len + big)") for c in "zyx"]
_CONE = f"""s1 AS (SELECT neuron_id, id, parent, x * 0.1 AS x, y * 0.1 AS y, z * 0.1 AS z, radius AS r FROM n),
  s2 AS (SELECT a.*, p.x AS px, p.y AS py, p.z AS pz, p.r AS pr, sqrt((a.x - p.x) ** 2 + (a.y - p.y) ** 2 + (a.z - p.z) ** 2) AS len FROM s1 a JOIN s1 p ON a.neuron_id = p.neuron_id AND a.parent = p.id),
  s3 AS (SELECT neuron_id, len, greatest(r, pr) AS big, least(r, pr) AS small, {", ".join(f"CASE WHEN r >= pr THEN {c} ELSE p{c} END AS o{c}, CASE WHEN r >= pr THEN p{c} - {c} ELSE {c} - p{c} END / len AS u{c}" for c in "xyz")} FROM s2 WHERE len > 0),
  s4 AS (SELECT s3.*, {", ".join(f"{c}.g AS {c}" for c in "zyx")} FROM s3, {", ".join(f"LATERAL (SELECT unnest(range(CAST(floor({a}) AS BIGINT), CAST(ceil({b}) AS BIGINT) + 1)) AS g) {c}" for c, a, b in _AXES)}),
  s5 AS (SELECT *, (x - ox) * ux + (y - oy) * uy + (z - oz) * uz AS h FROM s4),
  s6 AS (SELECT *, sqrt((x - ox - h * ux) ** 2 + (y - oy - h * uy) ** 2 + (z - oz - h * uz) ** 2) AS rho FROM s5 WHERE h >= 0 AND h <= len),
  k AS (SELECT DISTINCT neuron_id, CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM s6 WHERE rho <= big AND (rho <= small OR (big - rho) * len >= h * (big - small)) AND z >= 0 AND z < 30 AND y >= 0 AND y < 50 AND x >= 0 AND x < 60)"""
_BALL = f"""b AS (SELECT DISTINCT neuron_id, CAST(vz.g AS INT) AS z, CAST(vy.g AS INT) AS y, CAST(vx.g AS INT) AS x FROM s1, {", ".join(f"LATERAL (SELECT unnest(range(CAST(ceil({c} - r) AS BIGINT), CAST(floor({c} + r) AS BIGINT) + 1)) AS g) v{c}" for c in "zyx")}
  WHERE (vz.g - s1.z) ** 2 + (vy.g - s1.y) ** 2 + (vx.g - s1.x) ** 2 <= r * r AND vz.g >= 0 AND vz.g < 30 AND vy.g >= 0 AND vy.g < 50 AND vx.g >= 0 AND vx.g < 60)"""
_SQL = {
    "r3_cone_voxels": f"{_CONE} SELECT * FROM k",
    "r4_sphere_cone_voxels": f"{_CONE}, {_BALL} SELECT * FROM k UNION SELECT * FROM b",
    "a1_summary": f"{_E} SELECT s.*, round(coalesce(l.length, 0), 4) AS length FROM (SELECT neuron_id, count(*) AS n_nodes, count(*) FILTER (parent <> -1) AS n_edges, max(id) + 1 AS next_id, count(*) FILTER (parent = -1) AS n_roots, "
    + ", ".join(f"round({a}({c}), 4) AS {a}_{c}" for a in ("min", "max") for c in "xyz")
    + " FROM n GROUP BY neuron_id) s LEFT JOIN (SELECT neuron_id, sum(length) AS length FROM e GROUP BY neuron_id) l ON s.neuron_id = l.neuron_id",
    "f1_roots": f"SELECT {_ALL} FROM n WHERE parent = -1",
    "f4_roi": f"SELECT {_ALL} FROM n WHERE {_BOX['<=']}",
    "f5_cube": f"SELECT {_ALL} FROM n WHERE {_BOX['<']}",
    "f8_branches": f"{_KIDS} SELECT {_ALL} FROM n WHERE parent <> -1 AND (neuron_id, id) IN (SELECT (neuron_id, id) FROM kids WHERE n_children > 1)",
    "f9_leaves": f"{_KIDS} SELECT {_ALL} FROM n WHERE (neuron_id, id) NOT IN (SELECT (neuron_id, id) FROM kids)",
    "f9_leaves_isolated_roots": f"{_KIDS} SELECT {_ALL} FROM n WHERE (neuron_id, id) NOT IN (SELECT (neuron_id, id) FROM kids) OR parent = -1 AND (neuron_id, id) IN (SELECT (neuron_id, id) FROM kids WHERE n_children = 1)",
    "p1_rescale": "SELECT neuron_id, id, type, round(x * 1.0, 4) AS x, round(y * 2.0, 4) AS y, round(z * 0.5, 4) AS z, radius, parent FROM n",
    "p2_add_offset": "SELECT neuron_id, id, type, round(x + 1.5, 4) AS x, round(y - 2.0, 4) AS y, round(z + 3.0, 4) AS z, radius, parent FROM n",
    "p3_rotate_z": "SELECT neuron_id, id, type, round(10 + (x - 10) * cos(radians(30)) - (y - 20) * sin(radians(30)), 4) AS x, round(20 + (x - 10) * sin(radians(30)) + (y - 20) * cos(radians(30)), 4) AS y, round(z, 4) AS z, radius, parent FROM n",
    "j1_edges": f"{_E} SELECT neuron_id, id, parent, type, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, round(px, 4) AS px, round(py, 4) AS py, round(pz, 4) AS pz, round(length, 4) AS length FROM e",
    "j2_children": "SELECT neuron_id, parent AS id, string_agg(id, ',' ORDER BY id) AS children FROM n WHERE parent <> -1 GROUP BY neuron_id, parent",
    "j8_close_pairs": "SELECT a.neuron_id, a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 4) AS dist FROM n a JOIN n b ON a.neuron_id = b.neuron_id AND a.id < b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 25",
    "k1_swc_lines": f"SELECT neuron_id, id, {_LINE} AS line FROM n",
    "s1_parse": "SELECT neuron_id, id, type, CAST(printf('%.2f', x) AS DOUBLE) AS x, CAST(printf('%.2f', y) AS DOUBLE) AS y, CAST(printf('%.2f', z) AS DOUBLE) AS z, CAST(printf('%.2f', radius) AS DOUBLE) AS radius, parent FROM n",
    "k5_crop": f"m AS (SELECT *, row_number() OVER (PARTITION BY neuron_id ORDER BY id) AS new_id FROM n WHERE {_BOX['<']}) " + _NUMBERED.format(x=f"round(m.x - {LOW[0]}, 4) AS x, round(m.y - {LOW[1]}, 4) AS y, round(m.z - {LOW[2]}, 4) AS z"),
    "w5_reindex": "m AS (SELECT *, row_number() OVER (PARTITION BY neuron_id ORDER BY id) AS new_id FROM n WHERE id % 3 <> 2) " + _NUMBERED.format(x=_XYZ),
    "w9_father_path": f"{_C} SELECT neuron_id, id, string_agg(anc, ',' ORDER BY dist) AS path FROM c WHERE dist < 5 GROUP BY neuron_id, id",
    "u1_merge": "b AS (SELECT *, 0 AS src FROM n UNION ALL SELECT *, 1 FROM q), m AS (SELECT *, row_number() OVER (PARTITION BY neuron_id ORDER BY src, id) AS new_id FROM b) " + _NUMBERED.format(x=_XYZ) + " AND m.src = u.src",
    "u2_remove_duplicates": "f AS (SELECT neuron_id, id, type, floor(x / 50) AS x, floor(y / 50) AS y, floor(z / 50) AS z, radius, parent FROM n), k AS (SELECT *, min(id) OVER (PARTITION BY neuron_id, x, y, z) AS kept FROM f) "
    "SELECT k.neuron_id, k.id, k.type, k.x, k.y, k.z, k.radius, CASE WHEN u.kept IS NULL OR u.kept = k.id THEN -1 ELSE u.kept END AS parent FROM k LEFT JOIN k u ON k.neuron_id = u.neuron_id AND k.parent = u.id WHERE k.id = k.kept",
    "t1_rooted": f"{_R} SELECT neuron_id, id, root_id, depth, round(root_length, 4) AS root_length FROM r",
    "t4_fibers": f"{_R}, {_KIDS} SELECT r.neuron_id, r.id AS leaf_id, r.root_id, o.type AS root_type, n.type AS leaf_type, r.depth + 1 AS n_nodes, round(r.root_length, 4) AS length FROM r JOIN n ON r.neuron_id = n.neuron_id AND r.id = n.id JOIN n o ON r.neuron_id = o.neuron_id AND r.root_id = o.id WHERE r.depth > 0 AND (r.neuron_id, r.id) NOT IN (SELECT (neuron_id, id) FROM kids)",
    "t8_components": f"{_R} SELECT neuron_id, root_id, count(*) AS n_nodes, max(depth) AS depth FROM r GROUP BY neuron_id, root_id",
    "t9_subtrees": f"{_C} SELECT c.neuron_id, c.anc AS id, count(*) AS n_nodes, round(coalesce(sum(e.length), 0), 4) AS length FROM c LEFT JOIN e ON c.neuron_id = e.neuron_id AND c.id = e.id GROUP BY c.neuron_id, c.anc",
    "t16_lca": f"{_C} SELECT n.neuron_id, n.id - 1 AS u, n.id AS v, coalesce(min_by(a.anc, a.dist) FILTER (b.anc IS NOT NULL), -1) AS lca FROM n JOIN c a ON a.neuron_id = n.neuron_id AND a.id = n.id - 1 LEFT JOIN c b ON b.neuron_id = n.neuron_id AND b.id = n.id AND b.anc = a.anc WHERE n.id > 1 GROUP BY n.neuron_id, n.id",
    "t18_resample": f"""{_R}, {_KIDS}, w0 AS (SELECT n.*, r.root_length AS s, n.parent = -1 OR coalesce(kids.n_children, 0) <> 1 AS is_key FROM n JOIN r ON n.neuron_id = r.neuron_id AND n.id = r.id LEFT JOIN kids ON n.neuron_id = kids.neuron_id AND n.id = kids.id),
      w AS (SELECT neuron_id, id AS tail, id, parent FROM w0 WHERE is_key AND parent <> -1 UNION ALL SELECT w.neuron_id, w.tail, w0.id, w0.parent FROM w JOIN w0 ON w.neuron_id = w0.neuron_id AND w.parent = w0.id AND NOT w0.is_key),
      seg AS (SELECT w.neuron_id, w.tail, w.id, w.parent, b.type, b.x, b.y, b.z, b.radius, a.x AS px, a.y AS py, a.z AS pz, a.radius AS pradius, a.s - min(a.s) OVER (PARTITION BY w.neuron_id, w.tail) AS s0, b.s - min(a.s) OVER (PARTITION BY w.neuron_id, w.tail) AS s1
        FROM w JOIN w0 b ON w.neuron_id = b.neuron_id AND w.id = b.id JOIN w0 a ON w.neuron_id = a.neuron_id AND w.parent = a.id),
      pos AS (SELECT seg.*, unnest(range(CAST(greatest(ceil(s0 / 20), 1) AS BIGINT), CAST(ceil((s1 - CASE WHEN id = tail THEN 1e-6 ELSE 0 END) / 20) AS BIGINT))) AS k FROM seg UNION ALL SELECT seg.*, NULL FROM seg WHERE id = tail),
      pt AS (SELECT *, CASE WHEN k IS NULL THEN 1 ELSE (k * 20 - s0) / (s1 - s0) END AS t, row_number() OVER (PARTITION BY neuron_id, k IS NULL ORDER BY tail, k) AS num FROM pos),
      nu AS (SELECT pt.*, CASE WHEN k IS NULL THEN tail ELSE num + (SELECT max(id) FROM n WHERE n.neuron_id = pt.neuron_id) END AS new_id FROM pt),
      st AS (SELECT neuron_id, tail, min_by(parent, s0) AS start FROM seg GROUP BY ALL)
      SELECT nu.neuron_id, new_id AS id, type, round(px + (x - px) * t, 4) AS x, round(py + (y - py) * t, 4) AS y, round(pz + (z - pz) * t, 4) AS z, round(pradius + (radius - pradius) * t, 4) AS radius, coalesce(lag(new_id) OVER (PARTITION BY nu.neuron_id, nu.tail ORDER BY k NULLS LAST), start) AS parent
      FROM nu JOIN st ON nu.neuron_id = st.neuron_id AND nu.tail = st.tail UNION ALL SELECT {_ALL} FROM n WHERE parent = -1""",
    "t5_roi_fibers": f"""{_C}, {_KIDS}, f AS (SELECT c.neuron_id, c.id AS leaf_id, max(c.dist) OVER (PARTITION BY c.neuron_id, c.id) AS last, last - c.dist AS pos, n.id, n.x, n.y, n.z FROM c JOIN n ON n.neuron_id = c.neuron_id AND n.id = c.anc WHERE (c.neuron_id, c.id) NOT IN (SELECT (neuron_id, id) FROM kids)),
      g AS (SELECT *, pos - row_number() OVER (PARTITION BY neuron_id, leaf_id ORDER BY pos) AS run FROM f WHERE last > 0 AND {_BOX["<="]})
      SELECT neuron_id, leaf_id, min(pos) AS pos, count(*) AS n_nodes, min_by(id, pos) AS first_id, max_by(id, pos) AS last_id FROM g GROUP BY neuron_id, leaf_id, run HAVING count(*) > 1 OR max(pos) < max(last)""",
    "t13_rerooted": f"{_C}, a AS (SELECT neuron_id, max(id) AS id FROM n GROUP BY neuron_id){_TURNED} SELECT neuron_id, id, type, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, radius, parent FROM t",
    "t15_align_roots": f"""{_C}, near AS (SELECT q.neuron_id, n.id, sqrt((n.x - q.x) ** 2 + (n.y - q.y) ** 2 + (n.z - q.z) ** 2) AS d, row_number() OVER (PARTITION BY q.neuron_id, q.id ORDER BY d, n.id) AS place FROM q JOIN n ON q.neuron_id = n.neuron_id WHERE q.id % 9 = 4),
      best AS (SELECT neuron_id, id, min(d) AS d FROM near WHERE place = 1 AND d <= 20 GROUP BY ALL),
      tops AS (SELECT best.neuron_id, best.id, best.d, arg_max(c.anc, c.dist) AS root FROM best JOIN c ON best.neuron_id = c.neuron_id AND best.id = c.id GROUP BY best.neuron_id, best.id, best.d),
      a AS (SELECT * FROM tops QUALIFY row_number() OVER (PARTITION BY neuron_id, root ORDER BY d, id) = 1){_TURNED},
      o AS (SELECT t.*, CAST(0 AS BIGINT) AS depth, [CAST(0 AS BIGINT)] AS path, coalesce(a.d, 'inf'::DOUBLE) AS d, t.id AS root FROM t LEFT JOIN a ON t.neuron_id = a.neuron_id AND t.id = a.id WHERE t.parent = -1
        UNION ALL SELECT t.*, o.depth + 1, list_append(o.path, t.place), o.d, o.root FROM o JOIN t ON t.neuron_id = o.neuron_id AND t.parent = o.id),
      m AS (SELECT *, row_number() OVER (PARTITION BY neuron_id ORDER BY d, root, depth, path) AS new_id FROM o) {_NUMBERED.format(x=_XYZ)}""",
    "t19_non_adjacent": f"{_C}, w AS (SELECT neuron_id, id, list(anc) AS path FROM c WHERE dist < 10 GROUP BY ALL) SELECT * FROM (SELECT a.neuron_id, a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 4) AS dist FROM n a JOIN n b ON a.neuron_id = b.neuron_id AND a.id < b.id JOIN w u ON u.neuron_id = a.neuron_id AND u.id = a.id JOIN w v ON v.neuron_id = b.neuron_id AND v.id = b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) < 40 AND NOT list_has_any(u.path, v.path)) WHERE neuron_id IN (SELECT neuron_id FROM n GROUP BY 1 HAVING count(*) > 2)",
    "t21_remove_nodes": "SELECT neuron_id, id, type, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z, radius, CASE WHEN parent % 5 = 3 THEN -1 ELSE parent END AS parent FROM n WHERE id % 5 <> 3",
    "m4_ssd": f"{_D} SELECT neuron_id, round(a, 4) AS sd_gt2pred, round(b, 4) AS sd_pred2gt, round(s, 4) AS ssd_gt2pred, round(t, 4) AS ssd_pred2gt, round(w, 4) AS ssd_percent, round((a + b) / 2, 4) AS sd, round((s + t) / 2, 4) AS ssd FROM (SELECT neuron_id, avg(d) FILTER (side = 'gold') AS a, avg(d) FILTER (side = 'pred') AS b, coalesce(avg(d) FILTER (side = 'gold' AND d > 2), 0) AS s, coalesce(avg(d) FILTER (side = 'pred' AND d > 2), 0) AS t, avg(CASE WHEN d > 2 THEN 1.0 ELSE 0.0 END) AS w FROM d GROUP BY neuron_id)",
    "m5_point": f"""{_D}, c AS (SELECT neuron_id, count(*) FILTER (side = 'gold') AS num_gt, count(*) FILTER (side = 'pred') AS num_pred, count(*) FILTER (side = 'pred' AND d < 4) AS TP, count(*) FILTER (side = 'pred' AND NOT coalesce(d < 4, false)) AS FP, count(*) FILTER (side = 'gold' AND NOT coalesce(d < 4, false)) AS FN FROM d GROUP BY neuron_id),
      s AS (SELECT *, coalesce(TP / nullif(num_pred, 0), 0) AS p, coalesce((num_gt - FN) / nullif(num_gt, 0), 0) AS r, coalesce((num_gt - FN) / nullif(num_gt + FP, 0), 0) AS m FROM c)
      SELECT neuron_id, num_gt, num_pred, TP, FP, FN, round(p, 4) AS precision, round(r, 4) AS recall, round(m, 4) AS MES, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 4) AS f1 FROM s""",
    "j6_distances": f"{_D} SELECT neuron_id, side, id, round(d, 4) AS d FROM d",
    "r2_sphere_voxels": f"{_SPHERE} SELECT * FROM v",
    "r8_adjacency": f"{_SPHERE}, o AS (SELECT i.g AS i, j.g AS j, k.g AS k FROM (SELECT unnest([-1, 0, 1]) AS g) i, (SELECT unnest([-1, 0, 1]) AS g) j, (SELECT unnest([-1, 0, 1]) AS g) k WHERE (i.g, j.g, k.g) > (0, 0, 0)) "
    "SELECT a.neuron_id, b.z, b.y, b.x, a.z AS az, a.y AS ay, a.x AS ax FROM (SELECT * FROM v, o) a JOIN v b ON a.neuron_id = b.neuron_id AND a.z + i = b.z AND a.y + j = b.y AND a.x + k = b.x",
}


_PATH = "o AS (SELECT neuron_id, id, [{s} * id] AS way FROM n WHERE parent = -1 UNION ALL SELECT n.neuron_id, n.id, list_append(o.way, {s} * n.id) FROM o JOIN n ON n.neuron_id = o.neuron_id AND n.parent = o.id) SELECT neuron_id, id, row_number() OVER (PARTITION BY neuron_id ORDER BY way) AS place FROM o"
_FROM_CENTER = "sqrt(" + " + ".join(f"({c} - {v}) ** 2" for c, v in zip("xyz", CENTER, strict=True)) + ")"
_BELOW = "b AS (SELECT neuron_id, id AS top, id FROM n WHERE id % 10 = 3 UNION ALL SELECT n.neuron_id, b.top, n.id FROM b JOIN n ON n.neuron_id = b.neuron_id AND n.parent = b.id)"
_FOOT = "t AS (SELECT e.*, (({0} - x) * (px - x) + ({1} - y) * (py - y) + ({2} - z) * (pz - z)) / nullif((px - x) ** 2 + (py - y) ** 2 + (pz - z) ** 2, 0) AS u FROM e), f AS (SELECT *, x + u * (px - x) AS fx, y + u * (py - y) AS fy, z + u * (pz - z) AS fz, u >= 0 AND u <= 1 AS inside FROM t)".format(*CENTER)
_END = lambda a: f"sqrt(({CENTER[0]} - {a}x) ** 2 + ({CENTER[1]} - {a}y) ** 2 + ({CENTER[2]} - {a}z) ** 2)"
_SQL |= {
    "t2_preorder": _PATH.format(s=1),
    "t3_node_list": _PATH.format(s=-1),
    "w8_nearest_nodes": "d AS (SELECT q.neuron_id, q.id AS point, n.id, sqrt((n.x - q.x) ** 2 + (n.y - q.y) ** 2 + (n.z - q.z) ** 2) AS dist, row_number() OVER (PARTITION BY q.neuron_id, q.id ORDER BY dist, n.id) AS rank FROM q JOIN n ON q.neuron_id = n.neuron_id WHERE q.id % 9 = 4) SELECT neuron_id, point, id, CAST(rank AS INT) AS rank, round(dist, 4) AS dist FROM d WHERE rank <= 3",
    "j7_in_ball": f"SELECT {_ALL} FROM n WHERE {_FROM_CENTER} <= 150",
    "u5_shell": f"SELECT {_ALL} FROM n WHERE {_FROM_CENTER} <= 150 AND {_FROM_CENTER} > 100",
    "f12_without_isolated": f"{_KIDS} SELECT {_ALL} FROM n WHERE parent <> -1 OR (neuron_id, id) IN (SELECT (neuron_id, id) FROM kids)",
    "f11_valid_edges": "SELECT neuron_id, id AS a, parent AS b FROM n WHERE parent <> -1 AND id % 4 <> 1 AND parent % 4 <> 1",
    "t10_subtree_leaves": f"{_BELOW}, {_KIDS} SELECT b.neuron_id, top, b.id FROM b JOIN n ON b.neuron_id = n.neuron_id AND b.id = n.id WHERE n.parent <> -1 AND (b.neuron_id, b.id) NOT IN (SELECT (neuron_id, id) FROM kids)",
    "t12_remove_subtrees": f"{_BELOW} SELECT {_ALL} FROM n WHERE (neuron_id, id) NOT IN (SELECT (neuron_id, id) FROM b)",
    "t22_remove_trees": f"{_R} SELECT n.neuron_id, n.id, n.type, round(n.x, 4) AS x, round(n.y, 4) AS y, round(n.z, 4) AS z, n.radius, n.parent FROM n JOIN r ON n.neuron_id = r.neuron_id AND n.id = r.id WHERE r.root_id % 2 = 1",
    "t20_add_trees": f"SELECT {_ALL} FROM n UNION ALL SELECT neuron_id, id + 100000, type, round(x, 4), round(y, 4), round(z, 4), radius, CASE WHEN parent = -1 THEN -1 ELSE parent + 100000 END FROM n",
    "t26_graph_components": f"{_R} SELECT neuron_id, id, min(id) OVER (PARTITION BY neuron_id, root_id) AS component FROM r",
    "a14_bounds": "SELECT neuron_id, " + ", ".join(f"round({f}({c} {s} radius), 4) AS {f}_{c}" for f, s in (("min", "-"), ("max", "+")) for c in "xyz") + " FROM n GROUP BY neuron_id",
    "u6_unmatched": "SELECT neuron_id, id FROM n WHERE (neuron_id, id) NOT IN (SELECT (neuron_id, id) FROM q)",
    "k1_swc_text": f"h AS (SELECT DISTINCT neuron_id FROM n) SELECT neuron_id, CAST(1 AS BIGINT) AS ord, '{swc.HEADER[0]}' AS line FROM h UNION ALL SELECT neuron_id, 2, '{swc.HEADER[1]}' FROM h UNION ALL SELECT neuron_id, row_number() OVER (PARTITION BY neuron_id ORDER BY id) + 2, {_LINE.replace('radius', '0.5')} FROM n",
    "g7_segment_distance": f"{_E}, {_FOOT} SELECT neuron_id, id, round(CASE WHEN inside THEN {_END('f')} ELSE least({_END('')}, {_END('p')}) END, 4) AS d FROM f",
    "g9_turn_angles": f"{_E}, w AS (SELECT e.neuron_id, e.id, c.id AS child, (e.x - e.px) * (c.x - e.x) + (e.y - e.py) * (c.y - e.y) + (e.z - e.pz) * (c.z - e.z) AS dot, e.length * c.length AS size FROM e JOIN e c ON e.neuron_id = c.neuron_id AND e.id = c.parent) SELECT neuron_id, id, child, round(degrees(acos(greatest(-1, least(1, dot / size)))), 4) AS angle FROM w",
    "r1_line_voxels": f"{_E}, s AS (SELECT e.*, CAST(floor(length) AS INT) + 1 AS m FROM e), v AS (SELECT s.*, k.g AS k FROM s, LATERAL (SELECT unnest(range(s.m + 1)) AS g) k), w AS (SELECT DISTINCT neuron_id, "
    + ", ".join(f"CAST(round_even({c} + (p{c} - {c}) * (k / m), 0) AS INT) AS {c}" for c in "zyx")
    + f" FROM v) SELECT * FROM w WHERE z >= 0 AND z < {SHAPE[0]} AND y >= 0 AND y < {SHAPE[1]} AND x >= 0 AND x < {SHAPE[2]}",
}
_SQL["m4_ssd"] = _SQL["m4_ssd"].replace("coalesce(avg(d) FILTER (side = 'gold' AND d > 2), 0)", "CASE WHEN count(d) > 0 THEN coalesce(avg(d) FILTER (side = 'gold' AND d > 2), 0) END").replace("coalesce(avg(d) FILTER (side = 'pred' AND d > 2), 0)", "CASE WHEN count(d) > 0 THEN coalesce(avg(d) FILTER (side = 'pred' AND d > 2), 0) END").replace("avg(CASE WHEN d > 2 THEN 1.0 ELSE 0.0 END)", "CASE WHEN count(d) > 0 THEN avg(CASE WHEN d > 2 THEN 1.0 ELSE 0.0 END) END")
_SQL["p14_transform"] = _SQL["p3_rotate_z"]


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in _SQL.items():
        head = f"WITH RECURSIVE n AS ({GOLD}), q AS ({PRED})"
        out[name] = f"{head} {sql}" if sql.startswith("SELECT") else f"{head}, {sql}"
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all pairs by metric."""
    return queries()["m13_batch"](spark, sf_dir)
