import duckdb
import pytest

from dendrica import catalog
from dendrica.operators import edit, metrics, nodes
from dendrica.sources import swc

SF = "/root/testdata/sf0.001"
NODES = "neuron_id long, id long, type int, x double, y double, z double, radius double, parent long"
NEW = ["t2_preorder", "t3_node_list", "w8_nearest_nodes", "j7_in_ball", "u5_shell", "f12_without_isolated", "f11_valid_edges", "t10_subtree_leaves", "t12_remove_subtrees", "t22_remove_trees", "t20_add_trees", "t26_graph_components", "a14_bounds", "u6_unmatched", "k1_swc_text", "g7_segment_distance", "g9_turn_angles", "r1_line_voxels", "m4_ssd", "u1_merge"]


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda df: sorted(tuple(round(float(v), 4) + 0.0 if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def _chain(spark, n=3, neuron=1):
    return spark.createDataFrame([(neuron, i, 2, 10.0 * i, 0.0, 0.0, 1.0, i - 1 if i > 1 else -1) for i in range(1, n + 1)], NODES)


def test_text_written_to_and_read_from_files(spark, tmp_path):
    forest = _chain(spark, 4).unionByName(_chain(spark, 2, 7))
    swc.write_text(swc.text(forest, 6, places=edit.node_list(forest)), str(tmp_path / "out"))
    back = swc.read(spark, str(tmp_path / "out" / "*"))
    assert sorted((r.id, r.x, r.parent) for r in back.collect()) == sorted((r.id, r.x, r.parent) for r in forest.collect())
    with pytest.raises(Exception, match="absent parent"):
        swc.text(forest.where("id <> 2")).collect()


def test_adding_and_merging(spark):
    forest = _chain(spark)
    with pytest.raises(Exception, match="repeated id"):
        edit.add_nodes(forest, forest).collect()
    grown = edit.append_nodes(forest, forest.where("id = 1").drop("id").selectExpr("neuron_id", "type", "x", "y", "z", "radius", "3L AS parent"))
    assert [r.parent for r in grown.where("id = 4").collect()] == [3]
    assert nodes.merge([]).count() == 0 and nodes.merge([forest]).count() == 3
    with pytest.raises(Exception, match="absent parent"):
        nodes.merge([forest, forest.where("id > 1")]).collect()


def test_nearest_of_nothing(spark):
    forest = _chain(spark)
    points = forest.selectExpr("neuron_id + 1 AS neuron_id", "id AS point", "x", "y", "z")
    assert edit.nearest_nodes(forest, points).count() == 0 and edit.nearest_nodes(forest, points, 0).count() == 0
    far = forest.selectExpr("neuron_id", "id AS point", "x + 1000 AS x", "y", "z")
    assert {(r.id, r["rank"]) for r in edit.nearest_nodes(forest, far, 9).collect()} == {(3, 1), (2, 2), (1, 3)}


def test_metrics_of_an_empty_side_and_of_a_forest_with_itself(spark):
    forest = _chain(spark)
    (r,) = metrics.ssd(forest, forest.limit(0)).collect()
    assert r.ssd is None and r.ssd_percent is None and r.sd is None
    (k,) = metrics.keypoint(forest, forest).collect()
    assert k.f1 == 1
    turned = spark.createDataFrame([(1, i, 2, 10.0 * (4 - i), 0.0, 0.0, 1.0, i - 1 if i > 1 else -1) for i in (1, 2, 3)], NODES)
    assert [metrics.fiber(forest, turned, with_direction=d).first().TP for d in (False, True)] == [1, 0]
