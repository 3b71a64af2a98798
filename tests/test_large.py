"""What larger tables need: no nodes to the driver, no rows that grow faster than the input, kernels equal to brute force."""

import os

import numpy as np
import pytest

from dendrica import catalog
from dendrica.operators import arrays as A
from dendrica.operators import metrics

SF = "/root/testdata/sf0.001"


def _plan(spark, query):
    return catalog.queries()[query](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["j8_close_pairs", "w8_nearest_nodes", "t10_subtree_leaves", "t12_remove_subtrees", "t2_preorder", "t3_node_list", "r8_adjacency", "t16_lca", "t9_subtrees", "t18_resample", "t19_non_adjacent", "t15_align_roots", "t5_roi_fibers", "a8_density", "m4_ssd_resampled", "m5_point_resampled", "m11_fiber"])
def test_nothing_goes_to_the_driver_or_to_scratch(spark, query):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    assert "Broadcast" not in _plan(spark, query) and set(os.listdir(folder)) == before


def test_neighbours_hold_all_pairs_within_reach():
    rng = np.random.default_rng(5)
    p, q = rng.normal(size=(300, 3)) * (1, 50, 1e6), rng.normal(size=(250, 3)) * (1, 50, 1e6)
    q[:50] = p[:50] + 0.5
    for reach in (0.9, 30.0, 1e7):
        d = np.linalg.norm(p[:, None] - q, axis=2)
        got = [(i, j) for some in A.neighbours(p, q, reach) for i, j in zip(*some, strict=True)]
        assert len(got) == len(set(got)) and set(zip(*np.nonzero(d <= reach), strict=True)) <= set(got)
        nearest = A.nearest_distance(p, q)
        assert np.allclose(nearest, d.min(1), rtol=1e-12)


@pytest.mark.parametrize("query", ["r3_cone_voxels_full", "r4_sphere_cone_voxels_full", "r3_cone_voxels", "r1_line_voxels", "r4_sphere_cone_voxels", "r2_sphere_voxels"])
def test_voxels_are_made_and_told_apart_behind_the_last_exchange(spark, query):
    plan = _plan(spark, query)
    assert "Generate" not in plan and "FlatMapGroupsInArrow" in plan.split("Exchange")[0]


def test_overlaps_of_fibers_that_share_steps_equal_those_of_each_pair():
    rng = np.random.default_rng(6)
    trunk = np.cumsum(rng.normal(size=(20, 3)) * 8, 0)
    gold = [np.vstack([trunk[:k], trunk[k - 1] + np.cumsum(rng.normal(size=(6, 3)) * 8, 0)]) for k in (3, 9, 9, 15, 20)]
    pred = [x + rng.normal(size=x.shape) * 2 for x in gold[:4]] + [gold[4], gold[0][:1]]
    got = metrics.overlaps(gold, pred, 1.0, 5.0)
    assert np.allclose(got, [[metrics.overlap(a, b, 1.0, 5.0) for b in pred] for a in gold], rtol=1e-12, atol=1e-9) and (got > 0).sum() > 5


def test_shared_steps_are_compared_once(monkeypatch):
    trunk = np.cumsum(np.full((200, 3), 5.0), 0)
    lines = [np.vstack([trunk, trunk[-1] + [[k, 0, 0], [k, 9, 0]]]) for k in range(1, 21)]
    tried, real = [], A.distance
    monkeypatch.setattr(A, "distance", lambda p, q: (tried.append(len(p)), real(p, q))[1])
    assert np.allclose(np.diag(metrics.overlaps(lines, lines, 1.0, 5.0)), [metrics.polyline_length(x) for x in lines], rtol=0.01)
    # A tenth of what the 400 pairs would try one by one.
    assert sum(tried) < 400 * 2 * 1800 * 26 / 10


@pytest.mark.parametrize("moved", [0.0, 1.5, 300.0])
def test_nearest_distances_of_long_lines_try_few_pairs(monkeypatch, moved):
    line = np.cumsum(np.full((6000, 3), 1.0), 0)
    tried, real = [], A.distance
    monkeypatch.setattr(A, "distance", lambda p, q: (tried.append(len(p)), real(p, q))[1])
    d = A.nearest_distance(line, line + (moved, 0, 0))
    assert sum(tried) < len(line) ** 2 / 3 and np.allclose(d[::500], np.sqrt(((line[::500, None] - line - (moved, 0, 0)) ** 2).sum(-1).min(1)))


def test_batch_leaves_no_scratch(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(folder))
    assert _plan(spark, "m13_batch") and set(os.listdir(folder)) == before


@pytest.mark.parametrize("query", ["m4_ssd_resampled", "m5_point_resampled"])
def test_points_of_resampled_forests_stay_in_the_task_of_their_pair(spark, query):
    assert "Aggregate" not in _plan(spark, query).split("FlatMapCoGroups")[0]


def test_steps_are_compared_by_runs(monkeypatch):
    line = np.cumsum(np.full((400, 3), 5.0), 0)
    tried, real = [], A.distance
    monkeypatch.setattr(A, "distance", lambda p, q: (tried.append(len(p)), real(p, q))[1])
    got = metrics.overlaps([line], [line + 1.0], 1.0, 5.0)
    # 3456 steps each way, of which each has about ten points within reach.
    assert abs(got[0, 0] - metrics.polyline_length(line)) < 10 and sum(tried) < 2 * 3456 * 10 / 2


def test_overlaps_of_many_fibers_and_of_none_equal_those_of_each_pair():
    rng = np.random.default_rng(7)
    trunk = np.cumsum(rng.normal(size=(30, 3)) * 4, 0)
    gold = [np.vstack([trunk[: k % 30], rng.normal(size=(3, 3)) * 20]) for k in range(70)] + [trunk[:1], trunk[:9], trunk[:9], trunk[:12]]
    pred = [gold[k] + (k % 3) * 2 for k in range(0, 70, 9)] + [trunk, trunk[:0]]
    for g, p in ((gold, pred), (pred, gold), (gold[70:71], pred)):
        want = [[metrics.overlap(a, b, 1.0, 5.0) for b in p] for a in g]
        assert np.allclose(metrics.overlaps(g, p, 1.0, 5.0), want, rtol=1e-12, atol=1e-9)


def test_nearest_distances_of_points_without_near_ones_equal_brute_force():
    rng = np.random.default_rng(8)
    line = np.cumsum(rng.normal(size=(900, 3)), 0)
    a = np.vstack([line[:300] + 0.1, line[300:] + (40, 0, 0), line[::-7] * (1, -1, 3), rng.normal(size=(50, 3)) * 1e3])
    for p, q in ((a, line), (line, a), (a, line[:1])):
        assert np.allclose(A.nearest_distance(p, q), np.sqrt(((p[:, None] - q) ** 2).sum(-1)).min(1), rtol=1e-12)


def test_ssd_and_point_of_forests_without_a_side(spark):
    nodes = "neuron_id long, id long, type int, x double, y double, z double, radius double, parent long"
    some = spark.createDataFrame([(1, 1, 2, 0.0, 0.0, 0.0, 1.0, -1), (1, 2, 2, 9.0, 0.0, 0.0, 1.0, 1)], nodes)
    for resampled in (True, False):
        (r,) = metrics.ssd(some, some.where("id > 9"), resampled=resampled).collect()
        assert r.neuron_id == 1 and all(r[c] is None for c in metrics.DISTANCES)
        (r,) = metrics.ssd(some, some.where("id = 1"), resampled=resampled).collect()
        want = (sum(range(0, 9, 2)) + 9) / 6 if resampled else 4.5
        far = (4 + 6 + 8 + 9) / 4 if resampled else 9.0
        assert (r.sd_gt2pred, r.sd_pred2gt, r.ssd_gt2pred, r.ssd_pred2gt) == pytest.approx((want, 0, far, 0)) and r.ssd_percent == pytest.approx(4 / 7 if resampled else 1 / 3)
    (r,) = metrics.point(some.where("id > 9"), some).collect()
    assert (r.num_gt, r.num_pred, r.TP, r.FP, r.FN) == (0, 6, 0, 6, 0)


def test_batch_reads_each_forest_once_and_meets_all_metrics_in_one_task(spark):
    plan = _plan(spark, "m13_batch")
    assert plan.count("FileScan") == 2 and plan.count("FlatMapCoGroups") == 1 and "Broadcast" not in plan


def test_batch_equals_its_metrics(spark):
    nodes = catalog.forest(spark, SF), catalog.forest(spark, SF, catalog.PRED)
    names = ("ssd", "point", "length", "keypoint", "fiber")
    for collect in ("micro", "macro"):
        rows = {r.metric: r for r in metrics.batch(*nodes, names=names, collect=collect).collect()}
        for name in names:
            one = metrics.METRICS[name](*nodes).toPandas()
            assert rows[name].n_pairs == len(one)
            for c in metrics.DISTANCES if name == "ssd" else ("TP", "FP", "FN") if collect == "micro" else ("precision", "recall", "f1"):
                want = one[c].sum() if c in ("TP", "FP", "FN") else one[c].mean()
                assert rows[name]["f1_score" if c == "f1" else c] == pytest.approx(want, rel=1e-12)
