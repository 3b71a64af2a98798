import numpy as np

from dendrica import catalog
from dendrica.operators import metrics

NODES = "neuron_id long, id long, type int, x double, y double, z double, radius double, parent long"


def test_near_equals_brute_force():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (40, 3), (200, 333), (0, 4), (4, 0)):
        p, q = np.cumsum(rng.normal(size=(n, 3)), 0), np.cumsum(rng.normal(size=(m, 3)), 0)
        for reach in (0.5, 3.0):
            assert (metrics.near(p, q, reach) == (metrics.nearest_distance(p, q) <= reach)).all()


def _lines(spark, moved):
    """Of each neuron a straight edge of 100 units, moved aside."""
    return spark.createDataFrame([(1, i, 2, 100.0 * (i - 1), moved, 0.0, 1.0, -1 if i == 1 else 1) for i in (1, 2)], NODES)


def test_registered_fiber_queries_compare_as_the_presets_do(spark):
    for query, column in (("m11_fiber", "TP"), ("m13_batch", "TP")):
        for moved, hits in ((0.0, 1), (4.0, 1), (8.0, 0)):
            rows = catalog._Q[query](_lines(spark, 0.0), lambda m=moved: _lines(spark, m)).collect()
            assert [r[column] for r in rows if query == "m11_fiber" or r.metric == "fiber"] == [hits]


def test_metrics_compare_points_along_edges(spark):
    gold, pred = _lines(spark, 0.0), spark.createDataFrame([(1, 1, 2, 0.0, 0.0, 0.0, 1.0, -1), (1, 2, 2, 50.0, 0.0, 0.0, 1.0, 1)], NODES)
    (r,) = metrics.point(gold, pred).collect()
    # Of the 51 points of gold, 0, 2 .. 100, those up to 52 are nearer than 4.
    assert (r.num_gt, r.num_pred, r.TP, r.FN) == (51, 26, 26, 51 - 27)
    (s,) = metrics.ssd(gold, pred).collect()
    assert abs(s.sd_gt2pred - sum(range(2, 51, 2)) / 51) < 1e-6 and s.sd_pred2gt == 0
    p, keys = np.array([(0, 0, 0), (3, 0, 0), (9, 0, 0), (10, 0, 0)], float), np.array([True, False, True, True])
    assert metrics.chained(p, keys, 2.0)[:, 0].tolist() == [0, 2, 4, 6, 8, 9, 10]


def test_batch_has_the_default_metrics(spark):
    rows = {r.metric: r for r in metrics.batch(_lines(spark, 0.0), _lines(spark, 1.0)).collect()}
    assert set(rows) == {"ssd", "length", "keypoint", "fiber"}
    assert rows["ssd"].TP is None and rows["ssd"].f1_score is None and abs(rows["ssd"].sd - 1) < 1e-6
    assert rows["length"].sd is None and abs(rows["length"].TP - 100) < 1e-3 and rows["fiber"].n_pairs == 1


def test_cones_of_the_whole_forest_equal_brute_force(spark):
    at = [(1, 20.3, 30.7, 12.1, 2.5, -1), (2, 220.2, 60.1, 140.6, 0.5, 1), (3, 230.0, 110.0, 150.0, 1.0, 2)]
    n = spark.createDataFrame([(1, i, 2, x, y, z, r, p) for i, x, y, z, r, p in at], NODES)
    by = {i: (np.array([z, y, x]), r) for i, x, y, z, r, _ in at}
    cones, balls = set(), set()
    for i, *_, parent in at:
        (a, ra) = by[i]
        box = lambda lo, hi: np.stack(np.meshgrid(*(np.arange(int(u), int(v) + 1) for u, v in zip(np.floor(lo), np.ceil(hi), strict=True)), indexing="ij"), -1).reshape(-1, 3)
        v = box(a - ra, a + ra)
        balls |= set(map(tuple, v[((v - a) ** 2).sum(1) <= ra * ra].tolist()))
        if parent == -1:
            continue
        (b, rb), size = by[parent], 0
        a, ra, b, rb = (a, ra, b, rb) if ra >= rb else (b, rb, a, ra)
        size = np.linalg.norm(b - a)
        v = box(np.minimum(a, b) - ra, np.maximum(a, b) + ra)
        h = (v - a) @ ((b - a) / size)
        rho = np.linalg.norm(v - a - h[:, None] * ((b - a) / size), axis=1)
        cones |= set(map(tuple, v[(h >= 0) & (h <= size) & (rho <= ra + (rb - ra) * h / size)].tolist()))
    for query, want in (("r3_cone_voxels_full", cones), ("r4_sphere_cone_voxels_full", cones | balls)):
        inside = {v for v in want if all(0 <= c < m for c, m in zip(v, catalog.SHAPE, strict=True))}
        assert {(r.z, r.y, r.x) for r in catalog._Q[query](n, None).collect()} == inside
