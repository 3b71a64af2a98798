import itertools

import duckdb
import numpy as np
import pytest

import dendrica.catalog as catalog
from dendrica.operators import shape, soma
from dendrica.operators.length import Tree, matched
from dendrica.operators.metrics import assign, fiber_iou
from dendrica.sources import swc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["a1_summary", "f8_branches", "j8_close_pairs", "k5_crop", "t1_rooted", "t4_fibers", "t16_lca", "m4_ssd", "m5_point", "u2_remove_duplicates", "t18_resample", "t5_roi_fibers", "t13_rerooted", "t15_align_roots", "t19_non_adjacent", "r3_cone_voxels"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.execute(catalog.oracle_sql()[name]).df()
    got = catalog.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    rows = lambda df: sorted(tuple(round(float(v), 4) + 0.0 if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 5), (5, 3), (6, 6)):
        cost = rng.random((n, m))
        r, c = assign(cost)
        small, big = min(n, m), max(n, m)
        square = cost if n <= m else cost.T
        best = min(sum(square[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert len(set(r)) == len(set(c)) == small and abs(cost[r, c].sum() - best) < 1e-9


def test_fiber_iou_of_itself_is_near_one():
    p = np.cumsum(np.ones((30, 3)), 0)
    assert fiber_iou(p, p, 0.5, 3.0) > 0.95


def test_swc_rules(spark):
    text = ["# head", "1 1 0 0 0 1 -1", "2 2 1 0 0 1 1", "2 3 2 0 0 1 1", "3 2 1 1 1 1 2 9", ""]
    lines = spark.createDataFrame([("a", i, x) for i, x in enumerate(text)], "neuron_id string, ord long, line string")
    assert {(r.id, r.type, r.ord) for r in swc.parse(lines).collect()} == {(1, 1, 1), (2, 3, 2)}
    with pytest.raises(Exception, match="repeated id"):
        swc.parse(lines, "strict").collect()


def test_nearest_unrelated_equals_brute_force():
    rng = np.random.default_rng(1)
    p, parent = rng.random((40, 3)), np.array([-1, *(rng.integers(0, i) for i in range(1, 40))])
    hop = np.eye(40, dtype=bool)
    hop[np.arange(1, 40), parent[1:]] = hop[parent[1:], np.arange(1, 40)] = True
    for hops in (1, 2):
        d = np.where(np.linalg.matrix_power(hop.astype(int), hops) > 0, np.inf, np.linalg.norm(p[:, None] - p, axis=2))
        assert np.allclose(shape.nearest_unrelated(p, parent, hops), d.min(1))


def test_density_of_parallel_lines_and_of_a_single_node(spark):
    rows = [(1, 10 * line + i, 2, 10.0 * i, 5.0 * line, 0.0, 1.0, -1 if i == 1 else 10 * line + i - 1) for line in (0, 1) for i in range(1, 9)] + [(2, 1, 1, 0.0, 0.0, 0.0, 1.0, -1)]
    n = spark.createDataFrame(rows, "neuron_id long, id long, type int, x double, y double, z double, radius double, parent long")
    got = {r.neuron_id: r.density for r in shape.density(n, 10.0).collect()}
    assert abs(got[1] - 0.75) < 1e-9 and got[2] == 0


def _line(points, first=1):
    return Tree(np.arange(first, first + len(points)), np.array([-1, *range(first, first + len(points) - 1)]), np.array(points, float))


def test_length_metric_of_equal_moved_and_doubled_forests():
    a = _line([(0, 0, 0), (10, 0, 0), (20, 0, 0), (30, 0, 0)])
    assert np.allclose(matched(a, a, 2, 0.2), (30, 30))
    fine = _line([(2 * i, 1, 0) for i in range(16)])
    own, found = matched(a, fine, 2, 0.2)
    assert own == 30 and abs(found - 30) < 1e-6
    assert matched(a, _line([(0, 5, 0), (30, 5, 0)]), 2, 0.2) == (0, 0)
    # Two gold edges in one place cannot both have the only edge there.
    two = Tree(np.array([1, 2, 3, 4]), np.array([-1, 1, -1, 3]), np.array([(0, 0, 0), (10, 0, 0), (0, 1, 0), (10, 1, 0)], float))
    assert np.allclose(matched(two, _line([(0, 0, 0), (10, 0, 0)]), 2, 0.2), (10, 10))
    assert matched(_line([(0, 0, 0)]), a, 2, 0.2) == (0, 0)


def test_least_ball_holds_all_points_and_is_least():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 5, 12):
        p = rng.normal(size=(n, 3))
        c, sq = soma.least_ball(p)
        sets = (x for k in range(1, min(n, 4) + 1) for x in itertools.combinations(p, k))
        want = min(s for m, s in map(soma._through, map(list, sets)) if all(((q - m) ** 2).sum() <= s + 1e-9 for q in p))
        assert all(((q - c) ** 2).sum() <= sq + 1e-9 for q in p) and abs(sq - want) < 1e-9


def test_somas(spark):
    #  Spokes: 2-3 straight and a turn to 4; 5 branches to 6 and 7; 8 is a leaf.
    at = {1: (0, 0, 0, -1), 2: (2, 0, 0, 1), 3: (10, 0, 0, 2), 4: (10, 5, 0, 3), 5: (-5, 0, 0, 1), 6: (-10, 1, 0, 5), 7: (-10, -1, 0, 5), 8: (0, 7, 0, 1), 9: (10, 9, 0, 4)}
    rows = [(1, i, 1 if i == 1 else 3, float(x), float(y), float(z), 1.0, p) for i, (x, y, z, p) in at.items()] + [(2, 1, 1, 0.0, 0.0, 0.0, 1.0, -1)]
    n = spark.createDataFrame(rows, "neuron_id long, id long, type int, x double, y double, z double, radius double, parent long")
    got = {r.end_id: sorted(r.inner) for r in soma.spokes(n).collect()}
    assert got == {4: [2, 3], 6: [5], 7: [5], 8: []}
    (ball,) = soma.somas(n).collect()
    c, sq = soma.least_ball(np.array([at[i][:3] for i in got], float))
    assert np.allclose((ball.x, ball.y, ball.z, ball.radius**2), (*c, sq)) and ball.n_spokes == 4
    out = {r.id: r for r in soma.refine_somas(n, 3.0).where("neuron_id = 1").collect()}
    assert {1, 4, 6, 7, 8, 9} <= set(out) and not {2, 3, 5} & set(out) and np.allclose((out[1].x, out[1].y, out[1].z), c)
    for end in got:
        way, i = 0, end
        while (i := out[i].parent) != 1:
            way += 1
        assert way == max(0, int(np.linalg.norm(np.array(at[end][:3]) - c) // 3) - 1)
    assert out[9].parent == 4
