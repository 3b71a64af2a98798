import numpy as np

from dendrica.operators import length


def _tree(rng, n, step):
    up = np.array([-1, *(max(0, i - 1 - int(rng.integers(0, 3))) for i in range(1, n))])
    xyz = np.zeros((n, 3))
    for i in range(1, n):
        xyz[i] = xyz[up[i]] + rng.normal(size=3) * step
    return length.Tree(np.arange(1, n + 1), np.where(up < 0, -1, up + 1), xyz)


def test_edges_near_points_are_those_of_brute_force_and_few_are_tried(monkeypatch):
    rng = np.random.default_rng(3)
    tree, tried, real = _tree(rng, 900, 30.0), [], length.closest
    points = np.vstack([tree.xyz[::2] + rng.normal(size=(450, 3)) * 3, tree.xyz[:5]])
    edges = np.flatnonzero(tree.size > 0)
    want = []
    for p in points:
        feet = real(np.broadcast_to(p, (len(edges), 3)), tree.xyz[edges], tree.xyz[tree.up[edges]])
        d = np.sqrt(((feet - p) ** 2).sum(-1))
        want.append([(int(edges[k]), feet[k].tolist()) for k in np.argsort(d, kind="stable") if d[k] <= 8.0])
    monkeypatch.setattr(length, "closest", lambda p, a, b: (tried.append(np.broadcast(p, a).size // 3), real(p, a, b))[1])
    got = [[(e, foot.tolist()) for e, foot in x] for x in length.candidates(points, tree, 8.0)]
    assert got == want and max(map(len, want)) > 2 and sum(tried) < len(points) * len(edges) / 4
