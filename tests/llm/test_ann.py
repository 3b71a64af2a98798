import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from dendrica.llm import ann, queries

SCHEMA = "vec_id long, embedding array<double>, rank string, __row int"


def exact(data, is_query, k=10):
    """By brute force: for each query row, its id and the (distance, id) of its nearest."""
    out = []
    for i, (q, v) in enumerate(data):
        if is_query(q):
            near = sorted((float(np.sqrt(((np.array(v) - np.array(u)) ** 2).sum())), j) for n, (j, u) in enumerate(data) if n != i and len(u) == len(v))
            if near:
                out.append((q, near[:k]))
    return out


def by_query(rows):
    got = collections.defaultdict(list)
    for r in rows:
        got[r.query_id].append((r["rank"], r.score, r.vec_id))
    return {q: sorted(v) for q, v in got.items()}


def clustered(n=1500):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 32))
    data = [(i, (centres[i % 8] + 0.4 * rng.normal(size=32)).tolist()) for i in range(n)]
    return data + [(n + i, [0.5] * 32) for i in range(40)]


@pytest.mark.parametrize("block", [300, 4000])
def test_recall_and_exact_scores(spark, block, monkeypatch):
    monkeypatch.setattr(ann, "QUERIES", 5)
    data = clustered()
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in data], SCHEMA)
    got = by_query(ann.nearest(df, F.col("vec_id") % 100 == 0, block=block).collect())
    want = dict(exact(data, lambda i: i % 100 == 0))
    assert set(got) == set(want)
    hits = sum(len({j for _, j in want[q]} & {j for *_, j in got[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    vectors = {i: np.array(v) for i, v in data}
    for q, rows in got.items():
        assert [r for r, *_ in rows] == list(range(1, 11))
        assert all(s == float(np.sqrt(((vectors[q] - vectors[j]) ** 2).sum())) for _, s, j in rows)
    # Equal vectors go by their ids.
    assert [j for *_, j in got[1500]] == list(range(1501, 1511))


def test_edges(spark):
    good = [(i, [float(i % 7), 1.0, float(i)]) for i in range(200)]
    bad = [(9000, None), (9100, [0.0] * 3), (9200, [float("nan")] * 3), (9300, [None] * 3), (9400, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (9500, [])]
    # Of another length, first by id; one without a partner; a query's id repeated, with its vector and another.
    other = [(-100, [1.0]), (-99, [2.0]), (-98, [1.0]), (9600, [1.0, 2.0])]
    again = [(100, [100.0 % 7, 1.0, 100.0]), (100, [1.0, 1.0, 50.5])]
    df = spark.createDataFrame([(i, v, None, 1) for i, v in good + bad + other + again], SCHEMA)
    got = by_query(ann.nearest(df, F.col("vec_id") % 100 == 0, k=3).collect())
    want = collections.defaultdict(list)
    for q, near in exact(good + other + again, lambda i: i % 100 == 0, 3):
        want[q] += [(r + 1, s, j) for r, (s, j) in enumerate(near)]
    assert got == {q: sorted(v) for q, v in want.items()}
    assert [j for *_, j in got[-100]] == [-98, -99] and 9600 not in got and len(got[100]) == 9
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0 and ann.nearest(df, F.lit(False)).count() == 0
    with pytest.raises(ValueError):
        ann.nearest(df.withColumn("vec_id", F.col("vec_id").cast("string")), F.lit(True))


def test_blocks_are_skipped_and_less_than_half_is_verified():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 48))
    data = np.concatenate([c + 0.1 * rng.normal(size=(500, 48)) for c in centres])
    ids = np.arange(len(data))
    block = ann.Block(ids, ids, data)
    asked = ids[::100]
    found = block.grown(asked, data[asked], 10)
    assert block.verified < 0.3 * len(asked) * len(data)
    far = np.array([d[-1] for _, d in found])
    away = ann.Block(ids[:500], ids[:500], data[:500] + 5)
    assert all(not len(i) for i, _ in away.within(data[asked], far, 10)) and away.verified == 0


def test_recall_on_the_given_embeddings(spark):
    sf = "/root/testdata/sf0.1"
    got = by_query(queries.op4_nearest(spark, sf).collect())
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    v, ids = np.array([e for _, e in rows], float), np.array([i for i, _ in rows])
    hits = 0
    for n in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((v - v[n]) ** 2).sum(1))
        d[n] = np.inf
        hits += len(set(ids[np.lexsort((ids, d))[:10]].tolist()) & {j for *_, j in got[ids[n]]})
    assert hits >= 0.95 * 10 * len(got) and len(got) == (ids % 100 == 0).sum()
