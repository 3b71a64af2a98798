import random

import pytest

from dendrica.llm import jaccard


def prose(rng, n):
    return " ".join(rng.choice(["river", "stone", "quiet", "lamp", "over", "walks", "Green", "paper", "slow", "tide", "moon", "field"]) + rng.choice(["", "s", ",", "er"]) for _ in range(n))


def brute(rows, size, percent):
    """id: (set size by text, least id reachable); ids may repeat."""
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()))
    of = {i: i for i, _ in sets if i is not None}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    known = [(i, s) for i, s in sets if i is not None and s]
    for x, (i, s) in enumerate(known):
        for j, t in known[x + 1 :]:
            if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) and 100 * (n := len(s & t)) >= percent * (len(s) + len(t) - n):
                a, b = sorted((top(i), top(j)))
                of[b] = a
    return sorted(((str(i), len(s), str(top(i)) if i is not None else "None") for i, s in sets))


def rows_of(seed=8, groups=6, each=25):
    rng = random.Random(seed)
    base = prose(rng, 120)
    rows = [(0, base), (1, base), (2, base.replace("river", "rivers", 1)), (3, None), (4, ""), (5, "one two"), (None, "no id here"), (None, base), (6, "One two"), (7, "same row twice"), (7, "same row twice"), (8, "two rows"), (8, base), (9, "two rows"), (30, prose(rng, 20000)), (31, "x" * 50000)]
    for g in range(groups):
        words = prose(rng, rng.randint(30, 120)).split()
        for i in range(each):
            w = list(words)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(40)}"
            rows.append((1000 + g * 100 + i, " ".join(w[: len(w) - rng.randint(0, 8)])))
    return rows


def got(spark, rows, size, percent, kind="long"):
    df = spark.createDataFrame([(i, t, None, 1) for i, t in rows], f"doc_id {kind}, text string, n string, __id int")
    out = jaccard.classes(df, size, percent)
    assert out.schema["component_id"].dataType == df.schema["doc_id"].dataType
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out.collect())


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80), (1, 50)])
def test_against_brute_force(spark, size, percent):
    rows = rows_of()
    assert got(spark, rows, size, percent) == brute(rows, size, percent)


def test_without_an_order_by_frequency(spark, monkeypatch):
    """Passages shared by unlike texts stand in prefixes then, and most pairs of a list are of different classes."""
    monkeypatch.setattr(jaccard, "COMMON", 0)
    rng = random.Random(3)
    shared = prose(rng, 14)
    rows = rows_of(9, 4, 30) + [(5000 + i, " ".join([*(f"u{rng.randrange(10**6)}" for _ in range(25)), shared, *(f"u{rng.randrange(10**6)}" for _ in range(20))])) for i in range(2000)]
    assert got(spark, rows, 4, 85) == brute(rows, 4, 85)


def test_ids_of_other_types(spark):
    rows = [(None if i is None else f"id-{i:05}", t) for i, t in rows_of(5, 3, 12)]
    assert got(spark, rows, 5, 80, "string") == brute(rows, 5, 80)
    assert got(spark, [], 5, 80) == [] == got(spark, [], 5, 80, "string")
