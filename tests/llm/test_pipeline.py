import random

import corpus_pipeline
from dendrica.llm import lines


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))


def test_line_dedup_spares_no_line_outside_of_true_copies(spark):
    rng = random.Random(3)
    shared = [_words(rng, 12) for _ in range(4)]
    own = [_words(rng, 12) for _ in range(40)]
    base = own[:20]
    rows = [
        (1, "\n".join([shared[0], shared[1], *own[20:26]])),
        (2, "\n".join([shared[2], shared[3], *own[26:32]])),
        # Two of its three lines stand in 1 and 2, but it is a copy of neither.
        (3, "\n".join([shared[0], shared[2], own[32]])),
        (4, "\n".join(base)),
        # A copy of 4 with a line of its own; that line's only other holder must keep it.
        (5, "\n".join([*base, own[33]])),
        (6, "\n".join([own[33], *own[34:38]])),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.line_dedup(spark, docs, "")
    got = {r.doc_id: r.text for r in out.collect()}
    text = dict(rows)
    assert got == {i: text[i] for i in (1, 2, 4, 6)} | {3: own[32]}
    assert lines.repeated_lines(out).isEmpty()
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, out, "").collect()}
    assert left == {1, 2, 3, 4, 6}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, shard string"


def _documents(spark, path):
    """Every edge: null, empty and long texts, repeated rows, a null id, copies, near copies, secrets, junk, columns of clashing names."""
    rng = random.Random(8)
    good = lambda n=8: "\n".join(_words(rng, 9) for _ in range(n))
    base = good(30)
    texts = [(i, good()) for i in range(20)]
    texts += [(20, base), (21, base), (22, base.replace(base.split()[3], "changed")), (23, None), (24, ""), (25, "too short"), (26, "# " * 50 + _words(rng, 30)), (27, "again and " * 60)]
    texts += [(28, good() + "\npassword = hunter2hunter2"), (None, good()), (29, texts[0][1]), (30, texts[1][1].split("\n")[0] + "\n" + good()), (31, " ".join(_words(rng, 9) for _ in range(2500)))]
    rows = [(i, t, "en", "s", len(t or ""), 1, "x") for i, t in texts]
    df = spark.createDataFrame([*rows, rows[2], rows[2]], SCHEMA)
    df.write.parquet(f"{path}/documents.parquet")
    return df


def test_whole_pipeline_on_every_edge(spark, tmp_path):
    docs = _documents(spark, f"file://{tmp_path}")
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, now, "").write.parquet(f"file://{tmp_path}/{name}")
        now = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert now.columns == docs.columns
        steps[name] = {r.doc_id: r for r in now.collect()}
    assert set(docs.toPandas().doc_id.dropna()) - set(steps["quality_rules"]) == {23, 24, 25, 26, 27}
    lined = steps["line_dedup"]
    assert {21, 22, 29} & set(lined) == set() and {0, 20, 28, 30, 31, None} <= set(lined)
    assert lined[30].text.count("\n") == 7 and lined[30].n_chars == len(lined[30].text) and len(lined[31].text) > 150_000
    assert set(steps["near_duplicates"]) == set(lined)
    clean = steps["secrets"][28].text
    assert "hunter2" not in clean and "[secret]" in clean and steps["secrets"][5].text == lined[5].text
    from dendrica.llm import tokens

    tok = tokens.word_ids(tokens.default_path()).tok
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    want = sorted((str(i), len(tok.encode(r.text, add_special_tokens=False).ids) + 1) for i, r in steps["secrets"].items())
    got = {}
    for r in packed:
        got[str(r.doc_id)] = got.get(str(r.doc_id), 0) + r.length
    assert sorted(got.items()) == want
    whole = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted((str(r.doc_id), r.start, r.length) for r in whole) == sorted((str(r.doc_id), r.start, r.length) for r in packed)


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
