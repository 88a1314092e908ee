import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mix", "pack"]


def test_stages_take_effect(spark, sf_dir):
    from pyspark.sql import functions as F

    passage = " ".join(f"p{i}" for i in range(60))
    text = " ".join(f"unique{i}" for i in range(80))
    rows = [(1, f"one {passage} start", "en"), (2, passage, "en"), (3, f"two\n{passage}", "en"), (4, text, "en"), (5, text + " more", "en"), (6, "12 34 !!", "en"), (7, None, None), (8, "", "de"), (9, "kurz", "de")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumn("extra", F.lit("size"))
    out = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == corpus_pipeline.COLUMNS
        out[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(out["language"]) == {1, 2, 3, 4, 5, 9}
    assert out["lines"][3] == "two" and out["lines"][2] == passage
    assert not {2, 5} & set(out["near_duplicates"]) and {1, 3, 4, 9} <= set(out["near_duplicates"])
    assert set(out["mix"]) <= set(out["near_duplicates"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {p.doc_id for p in pieces} == set(out["mix"])


def test_near_duplicates_of_rows_that_share_an_id_or_have_none(spark, sf_dir):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one), (1, one), (1, two), (2, two + " x"), (None, one + " y"), (None, "all alone here " * 3), (None, None), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(((r.doc_id, r.text) for r in out), key=str) == sorted([(1, one), (1, two), (None, "all alone here " * 3), (None, None), (None, None), (3, "")], key=str)


def brute_stages(rows):
    """Language (a letter), near duplicates by all pairs, for rows (doc_id, text): the ids that stay after each, given what the stage before kept."""
    import unicodedata

    from test_duplicates import brute

    lettered = [(i, t) for i, t in rows if t and any(unicodedata.category(c)[0] == "L" for c in t)]
    return {i for i, _ in lettered}, lambda left: {int(k) for k, _, c in brute(left, 5) if k == c}


def test_stages_equal_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lettered, distinct = brute_stages([(r.doc_id, r.text) for r in docs.collect()])
    kept = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert {r.doc_id for r in kept.collect()} == lettered
    clean = corpus_pipeline.drop_repeated_lines(spark, kept, sf_dir)
    texts = [(r.doc_id, r.text) for r in clean.collect()]
    assert {i for i, _ in texts} == lettered
    left = corpus_pipeline.drop_near_duplicates(spark, clean, sf_dir).collect()
    assert {r.doc_id for r in left} == distinct(texts) and {(r.doc_id, r.text) for r in left} <= set(texts)
    mixed = corpus_pipeline.mix_sources(spark, clean.filter(clean.doc_id.isin([r.doc_id for r in left])), sf_dir).collect()
    pieces = corpus_pipeline.pack_sequences(spark, spark.createDataFrame(mixed, clean.schema), sf_dir).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in mixed} and sum(p.piece == 0 for p in pieces) == len(mixed)


def test_runs_on_documents(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert rows and all(0 < r.length <= 4096 for r in rows)


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
