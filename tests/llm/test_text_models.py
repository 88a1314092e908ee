import zlib

import numpy as np
from pyspark.sql import functions as F

from shizuku.llm import langid, quality

EN = "the river was high and the boat had to wait for the tide to turn before it could pass under the bridge".split()
DE = "der fluss war hoch und das boot musste auf die flut warten bevor es unter der brücke durchfahren konnte".split()
EL = "το ποτάμι ήταν ψηλό και η βάρκα περίμενε την παλίρροια για να περάσει κάτω από τη γέφυρα".split()


def speak(words, n, k=0):
    return " ".join(words[(i * 7 + k) % len(words)] for i in range(n))


def model(spark):
    rows = [(i * 3 + j, speak(w, 40, i), lang) for i in range(20) for j, (w, lang) in enumerate(((EN, "en"), (DE, "de"), (EL, "el")))]
    return langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")


def test_language_of_odd_texts(spark):
    m = model(spark)
    assert m.langs == ["de", "el", "en"]
    texts = [None, "", "123 --- !!", speak(EN, 30), speak(DE, 30).upper(), speak(EL, 5), "中文字符", speak(EN, 30) + "\n" + speak(DE, 12) + " " + speak(EN, 9), speak(DE, 60_000)]
    got = list(langid.label(m, texts))
    assert [x[0] for x in got] == ["und", "und", "und", "en", "de", "el", m.langs[m.common], "en", "de"]
    assert got[6][1] == 0.0 and all(0 <= x[1] <= 1 for x in got)
    spans = got[7][2]
    assert [s[0] for s in spans] == ["en", "de", "en"] and spans[1][1:] == (30, 12)


def test_spans_match_a_plain_viterbi(spark):
    rng = np.random.default_rng(1)
    scores, starts = rng.normal(size=(60, 3)).astype(np.float32) * 3, np.array([0, 0, 25, 26, 60])
    got = langid.viterbi(scores, starts, 2.0)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if a == b:
            continue
        best = {(k,): float(scores[a, k]) for k in range(3)}
        for t in range(a + 1, b):
            step = {}
            for k in range(3):
                path, v = max(((p, v - (2.0 if p[-1] != k else 0)) for p, v in best.items()), key=lambda x: x[1])
                step[(*path, k)] = v + float(scores[t, k])
            best = step
        assert list(max(best, key=best.get)) == got[a:b].tolist()


def test_identify_keeps_columns_and_empty_tables(spark):
    m = model(spark)
    df = spark.createDataFrame([(1, speak(EN, 9), "x", 1), (1, speak(EN, 9), "x", 1), (2, None, None, 1)], "doc_id long, text string, words string, lang_score int")
    out = langid.identify(df, m).collect()
    assert sorted((r.doc_id, r.words or "", r.lang_pred) for r in out) == [(1, "x", "en"), (1, "x", "en"), (2, "", "und")]
    assert langid.identify(df.limit(0), m).count() == 0
    empty = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}


def test_held_out_language(spark):
    from shizuku.llm.queries import op3_language_id

    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = op3_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(held) > 0.98


def test_quality_separates_held_out_labels(spark):
    from shizuku.llm.queries import op8_quality_rank

    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = op8_quality_rank(spark, d).collect()
    held = [(r.score, truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, q, _ in held if q == 1], [s for s, q, _ in held if q == 0]
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([p == q for _, q, p in held]) > 0.9


def test_quality_of_odd_texts(spark):
    raw = np.array([quality.features(speak(EN, 20 + i, i)) for i in range(60)] + [quality.features("*** ### " * (5 + i)) for i in range(20)])
    m = quality.fit(raw, np.array([1] * 60 + [0] * 20))
    s = m.score(np.array([quality.features(x) for x in (None, "", "a", speak(EN, 50_000), "### *** " * 30, speak(EN, 33))]))
    assert s[0] == s[1] and ((s >= 0) & (s <= 1)).all() and s[5] > s[4]
    assert (quality.fit(raw, np.ones(80)).score(raw) == 0.5).all()
    df = spark.createDataFrame([(1, None, 1.0, "q"), (1, None, 1.0, "q"), (2, speak(EN, 9), 2.0, "q")], "doc_id long, text string, score double, quality_score string")
    out = quality.rank(df, m).collect()
    assert len(out) == 3 and {r.score for r in out} == {1.0, 2.0}
    assert quality.rank(df.limit(0), m).count() == 0


def test_training_is_bounded(spark):
    rows = [(i, speak(EN, 10, i), "en") for i in range(50)] + [(None, "x", "en"), (99, None, "en"), (98, "y", None)]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("x", F.lit(1)), "text", "lang", "doc_id", most=7)
    assert m.langs == ["en"]


def test_fits_are_bounded_by_rows_whose_ids_repeat(spark):
    rows = [(1, f"the cat number {i} sat down", "en", i % 2) for i in range(30)] + [(1, "the cat sat", "en", 1)] * 30 + [(None, "null id", "en", 0), (2, "der hund lief weg", "de", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    model = langid.train(df, "text", "lang", "doc_id", most=5)
    assert model.langs and set(model.langs) <= {"de", "en"}
    seen = []
    original = quality.fit
    try:
        quality.fit = lambda raw, label, **how: seen.append((len(raw), sorted(label))) or original(raw, label, **how)
        quality.train(df, "text", "quality", "doc_id", most=7)
        quality.train(df, "text", "quality", "doc_id", most=1000)
    finally:
        quality.fit = original
    assert seen[0][0] <= 7 and seen[1][0] == 32  # 30 texts, one that repeats, one of another id; a null id is no id


def test_identification_is_the_same_in_blocks_of_any_size(spark, monkeypatch):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund lief in den wald", "de")], "doc_id long, text string, lang string")
    model = langid.train(df, "text", "lang", "doc_id")
    texts = ["the cat ran", None, "", "der hund", "12 34", "the mat der wald the cat " * 40]
    whole = list(langid.label(model, texts))
    monkeypatch.setattr(langid, "TOGETHER", 1)
    assert list(langid.label(model, texts)) == whole
