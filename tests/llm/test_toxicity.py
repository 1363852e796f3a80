"""Toxicity: features by brute force, held-out rows, odd inputs."""

import random
import zlib

import numpy as np

from freshet.llm import toxicity

random.seed(6)
WORDS = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


def test_features_are_character_ngrams_of_lower_case(monkeypatch):
    texts = ["ÄÖÜ Straße", None, "äöü STRASSE", "abc", "", "x" * 30, "İstanbul 한국어 \U0001f600"]
    whole = toxicity.present(texts)
    grams = [{t[k : k + n] for n in toxicity.LENGTHS for k in range(len(t) - n + 1)} for t in ((t or "").lower() for t in texts)]
    assert [(whole[0] == i).sum() for i in range(len(texts))] == [len(g) for g in grams]
    shared = lambda a, b: len(np.intersect1d(whole[1][whole[0] == a], whole[1][whole[0] == b]))
    assert shared(0, 2) == len(grams[0] & grams[2]) > 0
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, toxicity.present(texts)))


def test_scores_are_the_models(spark):
    texts = [prose(60) + (" YOU utter Nincompoop " if i % 4 == 0 else "") + prose(5) for i in range(400)]
    data = [(i, t, "zz", 9.0) for i, t in enumerate(texts)] + [(7, texts[7], "zz", 9.0), (None, texts[0], "zz", 9.0), (1000, prose(60_000), "zz", 9.0)]
    docs = spark.createDataFrame(data, "doc_id long, text string, score string, id double")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None), (1001, 1)], "doc_id long, toxic int")
    got = toxicity.toxic_scores(docs, labels).collect()
    assert len(got) == len(data)
    model = toxicity.train(docs, labels)
    want = dict(zip([d[0] for d in data], model.score([d[1] for d in data])))
    for r in got:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == held and abs(r["score"] - want[r["doc_id"]]) < 1e-12 and r["predicted"] == int(r["score"] >= 0.5)
    seen = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert np.mean([r["predicted"] for r in seen if r["doc_id"] % 4 == 0]) > 0.9 and np.mean([r["predicted"] for r in seen if r["doc_id"] % 4]) < 0.05
    clean = toxicity.without_toxic(docs, labels)
    assert clean.columns == docs.columns and {r["score"] for r in clean.select("score").collect()} == {"zz"}


def test_one_class_or_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {(r["predicted"], r["score"] < 0.5) for r in toxicity.toxic_scores(docs, none).collect()} == {(0, True)}
    ones = spark.createDataFrame([(i, 1) for i in (1, 2)], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.toxic_scores(docs, ones).collect()} == {1}
    assert toxicity.toxic_scores(docs.limit(0), none).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, prose(10)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    rows = []

    def fit(texts, y):
        rows.append((len(texts), sum(len(t.encode()) for t in texts)))
        return toxicity.Model(toxicity._no_features(), np.zeros(1), 0.0)

    real, toxicity.fit = toxicity.fit, fit
    try:
        toxicity.train(docs, labels, train_rows=12)
        toxicity.train(docs, labels, train_bytes=300)
    finally:
        toxicity.fit = real
    assert rows[0][0] == 12 and rows[1][1] <= 300
