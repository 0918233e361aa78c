import random
import zlib

import numpy as np
import pytest

from strandframe.llm import common, langid


def brute_force(potential, transitions):
    """Posteriors by enumeration of all label sequences."""
    steps, k = potential.shape
    post, total = np.zeros((steps, k)), 0.0
    for n in range(k**steps):
        tags = [n // k**s % k for s in range(steps)]
        p = np.exp(sum(potential[s, t] for s, t in enumerate(tags)) + sum(transitions[a, b] for a, b in zip(tags, tags[1:])))
        total += p
        for s, t in enumerate(tags):
            post[s, t] += p
    return post / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    potential, transitions = rng.normal(size=(4, 5, 3)), rng.normal(size=(3, 3))
    post, pairs = langid.forward_backward(potential, transitions, pairs=True)
    for p, own in zip(potential, post, strict=True):
        assert np.allclose(own, brute_force(p, transitions))
    assert np.isclose(pairs.sum(), 4 * 4)


@pytest.fixture(scope="module")
def model(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    return langid.fit(docs)


def test_held_out_accuracy(spark, model):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    langs = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(langs)
    assert all(g["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= g["score"] <= 1 for i, g in got.items())
    unseen = [g["lang_pred"] == langs[i] for i, g in got.items() if g["held_out"]]
    assert len(unseen) > 100 and np.mean(unseen) > 0.97


def test_code_switched_words(spark, model):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents").where(langid.held_out()).where("n_chars > 800").select("text", "lang").collect()
    r = random.Random(1)
    hits = []
    for _ in range(30):
        a, b = r.choice(docs), r.choice(docs)
        words = a["text"].split()[:40] + b["text"].split()[:40]
        post, lettered = langid.Labeller(model).label([" ".join(words)])[0]
        want = [a["lang"]] * 40 + [b["lang"]] * 40
        hits += [model.langs[p] == w for p, w, ok in zip(post.argmax(1), want, lettered, strict=True) if ok]
    assert np.mean(hits) > 0.9


def test_result_does_not_depend_on_batches(model):
    texts = ["the thing " * 500, "", None, "123 !!", "der die das " * 40, "la que de"]
    together = langid.Labeller(model).predict(texts)
    assert together == [langid.Labeller(model).predict([t])[0] for t in texts]
    assert [p for p, _ in together][1:4] == ["und"] * 3


def test_odd_tables(spark, model):
    df = spark.createDataFrame([(1, None, "en", 1.0), (2, "́ 12 \t", None, 1.0), (None, "the of and", "en", 1.0), (2, "the of and", "en", 1.0), (2, "the of and", "en", 1.0)], "doc_id long, text string, lang string, score double")
    got = langid.predict(df, model, words=True).collect()
    assert len(got) == 5 and sorted(g["lang_pred"] for g in got)[-2:] == ["und", "und"]
    assert [g["words"] for g in got if g["doc_id"] is None] == [["en"] * 3]
    assert langid.predict(df.limit(0), model).collect() == []
    none = langid.fit(df.where("lang is null"))
    assert {r["lang_pred"] for r in langid.predict(df, none).collect()} == {"und"}
