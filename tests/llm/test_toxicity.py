import random
import zlib

import numpy as np
import pyarrow as pa

from lookthru.llm import toxicity
from lookthru.llm.text import NOT_WORD, Words


def test_held_out_rows_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.op7_toxicity(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.score, truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    ranks = np.argsort(np.argsort([h[0] for h in held])) + 1
    y = np.array([h[1] for h in held])
    auc = (ranks[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > 0.93 and np.mean([h[1] == h[2] for h in held]) > 0.95


def test_scores_depend_on_the_text_alone(spark, make, odd):
    rng = random.Random(1)
    rows = [(i, make(rng, 60) + (" vile rotten" if i % 4 == 0 else ""), "ab"[i % 2]) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), 1) for i in range(800)], "doc_id long, toxic int, id int")
    model = toxicity.train(docs, labels)
    new = spark.createDataFrame([(5000 + i, make(rng, 60) + (" Rotten, VILE" if i % 2 else ""), str(i)) for i in range(60)], "doc_id long, text string, lang string")
    got = {r.id: r.predicted for r in toxicity.score(new, model).collect()}
    assert sum(got[5000 + i] == i % 2 for i in range(60)) >= 58
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == odd.count() and len({r.score for r in scored if r.id in (1, 2, 3)}) == 1
    assert toxicity.score(odd.limit(0), model).collect() == []
    none = toxicity.train(docs, labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(odd, none).collect())


def test_whole_slices_score_like_single_texts():
    rng = np.random.default_rng(3)
    texts = ["", "a", "a b", "a b c", None, "one two three four five six", "x " * 500]
    p = toxicity._start([np.zeros((1, 3), np.int32), np.ones((1, 3), np.int32)], np.array([0, 1]), rng)
    p["E"][:] = rng.normal(0, 1, p["E"].shape)
    model = toxicity.Classifier(p, np.zeros((toxicity.ROWS, 2)), np.zeros(2))
    got = model.raw(Words(pa.array(texts), NOT_WORD, lower=True))[0]
    for text, score in zip(texts, got):
        h, _ = toxicity._pooled(p, toxicity.buckets(Words(pa.array([text]), NOT_WORD, lower=True)))
        assert abs(h @ p["v"] + p["c"] - score) < 1e-3


def test_threshold():
    assert 0.4 < toxicity._threshold(np.array([0.1, 0.4, 0.8, 0.9]), np.array([0, 0, 1, 1])) < 0.8
    assert toxicity._threshold(np.array([0.1, 0.9]), np.array([1, 0])) > 0.9


def test_thresholds_of_languages_lean_on_all_by_their_number():
    """The cut of 2 % of the rows is its own where they are many, and near the common one where they are few."""
    odds, y = np.array([-1.0, 1.0, 3.0]), np.array([0, 1, 1])
    assert toxicity._threshold(odds, y, np.array([50.0, 30.0, 1.0])) == 0.0
    own, every = (np.array([0.0, 2.0, 4.0]), np.array([0, 0, 1])), (np.array([-3.0, -1.0, 1.0]), np.array([0, 1, 1]))
    cut = lambda n: toxicity._threshold(np.append(own[0], every[0]), np.append(own[1], every[1]), np.append([n, n, n], [40.0, 40.0, 20.0]))
    assert cut(1.0) == -2.0 and cut(500.0) == 3.0


def test_a_small_language_gets_its_own_threshold(spark, make):
    """Toxic words of a rare language are said in clean texts of it too: only its threshold can tell. Labels clash and repeat."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(6000):
        rare = i % 50 == 0
        bad = i % 3 == 0
        words = [("q" if rare else "m") + make(rng, 1) for _ in range(40)]
        words += ["vile"] if bad or rare else []
        words += ["rotten", "nasty"] if rare and bad else []
        rows.append((i, " ".join(words), "xx" if rare else "en"))
        labels.append((i, int(bad)))
    labels += [(i, 0) for i in range(0, 6000, 3)] + [(None, 1), (7, None)]
    docs = spark.createDataFrame(rows + rows[:40], "doc_id long, text string, lang string")
    found = toxicity.op7_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = found.collect()
    assert len(got) == 6040
    for rare, least in ((False, 0.97), (True, 0.85)):
        own = [r for r in got if (r.doc_id % 50 == 0) == rare and r.held_out]
        assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in own]) > least
