import collections
import random
import re

import numpy as np
import pytest

from lookthru.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    marked = [False] * len(words)
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            marked[i] = marked[i + 1] = marked[i + 2] = True
    base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, sum(marked))
    return (*base, base[0] < 50 or 100 * base[4] > 50 * base[0])


def rows(df):
    return [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()]


def test_base_statistics_equal_brute_force(spark, data, odd):
    given = spark.read.parquet(f"{data}/documents.parquet")
    for docs in (given, odd):
        want = sorted((str(r.doc_id), *brute(r.text)) for r in docs.collect())
        assert sorted((str(r[0]), *r[1:]) for r in rows(quality.op1_quality(docs))) == want


def test_small_groups_keep_all_and_failed_texts_go(odd):
    for r in quality.op1_quality(odd).collect():
        assert r.kept == (not r.base_failed)


def test_outliers_go_and_usual_texts_stay(spark, make):
    rng = random.Random(3)
    rows = [(i, make(rng, rng.randint(50, 400)), rng.choice(["en", "de"]), None if i % 3 else "hot") for i in range(900)]
    rows += [(1000 + i, " ".join(w + "###$" for w in make(rng, 120).split()), "en", None) for i in range(150)]
    got = {r.doc_id: r.kept for r in quality.op1_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(900)) and not any(got[1000 + i] for i in range(150))


def test_estimates_resist_a_third_of_outliers(spark):
    rng = np.random.default_rng(1)
    scatter = np.array([[1, .5, 0, 0], [.5, 1, 0, 0], [0, 0, 2, 0], [0, 0, 0, .5]]) * 4
    good = rng.multivariate_normal([1, 2, 3, 4], scatter, 4000)
    bad = rng.normal(40, 1, (1800, 4))
    df = spark.createDataFrame([("g", *map(float, r)) for r in np.concatenate([good, bad])], "g string, x0 double, x1 double, x2 double, x3 double")
    r = quality.mcd(df).first()
    assert np.abs(np.array(r["mean"]) - [1, 2, 3, 4]).max() < 0.2
    found = np.linalg.inv(np.array(r["inverse"]).reshape(4, 4))
    assert np.abs(found - scatter).max() < 0.8


def test_quantiles():
    assert quality.quantile(0.975) == pytest.approx(11.1433, abs=1e-3)
    assert quality.quantile(0.5) == pytest.approx(3.3567, abs=1e-3)


def test_keep_good_keeps_columns_and_empty_tables(odd):
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(r.doc_id) for r in odd.collect() if not brute(r.text)[-1])
    assert quality.op1_quality(odd.limit(0)).collect() == []


def test_repeats_alone_are_rejected(spark, make):
    rng = random.Random(12)
    rows = [(i, make(rng, rng.randint(60, 400)), "en", "web") for i in range(400)]
    lines = [(1000 + i, "\n".join(f"lomine\nlomine\n{make(rng, 1)}{k}" for k in range(60)), "en", "web") for i in range(3)]
    blocks = [make(rng, 90) for _ in range(3)]
    words = [(2000 + i, " ".join([make(rng, 110), b, make(rng, 110), b]), "en", "web") for i, b in enumerate(blocks)]
    got = {r.id: r for r in quality.judge(spark.createDataFrame(rows + lines + words, "doc_id long, text string, lang string, source string")).collect()}
    for i in (1000, 1001, 1002):
        assert got[i].n_dup_lines == 119 and got[i].n_repeat_words == 0 and not got[i].base_failed and not got[i].kept
    for i in (2000, 2001, 2002):
        assert got[i].n_dup_lines == 0 and got[i].n_repeat_words >= 180 and not got[i].base_failed and not got[i].kept
    assert all(got[i].kept for i in range(400))
