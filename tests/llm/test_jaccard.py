import random

import numpy as np
import pyarrow as pa
import pytest

from lookthru.llm import jaccard


def brute(rows):
    """{(id, text): (size, smallest id reachable)} of rows (id, text)."""
    texts = list({t for _, t in rows})
    sets = [frozenset(jaccard.shingle_set((t or "").encode())) for t in texts]
    group = list(range(len(texts)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 85 * max(len(a), len(b)) and 100 * len(a & b) >= 85 * len(a | b):
                group[top(i)] = top(j)
    own = {t: (len(s), top(i)) for i, (t, s) in enumerate(zip(texts, sets))}
    least = {}
    for i, t in rows:
        if i is not None:
            least[own[t][1]] = min(i, least.get(own[t][1], i))
    return {(i, t): (own[t][0], least.get(own[t][1]) if own[t][0] else i) for i, t in rows}


def check(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    got = jaccard.op13_jaccard(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *want[i, t])) for i, t in rows)


def test_query_equals_brute_force(spark, data):
    check(spark, spark.read.parquet(f"{data}/documents.parquet"))


def test_odd_and_empty_tables(spark, odd):
    check(spark, odd)
    assert jaccard.op13_jaccard(odd.limit(0)).collect() == []


def edited(rng, words, n, make):
    words = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = make(rng, 1)
        elif kind == 1:
            words.insert(at, make(rng, 1))
        elif len(words) > 5:
            del words[at]
    return words


def test_groups_of_near_copies_of_all_sizes(spark, make):
    """Copies with few and many changes, chains of copies, texts that share a passage only."""
    rng = random.Random(3)
    texts = []
    for size in (1, 3, 4, 8, 9, 10, 12, 20, 45, 90, 200, 700):
        source = make(rng, size).split()
        texts += [source] + [edited(rng, source, rng.randint(1, 1 + size // 40), make) for _ in range(12)]
        chain = source
        for _ in range(6):
            chain = edited(rng, chain, 1 + size // 60, make)
            texts.append(chain)
    passage = make(rng, 60)
    texts += [f"{make(rng, 30)} {passage} {make(rng, 25)}".split() for _ in range(30)]
    texts += [f"{passage} {make(rng, 6)}".split() for _ in range(30)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t) if i % 3 else " ".join(t).upper()) for i, t in enumerate(texts)]
    check(spark, spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("size", [6, 7, 8, 13, 14, 30, 60, 110, 140, 150, 247, 400, 1500])
def test_similar_sets_share_a_signature(size):
    """Every pair at the very threshold, over both sides of the band limits."""
    rng = np.random.default_rng(size)
    for _ in range(60):
        b = int(rng.integers(size, size * 100 // 85 + 1))
        inter = -(-85 * (size + b) // 185)  # the least that is similar
        if inter > size:
            continue
        x = rng.integers(0, 2**63, size).astype(np.uint64)
        y = np.concatenate((x[:inter], rng.integers(0, 2**63, b - inter).astype(np.uint64)))
        made = [set(), set()]
        for owner, sig in jaccard.signatures(np.concatenate((x, y)), np.array([size, b])):
            for i in (0, 1):
                made[i] |= set(sig[owner == i].tolist())
        assert made[0] & made[1], (size, b)
        bits = [int(np.uint64(a)) for a in np.bitwise_xor(*jaccard.sketches(np.concatenate((x, y)), np.array([size, b]))).view(np.uint64)]
        assert sum(v.bit_count() for v in bits) <= size + b - 2 * inter


def test_sets_with_empty_subsets_are_dealt_again(monkeypatch):
    """With too many groups for the features, pairs still meet, and under no signature of nothing."""
    rng = np.random.default_rng(4)
    band = jaccard.Band(20, 40, 5, 12, 1, 0, 6)
    monkeypatch.setattr(jaccard, "BANDS", [band])
    for _ in range(200):
        x = rng.integers(0, 2**63, 30).astype(np.uint64)
        y = np.concatenate((x[:28], rng.integers(0, 2**63, 3).astype(np.uint64)))
        made = [set(), set()]
        for owner, sig in jaccard.signatures(np.concatenate((x, y)), np.array([30, 31])):
            for i in (0, 1):
                made[i] |= set(sig[owner == i].tolist())
        assert made[0] & made[1]
    others = [rng.integers(0, 2**63, 30).astype(np.uint64) for _ in range(300)]
    met = {}
    for owner, sig in jaccard.signatures(np.concatenate(others), np.full(300, 30)):
        for o, s in zip(owner.tolist(), sig.tolist()):
            met.setdefault(s, set()).add(o)
    assert max(map(len, met.values())) == 1


def test_set_numbers_depend_on_the_set_alone():
    texts = pa.array(["a b c d e a b c d", "a b c d e", "e d c b a", None, "a b", "A  B"])
    h, n = jaccard.feature_sets(texts)
    assert n.tolist() == [5, 2, 2, 0, 1, 1]
    numbers = jaccard.set_numbers(h, n).tolist()
    assert numbers[4] == numbers[5] and len(set(numbers)) == 5
