import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from lookthru.llm import resampling

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    w = WORD.findall(lowered(text))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])], len(w)


def brute(docs, items):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[0]))
    for text in items:
        t.update(map(bucket, features(text)[0]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (n_s + 10000.0) / ((s[b] + 1.0) * (n_t + 10000.0))))
    rows = []
    for i, text in docs:
        f, n = features(text)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    rank = {}
    for k, r in enumerate(able[:25 * len(able) // 100]):
        rank.setdefault(r[:4], []).append(k + 1)
    return sorted(str((*r[:4], rank[r[:4]].pop(0) if r[4] >= 20 and rank.get(r[:4]) else None)) for r in rows)


def test_query_equals_brute_force(spark, data, odd):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    for docs in (spark.read.parquet(f"{data}/documents.parquet"), odd):
        got = resampling.op12_resampling(docs, items)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        want = brute([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in items.collect()])
        assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_crcs_of_all_lengths():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in (0, 1, 1, 2, 3, 3, 8, 8, 8, 50, 1024, 1025, 5000)]
    sizes = np.array([len(p) for p in parts])
    got = resampling.crc32s(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert got.tolist() == [zlib.crc32(p) for p in parts]


def test_ranks_over_many_partitions_with_ties(spark):
    """Equal ids and texts in many partitions: ranks run from 1 without gaps, in order of score and id."""
    rows = [(i % 500, " ".join(["alpha beta"] * 12)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = resampling.op12_resampling(docs, docs.limit(1)).filter("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 751))
    order = [(-r.score, r.doc_id) for r in got]
    assert order == sorted(order)


def test_empty_tables_and_kept_rows(spark, odd):
    empty = odd.limit(0)
    assert resampling.op12_resampling(empty, odd).collect() == []
    assert resampling.op12_resampling(odd, empty).count() == odd.count()
    kept = resampling.keep_drawn(odd, odd)
    assert kept.columns == odd.columns
    drawn = {r.doc_id for r in resampling.op12_resampling(odd, odd).collect() if r["rank"]}
    assert {r.doc_id for r in kept.collect()} == drawn and drawn
