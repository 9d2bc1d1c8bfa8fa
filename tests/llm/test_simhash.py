import random

import numpy as np
import xxhash

from lookthru.llm import simhash


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{print: smallest print reachable}"""
    left, out = set(prints), {}
    while left:
        seed = min(left)
        reach, edge = {seed}, [seed]
        while edge:
            x = edge.pop()
            new = {y for y in left - reach if (x ^ y).bit_count() <= 2}
            reach |= new
            edge += new
        left -= reach
        out.update({x: seed for x in reach})
    return out


def test_query_equals_brute_force(spark, data, odd):
    for docs in (spark.read.parquet(f"{data}/documents.parquet"), odd):
        rows = docs.collect()
        prints = {(r.doc_id, r.text): brute_print(r.text) for r in rows}
        comps = brute_components(set(prints.values()))
        least = {}
        for (i, _), p in prints.items():
            if i is not None:
                least[comps[p]] = min(i, least.get(comps[p], i))
        want = sorted(str((r.doc_id, f"{prints[r.doc_id, r.text]:016x}", least.get(comps[prints[r.doc_id, r.text]]))) for r in rows)
        assert sorted(str(tuple(r)) for r in simhash.op6_simhash(docs).collect()) == want


def test_links_of_crowded_segments_lose_nothing(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(3):  # crowds on one half
        base = rng.getrandbits(64)
        for _ in range(120):
            x = base
            for b in rng.sample(range(32), rng.randint(0, 4)):
                x ^= 1 << b
            prints.add(x)
            prints.add(x ^ 1 << rng.randrange(32, 64))
    prints |= {0, 1, 3, 1 << 63, (1 << 64) - 1}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    for crowd in (0, 8, 10**6):
        found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, crowd).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in found)
        near = {x: {x} for x in prints}
        group = {x: x for x in prints}

        def top(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in found:
            group[top(a)] = top(b)
        comps = brute_components(prints)
        assert len({top(x) for x in prints}) == len(set(comps.values()))


def test_bit_majority_of_long_and_empty_runs():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 254, 255, 256, 0, 1000, 2])
    hashes = rng.integers(0, 2**63, counts.sum()).astype(np.uint64)
    got, at = simhash.bit_majority(hashes, counts), 0
    for n, g in zip(counts, got):
        own = hashes[at:at + n].tolist()
        at += n
        assert int(g) == sum(1 << i for i in range(64) if n and 2 * sum(h >> i & 1 for h in own) > n)


def test_keep_one(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    found = simhash.near_duplicates(odd).collect()
    assert kept.count() == len({r.label for r in found})
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 6}
    assert simhash.keep_one(odd.limit(0)).collect() == [] and simhash.op6_simhash(odd.limit(0)).collect() == []


def test_variants_of_values_are_never_broadcast(spark, tmp_path):
    rng = random.Random(5)
    values = [(s, rng.getrandbits(32), 1) for s in (0, 1) for _ in range(500)]
    values += [(s, v ^ 1 << rng.randrange(32), 2) for s, v, _ in values[::5]]
    spark.createDataFrame(values, "s int, v long, n long").distinct().write.parquet(str(tmp_path / "v"))
    held = spark.read.parquet(str(tmp_path / "v"))  # a small file, whose 32 variants a value Spark sizes no larger
    met = simhash._met(held)
    got = {(r.s, r.v0, r.v1) for r in met.collect()}
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    own = {(r.s, r.v) for r in held.collect()}
    assert got == {(s, v, v | 1 << p) for s, v in own for p in range(32) if not v >> p & 1 and (s, v | 1 << p) in own}
