import hashlib
import random
import re

from lookthru.llm import decontaminate

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, text in items:
        w = words(text)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k:k + n]))
                if ids is not None:
                    hit.update(range(k, k + n))
                    found |= ids
        names = sorted(str(i) for i in found if i is not None)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(map(str, out))


def check(docs, items):
    got = sorted(str(tuple(r)) for r in decontaminate.op10_winnowing(docs, items).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_given_tables(spark, data):
    check(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet"))


def test_short_long_repeated_and_odd_items(spark, odd):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(6)]
    some = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    docs = spark.createDataFrame([(i, some(rng.randint(0, 90))) for i in range(150)] + [(3, "A b-C d, E"), (3, "A b-C d, E"), (900, None)], "doc_id long, text string")
    items = spark.createDataFrame([(i, some(n)) for i, n in enumerate([1, 2, 3, 5, 8, 9, 10, 10, 11, 12, 14, 20, 30, 30])]
                                  + [(50, "a B c"), (50, "a B c"), (51, None), (52, ""), (53, "..."), (None, "d e"), (54, "a a a a a a a a a a a a a")], "item_id long, text string")
    check(docs, items)
    check(docs, items.filter("length(text) > 25"))
    check(odd, items)
    check(docs, items.limit(0))
    check(docs.limit(0), items)
    kept = decontaminate.drop_contaminated(odd, items.filter("item_id = 50"))
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id != 9)  # a, b, c apart by a null byte


def test_every_shared_span_is_guaranteed(spark, make):
    rng = random.Random(1)
    item = make(rng, 60).split()
    docs = [(i, " ".join(make(rng, 20).split() + item[i:i + 10] + make(rng, 20).split())) for i in range(51)]
    found = decontaminate.op10_winnowing(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert [r.n_hit for r in found.collect()] == [10] * 51
