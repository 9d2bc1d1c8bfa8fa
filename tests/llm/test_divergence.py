import random
import re
from collections import Counter, defaultdict

from lookthru.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_df, top=50):
    """Rows (lang, source, part, item, value, rank) by dense sums over the vocabulary."""
    group, files = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        group[lang or "", source or ""].update(terms)
        files[lang or ""].update(set(terms))
    out = []
    for lang in files:
        kept = [t for t, n in files[lang].items() if n >= min_df]
        own = {s: c for (l, s), c in group.items() if l == lang}

        def shares(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in own.items()}
        q = shares(sum(own.values(), Counter()))
        for s in own:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            more = sorted((q[t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(more[:top])]
    return out


def found(docs, min_df):
    a = divergence.audit(docs, min_df=min_df)
    pairs = divergence.pair_distances(a).collect()
    out = [(r.lang, s, o, r.value) for r in pairs for s, o in ((r.a, r.b), (r.b, r.a))]
    terms = [(r.lang, r.source, r.term, r.value, r["rank"]) for r in divergence.telling_terms(a).collect()]
    return out, terms


def split(want):
    return (sorted((l, s, i, v) for l, s, part, i, v, _ in want if part == "pair"),
            sorted((l, s, i, v, k) for l, s, part, i, v, k in want if part == "term"))


def test_query_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = divergence.op11_divergence(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(brute([(r.lang, r.source, r.text) for r in docs.collect()], 30))


def test_groups_of_very_different_sizes(spark, make):
    """Groups without terms, of one word and of many: the shares of absent terms lie among those of present ones."""
    rng = random.Random(8)
    words = [make(rng, 1) for _ in range(60)] + ["Ärger", "été", "x"]
    rows = []
    for lang in ("en", None):
        for k, source in enumerate(("a", "b", "c", "d", None, "é")):
            rows += [(lang, source, " ".join(rng.choices(words, k=int(3 ** k)))) for _ in range(1 + k)]
        rows += [(lang, "bare", "12 ; 34"), (lang, "none", None)]
    rows += [("xx", "only", "lone words here"), ("yy", "s", ""), ("yy", "t", None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    for min_df in (1, 3):
        pairs, terms = split(brute(rows, min_df))
        got = found(docs, min_df)
        assert sorted(got[0]) == pairs and sorted(got[1]) == terms


def test_odd_and_empty_tables(spark, odd):
    rows = [(r.lang, r.source, r.text) for r in odd.collect()]
    extra = odd.withColumnsRenamed({"id": "term", "tkey": "n", "fp": "df", "row": "p", "g": "z"})
    for min_df in (1, 2):
        pairs, terms = split(brute(rows, min_df))
        got = found(extra, min_df)
        assert sorted(got[0]) == pairs and sorted(got[1]) == terms
    assert divergence.op11_divergence(odd.limit(0)).collect() == []


def test_sums_handed_on_early_are_the_same(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = sorted(map(tuple, divergence.group_sums(docs).collect()))
    monkeypatch.setattr(divergence, "HELD", 0)
    assert sorted(map(tuple, divergence.group_sums(docs).collect())) == want
