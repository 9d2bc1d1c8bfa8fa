import random
import string

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lookthru.functions import cells as C, identifiers as idf, privacy, similarity as sim
from lookthru.operators import names, resolve
from lookthru.operators.statements import statement_holdings
from lookthru.sources.generate import isin_from


def values(spark, texts, *cols):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(cols)]).orderBy("i").collect()
    return [tuple(r)[1:] if len(cols) > 1 else r[1] for r in rows]


def luhn(s):
    digits = "".join(str(int(c, 36)) for c in s)
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def test_isin_cases(spark):
    t = F.col("t")
    got = values(spark, ["INE002A01018", "INE002A01019", "US0378331005", " ine-002a 01018", "N.A.", "", None,
                         "garbage"], idf.isin_normalise(t), idf.isin_valid(t), idf.isin_is_equity(t))
    assert got == [("INE002A01018", True, True), ("INE002A01019", False, False),
                   ("US0378331005", True, False), ("INE002A01018", True, True), (None, False, False),
                   (None, False, False), (None, False, False), ("GARBAGE", False, False)]


def test_isin_valid_against_a_plain_check(spark):
    rng = random.Random(3)
    texts = ["IN" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=9)) + rng.choice("0123456789")
             for _ in range(500)]
    assert values(spark, texts, idf.isin_valid(F.col("t"))) == [luhn(t) for t in texts]


def test_generated_isins_are_valid(spark):
    bodies = [f"INE{i:06d}01" for i in range(0, 999999, 7919)]
    made = values(spark, bodies, isin_from(F.col("t")))
    assert all(luhn(m) and len(m) == 12 for m in made)


def test_name_variants_meet(spark):
    names = ["HDFC Bank Ltd", "HDFC Bank Limited", "HDFC BANK LTD.", "The HDFC Bank  Equity Shares"]
    assert set(values(spark, names, idf.normalise_name(F.col("t")))) == {"hdfc bank"}
    assert values(spark, ["École Côté Ltd", None, "co"], idf.normalise_name(F.col("t"))) == ["école côté", "", ""]
    assert set(values(spark, names, idf.blocking_key(F.col("t")))) == {"hdfc"}


def test_canonical_scheme_name(spark):
    names = ["Blue Large Cap Fund - Direct Plan - Growth", "Blue Large Cap Fund-Regular - IDCW"]
    assert set(values(spark, names, idf.canonical_scheme_name(F.col("t")))) == {"blue large cap fund"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=40))
def test_name_and_isin_functions_are_total_and_idempotent(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    once = values(spark, texts, idf.normalise_name(F.col("t")))
    assert values(spark, once, idf.normalise_name(F.col("t"))) == once
    isin = values(spark, texts, idf.isin_normalise(F.col("t")))
    assert values(spark, isin, idf.isin_normalise(F.col("t"))) == isin
    assert None not in values(spark, texts, idf.isin_valid(F.col("t")))


def test_to_num(spark):
    texts = ["3,20,000", "3.5%", "(3.5)", "-", "₹ 12", "NIL", "abc", "1f", None, "-4.5"]
    assert values(spark, texts, C.to_num(F.col("t"))) == [
        320000.0, 3.5, 3.5, None, 12.0, None, None, None, None, -4.5]
    assert values(spark, ["(3.5)"], C.to_num(F.col("t"), paren_negative=True)) == [-3.5]


def test_classify(spark):
    rows = [("TREPS", None, None, "cash"), ("Index Future", "INE002A01018", 1.0, "derivative"),
            ("7% Bond", None, 1.0, "debt"), ("Acme", "INE002A01018", None, "equity"),
            ("Acme", "IN0020200001", 1.0, "debt"), ("Acme", None, 5.0, "equity"), ("Acme", None, None, "other"),
            ("Net Receivables", None, None, "other"), ("Net Current Assets", None, None, "other")]
    df = spark.createDataFrame(rows, "n string, i string, q double, want string")
    bad = df.filter(C.classify(F.col("n"), F.col("i"), F.col("q")) != F.col("want")).collect()
    assert bad == []


def test_units(spark):
    heads = ["Market Value (Rs. in Lakhs)", "Value (Rs. in Crores)", "Market value", "Lakh crore"]
    assert values(spark, heads, C.value_multiplier(F.col("t"))) == [1e5, 1e7, 1.0, 1e7]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b, 1):
            row[j] = prev[j - 1] + 1 if x == y else max(prev[j], row[j - 1])
    return row[-1]


def words(rng, n):
    return " ".join("".join(rng.choices("abcdenrst", k=rng.randint(1, 7))) for _ in range(n))


def test_lcs_short_and_long(spark):
    rng = random.Random(5)
    pairs = [(words(rng, rng.randint(1, 5)), words(rng, rng.randint(1, 5))) for _ in range(80)]
    pairs += [(words(rng, 20), words(rng, 20)) for _ in range(5)] + [("", "abc"), ("abc", "")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", sim.lcs_length(F.col("a"), F.col("b")).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == [lcs(a, b) for a, b in pairs]


@pytest.mark.parametrize("threshold", [70.0, 82.0, 88.0, 95.0])
def test_best_match_misses_nothing(spark, threshold):
    rng = random.Random(int(threshold))
    choices = sorted({words(rng, rng.randint(1, 4)) for _ in range(120)})
    names = set()
    for c in choices:
        t = list(c)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(t) + 1)
            t[k:k + rng.randint(0, 1)] = rng.choice(["", "a", "x", "e"])
        parts = "".join(t).split()
        rng.shuffle(parts)
        names.add(" ".join(parts))
    names = sorted(n for n in names if n) + ["zzzz qqqq"]

    def score(a, b):
        a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
        return 2 * lcs(a, b) / (len(a) + len(b))

    want = {}
    for n in names:
        best = min((-score(n, c), c) for c in choices)
        if -best[0] * 100 >= threshold - 1e-9:
            want[n] = (best[1], pytest.approx(-best[0]))
    n = spark.createDataFrame([(x,) for x in names], "n string")
    c = spark.createDataFrame([(x,) for x in choices], "n string")
    got = {r.n: (r.match, r.score) for r in resolve.best_match(n, c, threshold).collect()}
    assert got == want


def score(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 2 * lcs(a, b) / (len(a) + len(b))


def test_best_score_of_every_name_in_bounded_units(spark, monkeypatch):
    """No threshold: names of one family, long ones, ones like nothing. Few choices are scored, whatever the cut."""
    rng = random.Random(9)
    choices = sorted({f"{rng.choice(['north', 'south', 'polar'])} {rng.choice(['growth', 'value', 'mid cap'])} fund {i:03}" for i in range(0, 900, 7)}
                     | {words(rng, 60) for _ in range(4)})
    asked = sorted({"noth grwth fund 0077", "fund 119 souht vlaue", "zzzz", "\u00e9\u4e2d", choices[3], words(rng, 50), " ".join(reversed(choices[9].split()))})
    want = {n: min((-score(n, c), c) for c in choices) for n in asked}
    n = spark.createDataFrame([(x,) for x in asked], "n string")
    c = spark.createDataFrame([(x,) for x in choices], "n string")
    for per_unit in (names.CHOICES_PER_UNIT, 40):
        monkeypatch.setattr(names, "CHOICES_PER_UNIT", per_unit)
        monkeypatch.setattr(names, "NAMES_PER_UNIT", 3 if per_unit == 40 else 1024)
        got = {r.n: r for r in names.best_choices(n, c).collect()}
        assert {k: (-r.score, r.match) for k, r in got.items()} == want
    monkeypatch.setattr(names, "FIRST", 8)
    block = names.Choices(choices, [" ".join(sorted(x.split())) for x in choices])
    scored = [block.best(" ".join(sorted(x.split())))[2] for x in asked if x not in ("zzzz", "\u00e9\u4e2d")]
    assert sum(scored) < 0.6 * len(choices) * len(scored)


def test_names_of_three_hundred_characters(spark):
    rng = random.Random(10)
    pairs = [("".join(rng.choices("abcd ", k=n)), "".join(rng.choices("abcd ", k=m))) for n, m in ((300, 310), (61, 300), (62, 62), (63, 64), (124, 125), (1, 300))]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = df.select("i", sim.lcs_length(F.col("a"), F.col("b")).alias("l")).orderBy("i").collect()
    assert [r.l for r in got] == [lcs(a, b) for a, b in pairs]
    for a, b in pairs:
        block = names.Choices([b, "x"], [b, "x"])
        assert block.lcs(block._letters(names._codes(a)), np.array([0, 1])).tolist() == [lcs(a, b), lcs(a, "x")]


def test_redaction(spark):
    text = "PAN ABCDE1234F, mail to jo.do+x@ex-am.ple.org now\nFolio No: 123/45 \nbye"
    got = values(spark, [text], privacy.redact(F.col("t")))[0]
    assert "ABCDE1234F" not in got and "jo.do" not in got and "123/45" not in got
    assert "[PAN REDACTED]" in got and "[EMAIL REDACTED]" in got and "Folio No: [REDACTED]" in got


def test_statement_merge(spark):
    pages = [("S", 1, "INF209K01YN0 - Some  Fund Growth   1,234.567   402.4844   4,96,789.12\n"
                      "INF209K01YN1 – Other Fund 1.0 2.0 3.00"),
             ("S", 2, "INF209K01YN0 - Some Fund Growth 10.000 403.0 100.00\nINF209K01YN2 - Nil 1.0 2.0 0.00")]
    df = spark.createDataFrame(pages, "statement_id string, page int, text string")
    got = {r.isin: r for r in statement_holdings(df).collect()}
    assert set(got) == {"INF209K01YN0", "INF209K01YN1"}
    first = got["INF209K01YN0"]
    assert (first.scheme_name, first.units, first.nav, first.value) == (
        "Some Fund Growth", 1244.567, 403.0, 496889.12)


def test_statement_lines_are_cut_without_patterns_compiled_by_line(spark, explain):
    pages = [("S", 1, "IN0123456789 –  A  B\tC 1,0.5 2.0 3,00.00\nIN0123456789-   1.0 2.0 4.00")]
    df = spark.createDataFrame(pages, "statement_id string, page int, text string")
    got = statement_holdings(df)
    assert [tuple(r) for r in got.collect()] == [("S", "IN0123456789", "", 11.5, 2.0, 304.0)]
    plan = explain(got)
    assert "RLIKE" not in plan and r"(?U)\s+, -1" not in plan
