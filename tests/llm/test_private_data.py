import hashlib
import re

from hypothesis import given, settings, strategies as st

from lookthru.llm import private_data as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(sum(map(int, str(x))) for x in twice) % 10 == 0


def brute(text):
    text = text or ""
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1.@+-() _%z9é\n0", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert P.base_spans(text) == brute(text)


def test_known_values():
    text = "a.b@c.de 4111 1111 1111 1111 x +1 (947) 555-7668, 10.0.0.256 010.0.0.255"
    assert [(P.KINDS[k], text[s:e]) for k, s, e in P.base_spans(text)] == [
        ("email", "a.b@c.de"), ("ip", "010.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (947) 555-7668")]


def test_query(spark, data, odd):
    for docs in (spark.read.parquet(f"{data}/documents.parquet"), odd):
        texts = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
        got = sorted(((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in P.op2_private_data(docs).collect()))
        want = []
        for i, t in texts:
            base = brute(t)
            joined = ",".join(f"{P.KINDS[k]}:{s}:{e}" for k, s, e in base)
            want.append((i, *(sum(k == n for k, *_ in base) for n in range(4)), hashlib.sha256(joined.encode()).hexdigest()))
        assert got == sorted(want)
    assert P.op2_private_data(odd.limit(0)).collect() == []


def weights():
    texts = []
    for i in range(60):
        text = f"call +1 (555) 01{i % 10}-77{i % 10}1 or mail ab{i}@c{i}.org from 10.0.{i}.7 on day {i} of 20{i:02} in 4 rooms"
        t = P.Tokens(text)
        texts.append((t.words, t.labels(P.base_spans(text)), t.chain, t.skip))
    return P.fit(texts)


def test_field_adds_what_agrees_with_distant_tokens():
    w = weights()
    text = "write to ab7@mail.org today. The number is +1 (555) 014-7741 they say; again 014-7741 as said, room 4."
    base = P.base_spans(text)
    spans = base + P.added_spans(text, base, w)
    assert any(text[s:e] == "014-7741" for k, s, e in spans if k == 3)
    assert all("room" not in text[s:e] and text[s:e] != "4" for _, s, e in spans)
    plain = "in 1999 we had 4 rooms and 12 dogs, page 17"
    assert P.added_spans(plain, [], w) == []


def test_marginals_equal_enumeration_on_a_tree():
    import itertools

    import numpy as np

    w = weights()
    words, chain, skip = ["+1", "555", "a@b.cd"], [(0, 1)], [(1, 2)]
    unary = np.array([P._shape(x) for x in words]) @ w["shape"]
    total = np.zeros((3, P.LABELS))
    for y in itertools.product(range(P.LABELS), repeat=3):
        p = np.exp(unary[0, y[0]] + unary[1, y[1]] + unary[2, y[2]] + w["chain"][y[0], y[1]] + w["skip"] * (y[1] == y[2]))
        for i in range(3):
            total[i, y[i]] += p
    assert np.abs(P.marginals(words, chain, skip, w) - total / total.sum(1, keepdims=True)).max() < 1e-2


def test_redact(spark, odd):
    docs = spark.createDataFrame([(1, "mail a@b.co, ip 1.2.3.4 é", 5, "x"), (2, None, 0, "y"), (3, "", 0, "z")], "doc_id long, text string, n_chars long, id string")
    got = {r.doc_id: r for r in P.redact(docs).collect()}
    assert got[1].text == "mail [EMAIL], ip [IP] é" and got[1].n_chars == len(got[1].text) and got[1].id == "x"
    assert got[2].text is None and got[3].text == ""
    assert P.redact(odd).columns == odd.columns and P.redact(odd).count() == odd.count()
