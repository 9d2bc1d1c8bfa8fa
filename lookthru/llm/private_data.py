"""Personal data: fixed patterns, and a skip-chain conditional random field (CRF) that adds what they miss.

The patterns give base spans of four kinds. The CRF labels the tokens that hold a digit or an at sign (all other
tokens have label "none"). Its potentials: token shape; the labels of neighbours in the text (chain); and the labels of
distant tokens that are equal or have the same last digits (skip edges, each occurrence tied to the next one, so a
token that occurs n times gives n - 1 edges). Loopy message passing makes the labels of a document agree, so a number
that is private in one place is found where it is written differently elsewhere. Weights are learned on a bounded sample,
with the base spans as labels, by pseudo-likelihood. Tokens of high marginal probability give further spans.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lookthru.llm.text import slices

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000    # expected rows that the field is fitted on
SAMPLE_TOKENS = 400     # tokens of one sampled text that it is fitted on
SURE = 0.9              # marginal probability from which a token gives a span
ROUNDS = 15             # of message passing
_MARK = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_EDGES = ".,;:!?\"'()[]{}<>#*$%&|=" # stripped from a token's ends


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str):
    """An address starts where its run of local characters does, so the at signs lead to all of them in linear time."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = floor + len(text[floor:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        floor = max(at + 1, found.end() if found else 0)
        at = text.find("@", floor)


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start; code points, end exclusive."""
    out = [(0, *s) for s in _emails(text)]
    if not _MARK.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


_BUCKETS = (2, 4, 6, 7, 11, 15, 16, 19)
FEATURES = 1 + len(_BUCKETS) + 1 + 9
LABELS = len(KINDS) + 1


def _shape(token: str) -> list[float]:
    digits = [c for c in token if "0" <= c <= "9"]
    n, f = len(digits), [0.0] * FEATURES
    f[0] = 1.0
    f[1 + sum(n > b for b in _BUCKETS)] = 1.0
    at = 2 + len(_BUCKETS)
    head, sign, tail = token.partition("@")
    parts = token.split(".")
    f[at] = float(bool(sign))
    f[at + 1] = float(bool(head and "." in tail.strip(".")))
    f[at + 2] = float(any(c.isalpha() for c in token))
    f[at + 3] = float(len(parts) == 4 and all(p.isdigit() for p in parts))
    f[at + 4] = float(len(parts) == 4 and all(p.isascii() and p.isdigit() and _octet(p) for p in parts))
    f[at + 5] = float(token.startswith("+"))
    f[at + 6] = float("-" in token)
    f[at + 7] = float(n == len(token) and n > 0)
    f[at + 8] = float(16 <= n <= 19 and luhn("".join(digits)))
    return f


class Tokens:
    """Candidate tokens of one text with their chain and skip edges."""

    def __init__(self, text: str, limit: int | None = None):
        self.spans, self.words, self.chain, self.skip = [], [], [], []
        last, before = {}, None
        for m in _TOKEN.finditer(text):
            if not _MARK.search(m[0]):
                continue
            word = m[0].strip(_EDGES)
            if not word:
                continue
            start = m.start() + m[0].index(word)
            k = len(self.words)
            if limit is not None and k >= limit:
                break
            self.spans.append((start, start + len(word)))
            self.words.append(word)
            if before is not None and m.start() - before <= 1:
                self.chain.append((k - 1, k))
            before = m.end()
            digits = "".join(c for c in word if "0" <= c <= "9")
            for key in {word.lower(), *([digits[-7:]] if len(digits) >= 7 else [])}:
                if len(key) >= 5:
                    if key in last:
                        self.skip.append((last[key], k))
                    last[key] = k

    def labels(self, spans: list[tuple[int, int, int]]) -> list[int]:
        """0, or 1 + the first kind whose span covers the token."""
        out = [0] * len(self.words)
        for kind in reversed(range(len(KINDS))):
            own = sorted((s, e) for k, s, e in spans if k == kind)
            i = 0
            for j, (s, e) in enumerate(self.spans):
                while i < len(own) and own[i][1] <= s:
                    i += 1
                if i < len(own) and own[i][0] < e and own[i][1] > s:
                    out[j] = kind + 1
        return out


def fit(texts: list[tuple[list[str], list[int], list[tuple[int, int]], list[tuple[int, int]]]], steps: int = 300,
        rate: float = 0.5) -> dict[str, np.ndarray] | None:
    """Weights from (tokens, labels, chain edges, skip edges) per text, by gradient ascent on the pseudo-likelihood."""
    x, y, chain, skip, at = [], [], [], [], 0
    for words, labels, near, far in texts:
        x += [_shape(w) for w in words]
        y += labels
        chain += [(a + at, b + at) for a, b in near]
        skip += [(a + at, b + at) for a, b in far]
        at += len(words)
    if not y or not any(y):
        return None
    x, y = np.array(x), np.array(y)
    one = np.eye(LABELS)[y]
    sides = {"prev": np.zeros((at, LABELS)), "next": np.zeros((at, LABELS)), "same": np.zeros((at, LABELS))}
    for a, b in chain:
        sides["prev"][b] += one[a]
        sides["next"][a] += one[b]
    for a, b in skip:
        sides["same"][a] += one[b]
        sides["same"][b] += one[a]
    w = {"shape": np.zeros((FEATURES, LABELS)), "chain": np.zeros((LABELS, LABELS)), "skip": np.zeros(())}
    for _ in range(steps):
        score = x @ w["shape"] + sides["prev"] @ w["chain"] + sides["next"] @ w["chain"].T + w["skip"] * sides["same"]
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        gap = (one - p / p.sum(1, keepdims=True)) / at
        w["shape"] += rate * 10 * (x.T @ gap - 1e-4 * w["shape"])
        w["chain"] += rate * 10 * (sides["prev"].T @ gap + gap.T @ sides["next"] - 1e-4 * w["chain"])
        w["skip"] = w["skip"] + rate * 10 * ((gap * sides["same"]).sum() - 1e-4 * w["skip"])
    w["skip"] = np.maximum(w["skip"], 2.0)  # equal tokens attract each other, even where the sample has few of them
    return w


def marginals(words: list[str], chain: list[tuple[int, int]], skip: list[tuple[int, int]], w: dict[str, np.ndarray]) -> np.ndarray:
    """Label probabilities of all tokens by damped loopy message passing."""
    unary = np.array([_shape(x) for x in words]) @ w["shape"]
    pairs = [*chain, *skip]
    if not pairs:
        return _softmax(unary)
    a, b = np.array(pairs).T
    same = np.eye(LABELS) * w["skip"]
    forth = np.concatenate([np.repeat(w["chain"][None], len(chain), 0), np.repeat(same[None], len(skip), 0)])
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    pot = np.concatenate([forth, forth.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    msg = np.zeros((len(src), LABELS))
    for _ in range(ROUNDS):
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        out = (belief[src] - msg[back])[:, :, None] + pot
        top = out.max(1, keepdims=True)
        new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
        new -= new.max(1, keepdims=True)
        done = np.abs(new - msg).max() < 1e-4
        msg = 0.5 * (msg + new)
        if done:
            break
    belief = unary.copy()
    np.add.at(belief, dst, msg)
    return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    p = np.exp(x - x.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[int, int, int]], w: dict[str, np.ndarray] | None) -> list[tuple[int, int, int]]:
    """Spans of tokens that the field is sure of and no base span touches; neighbours of one kind make one span."""
    if w is None or not _MARK.search(text):
        return []
    tokens = Tokens(text)
    if not tokens.words:
        return []
    p = marginals(tokens.words, tokens.chain, tokens.skip, w)
    covered, near, out, previous = tokens.labels(base), set(tokens.chain), [], None
    for i, ((start, end), label) in enumerate(zip(tokens.spans, p.argmax(1).tolist())):
        if not label or p[i, label] < SURE or covered[i]:
            continue
        if out and previous == i - 1 and (i - 1, i) in near and out[-1][0] == label - 1:
            out[-1] = (label - 1, out[-1][1], end)
        else:
            out.append((label - 1, start, end))
        previous = i
    return sorted(out)


def train(docs: DataFrame, text_column: str = "text", sample: int = SAMPLE_DOCS) -> dict[str, np.ndarray] | None:
    """Weights from about ``sample`` rows, chosen by a hash of their text; only tokens with a digit or an at sign, at most
    ``SAMPLE_TOKENS`` of a text, reach the driver. None if no row shows any private data."""
    rows = docs.count()
    share = min(1.0, sample / max(rows, 1))
    chosen = docs.select(F.col(text_column).alias("text")).filter(
        F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)).filter(F.col("text").rlike("[0-9@]"))

    def run(batches):
        for part in slices(batches, "text"):
            found = [(Tokens(t, SAMPLE_TOKENS), base_spans(t)) for t in part.column("text").to_pylist() if t]
            found = [(t, t.labels(s)) for t, s in found if t.words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([[w[:80] for w in t.words] for t, _ in found], pa.list_(pa.string())), pa.array([y for _, y in found], pa.list_(pa.int32())),
                 pa.array([[i for e in t.chain for i in e] for t, _ in found], pa.list_(pa.int32())),
                 pa.array([[i for e in t.skip for i in e] for t, _ in found], pa.list_(pa.int32()))], ["words", "labels", "chain", "skip"])

    got = chosen.mapInArrow(run, "words array<string>, labels array<int>, chain array<int>, skip array<int>").limit(2 * sample).collect()
    pairs = lambda x: list(zip(x[::2], x[1::2]))
    texts = sorted((r.words, r.labels, pairs(r.chain), pairs(r.skip)) for r in got)
    return fit(texts)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, counts of base spans by kind, base (the base spans as text) and spans (all spans).

    Spans are kind:start:end in code points, end exclusive, ordered by kind as in ``KINDS``, then start. Null and
    empty texts have none. Repeated rows each give a row; an empty table gives an empty table.
    """
    weights = train(docs, text_column)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for part in slices(batches, "text"):
            counts, base, every = [], [], []
            for text in part.column("text").to_pylist():
                own = base_spans(text or "")
                counts.append([sum(k == i for k, *_ in own) for i in range(len(KINDS))])
                base.append(_joined(own))
                every.append(_joined(sorted(own + added_spans(text or "", own, weights))))
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)]
            yield pa.RecordBatch.from_arrays([part.column("id"), *columns, pa.array(base), pa.array(every)],
                                             ["id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return given.mapInArrow(run, f"id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base string, spans string")


def redacted(text: str | None, weights: dict[str, np.ndarray] | None) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that touch others become one."""
    if not text:
        return text
    base = base_spans(text)
    spans = deque(sorted((s, e, k) for k, s, e in base + added_spans(text, base, weights)))
    out, at = [], 0
    while spans:
        start, end, kind = spans.popleft()
        while spans and spans[0][0] < end:
            end = max(end, spans.popleft()[1])
        out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """``docs`` with private data replaced in the text, and its length, where there is such a column, counted anew."""
    weights = train(docs, text_column)
    place = docs.columns.index(text_column)

    def run(batches):
        for batch in batches:
            for part in slices(iter([batch]), batch.schema.names[place]):
                texts = pa.array([redacted(t, weights) for t in part.column(place).to_pylist()], part.schema.field(place).type)
                yield part.set_column(place, part.schema.field(place), texts)

    out = docs.mapInArrow(run, docs.schema)
    if length_column in docs.columns:
        out = out.withColumn(length_column, F.length(text_column).cast(docs.schema[length_column].dataType))
    return out


def op2_private_data(docs: DataFrame) -> DataFrame:
    return find(docs).select(F.col("id").alias("doc_id"), *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
