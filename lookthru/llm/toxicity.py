"""Toxicity: a convolutional text classifier over hashed words, trained here in numpy.

Words (letters, digits, characters beyond ASCII; A-Z lower-cased) are hashed to rows of an embedding: the word and its first four
and six bytes each have a row, and their sum is the word's vector. Filters of several widths slide over them, rectified and max-pooled over the whole text; a logistic unit weighs the pooled values. The first dimension of
the embedding starts as the smoothed log-odds of a row's presence in toxic texts, the rest at random; all is then trained by
Adagrad. Thresholds are calibrated per language on all labelled rows that the fit hasn't seen: histograms of log-odds by language
and label, with the histogram of all languages added at the weight of ``PRIOR`` rows, so that a language of few labels
leans on the others and one of many doesn't. The language of a text is itself told from its words, so a score depends on the text alone.

The fit sees a bounded sample of the labelled rows (``SAMPLE``); calibration and scoring see every row and its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lookthru.llm.shared import stored
from lookthru.llm.text import _KEEP, NOT_WORD, Words, mix, slices

SAMPLE = 6_000           # expected labelled rows of the fit
SAMPLE_WORDS = 10_000    # longer texts aren't used for the fit
ROWS = 1 << 18           # of the embedding
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
BATCH = 64
RATE = 0.05
PRIOR = 100.0            # rows that the histogram of all languages counts for in that of each
MOST_LANGUAGES = 255     # languages told apart, the most frequent of the sample; all others together are one more
STEP = 1 / 32            # width of a bin of log-odds
MOST_ODDS = 30.0


def buckets(words: Words) -> np.ndarray:
    """Embedding rows of each word: of the word itself and of its first four and six bytes."""
    first = np.ndarray((len(words.bytes) - 7,), "<u8", words.bytes, 0, (1,))[words.starts]
    size = words.ends - words.starts
    heads = [mix((first & _KEEP[np.minimum(size, n)]) ^ np.uint64(n << 56)) for n in (4, 6)]
    return (np.stack([words.hashes(), *heads], 1) & np.uint64(ROWS - 1)).astype(np.int32)


def _start(docs: list[np.ndarray], y: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    seen = np.ones((2, ROWS))
    for ids, label in zip(docs, y):
        seen[int(label), np.unique(ids)] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()]) + 2.0
    odds = np.log(seen[1] / n[1]) - np.log(seen[0] / n[0])
    odds *= np.minimum(1.0, (seen.sum(0) - 2) / 20)  # rare rows tell little
    p = {"E": rng.normal(0, 0.1, (ROWS, DIM)), "b": np.zeros(len(WIDTHS) * FILTERS), "v": rng.normal(0, 0.1, len(WIDTHS) * FILTERS)}
    p["E"][:, 0] = np.clip(odds, -3, 3) / 2
    for k in WIDTHS:
        p[f"W{k}"] = rng.normal(0, 0.3 / np.sqrt(k * DIM), (k * DIM, FILTERS))
        p[f"W{k}"][:DIM, 0] = np.eye(DIM)[0]
    p["v"][::FILTERS] = 1.0
    p["c"] = np.array(np.log(n[1] / n[0]))
    return p


def _pooled(p: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled values of one text and the places they come from (-1: none)."""
    out, at = np.zeros(len(p["b"])), np.full(len(p["b"]), -1)
    e = p["E"][ids].sum(1)
    for j, k in enumerate(WIDTHS):
        n = len(ids) - k + 1
        if n <= 0:
            continue
        own = slice(j * FILTERS, (j + 1) * FILTERS)
        pre = sum(e[i:i + n] @ p[f"W{k}"][i * DIM:(i + 1) * DIM] for i in range(k)) + p["b"][own]
        best = pre.argmax(0)
        top = pre[best, np.arange(FILTERS)]
        out[own], at[own] = np.maximum(top, 0), np.where(top > 0, best, -1)
    return out, at


def fit(docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters from hashed texts and labels; with one class only, all scores are its share."""
    rng = np.random.default_rng(seed)
    p = _start(docs, y, rng)
    if len(set(y.tolist())) < 2:
        return p
    past = {name: np.full_like(value, 0.01) for name, value in p.items()}
    weight = np.where(y == 1, 0.5 * len(y) / max(1, (y == 1).sum()), 0.5 * len(y) / max(1, (y == 0).sum()))
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // BATCH)):
            grad = {name: np.zeros_like(value) for name, value in p.items() if name != "E"}
            rows, parts = [], []
            for i in batch.tolist():
                ids = docs[i]
                h, at = _pooled(p, ids)
                score = 1 / (1 + np.exp(-(h @ p["v"] + p["c"])))
                d = (score - y[i]) * weight[i] / len(batch)
                grad["v"] += d * h
                grad["c"] += d
                dh = d * p["v"]
                for j, k in enumerate(WIDTHS):
                    live = np.flatnonzero(at[j * FILTERS:(j + 1) * FILTERS] >= 0)
                    if not len(live):
                        continue
                    f = j * FILTERS + live
                    grad["b"][f] += dh[f]
                    window = ids[at[f][:, None] + np.arange(k)]                       # filters x k x rows of a word
                    grad[f"W{k}"][:, live] += (p["E"][window].sum(2).reshape(len(live), -1) * dh[f][:, None]).T
                    rows.append(window.ravel())
                    parts.append(np.repeat((p[f"W{k}"][:, live].T * dh[f][:, None]).reshape(-1, DIM), window.shape[2], axis=0))
            for name, g in grad.items():
                g = g + (1e-4 * p[name] if name.startswith(("W", "v")) else 0)
                past[name] += g * g
                p[name] -= RATE * g / np.sqrt(past[name])
            if rows:
                at, place = np.unique(np.concatenate(rows), return_inverse=True)
                g = np.zeros((len(at), DIM))
                np.add.at(g, place, np.concatenate(parts))
                past["E"][at] += g * g
                p["E"][at] -= RATE * g / np.sqrt(past["E"][at])
    return p


class Classifier:
    """Parameters in single precision, ready for whole slices of texts."""

    def __init__(self, p: dict[str, np.ndarray], languages: np.ndarray, shifts: np.ndarray):
        self.p = {name: np.asarray(value, np.float32) for name, value in p.items()}
        self.languages, self.shifts = languages.astype(np.float32), shifts  # log-probabilities (rows x languages); threshold by language

    def raw(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of each text before calibration, and the number of its language."""
        p, ids, n = self.p, buckets(words), len(words.counts)
        e = p["E"][ids[:, 0]] + p["E"][ids[:, 1]] + p["E"][ids[:, 2]]
        left = np.repeat(words.first[1:], words.counts) - np.arange(len(ids))
        full = np.flatnonzero(words.counts)
        h = np.zeros((n, len(p["b"])))
        for j, k in enumerate(WIDTHS):
            if len(ids) < k or not len(full):
                continue
            m = len(ids) - k + 1
            pre = sum(e[i:i + m] @ p[f"W{k}"][i * DIM:(i + 1) * DIM] for i in range(k)) + p["b"][j * FILTERS:(j + 1) * FILTERS]
            pre[left[:m] < k] = 0
            starts = words.first[:-1][full]
            inside = starts < m
            h[full[inside], j * FILTERS:(j + 1) * FILTERS] = np.maximum(np.maximum.reduceat(pre, starts[inside], axis=0), 0)
        spoken = np.zeros((n, self.languages.shape[1]))
        if len(full):
            spoken[full] = np.add.reduceat(self.languages[ids[:, 1]], words.first[:-1][full], axis=0, dtype=np.float64)
        return h @ p["v"] + p["c"], spoken.argmax(1)


def _threshold(odds: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The cut with the fewest errors, by weight; the middle of the gap between the values beside it. With no gain over
    calling nothing toxic it lies above all values."""
    weight = np.ones(len(y)) if weight is None else weight
    order = np.argsort(-odds, kind="stable")
    gain = np.cumsum(np.where(y[order] == 1, weight[order], -weight[order]))
    ends = np.append(np.diff(odds[order]) != 0, True)  # equal values stay on one side
    gain = np.where(ends, gain, -np.inf)
    if not len(y) or gain.max() <= 1e-9:
        return float(odds.max() if len(y) else 0.0) + 2.0
    i = int(gain.argmax())
    below = odds[order][i + 1] if i + 1 < len(odds) else odds[order][i] - 2
    return float((odds[order][i] + below) / 2)


def hold_out(id_: Column) -> Column:
    return F.pmod(F.crc32(id_.cast("string")), F.lit(5))


def _known(labels: DataFrame, id_column: str, label_column: str) -> DataFrame:
    """(lid, y) of the labels that may be learned from; of clashing labels of an id the largest counts."""
    return (labels.select(F.col(id_column).alias("lid"), F.col(label_column).cast("int").alias("y")).filter("lid is not null and y is not null")
            .filter(hold_out(F.col("lid")) != 0).groupBy("lid").agg(F.max("y").alias("y")))


def _fitted(share: float) -> Column:
    """Whether a labelled row is one of the fit; a fifth of the rows never is."""
    h = F.xxhash64("lid")
    return (F.pmod(h, F.lit(1_000_003)) < int(share * 1_000_003) + 1) & (F.pmod(F.shiftright(h, 20), F.lit(5)) != 0)


def fit_sample(docs: DataFrame, known: DataFrame, share: float, id_column: str, text_column: str, lang_column: str) -> Classifier:
    """A classifier without thresholds from the sampled rows. Of each sampled text only word hashes reach the driver, one text
    per label: an id that several rows have gives the least of them."""
    chosen = known.filter(_fitted(share))
    given = docs.select(F.col(id_column).alias("lid"), F.col(text_column).alias("text"), F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang"))
    rows = given.join(F.broadcast(chosen), "lid").select(F.col("lid").cast("string").alias("id"), "text", "lang", "y")

    def run(batches):
        for part in slices(batches, "text"):
            words = Words(part.column("text"), NOT_WORD, lower=True)
            ids = buckets(words)
            blobs = [ids[a:b].tobytes() if b - a <= SAMPLE_WORDS else None for a, b in zip(words.first, words.first[1:])]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), part.column("y"), pa.array(blobs, pa.binary())], ["id", "lang", "y", "ids"])

    one = rows.mapInArrow(run, "id string, lang string, y int, ids binary").filter("ids is not null").groupBy("id", "y").agg(
        F.min(F.struct("lang", "ids")).alias("r")).select("id", "y", "r.*")
    got = sorted(one.collect(), key=lambda r: r.id)  # about SAMPLE rows
    texts, y = [np.frombuffer(r.ids, np.int32).reshape(-1, 3) for r in got], np.array([int(r.y > 0) for r in got], np.int64)
    counts: dict[str, int] = {}
    for r in got:
        counts[r.lang] = counts.get(r.lang, 0) + 1
    own = {x: i for i, x in enumerate(sorted(counts, key=lambda x: (-counts[x], x))[:MOST_LANGUAGES])}
    spoken = np.full((ROWS, max(1, len(own) + (len(counts) > len(own)))), 0.5)
    for r, ids in zip(got, texts):
        np.add.at(spoken[:, own.get(r.lang, len(own))], ids[:, 1], 1)
    return Classifier(fit(texts, y), np.log(spoken / spoken.sum(0)), np.zeros(spoken.shape[1]))


def raw_odds(docs: DataFrame, model: Classifier, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, held_out, said, odds): log-odds of every row before calibration, and the number of the language it is in."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for part in slices(batches, "text"):
            odds, said = model.raw(Words(part.column("text"), NOT_WORD, lower=True))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("held_out"), pa.array(said.astype(np.int32)), pa.array(odds.astype(np.float64))],
                                             ["id", "held_out", "said", "odds"])

    given = docs.select(F.col(id_column).alias("id"), F.coalesce(hold_out(F.col(id_column)) == 0, F.lit(False)).alias("held_out"), F.col(text_column).alias("text"))
    return given.mapInArrow(run, f"id {kind}, held_out boolean, said int, odds double")


def calibrated(odds: DataFrame, known: DataFrame, share: float, languages: int) -> np.ndarray:
    """The threshold of each language, from the log-odds of all labelled rows that weren't in the fit. Of these only
    histograms reach the driver: at most 1921 bins for each language and label."""
    rest = known.filter(~_fitted(share))
    bins = F.round(F.least(F.greatest(F.col("odds"), F.lit(-MOST_ODDS)), F.lit(MOST_ODDS)) / STEP).cast("int")
    got = (odds.join(rest, odds["id"] == rest["lid"]).groupBy("said", bins.alias("bin"), (F.col("y") > 0).cast("int").alias("y"))
           .agg(F.count("*").alias("n")).collect())
    said, at, y, n = (np.array([r[i] for r in got], np.float64) for i in range(4))
    pooled = PRIOR * n / n.sum() if len(n) else n
    return np.array([_threshold(np.append(at[said == i], at) * STEP, np.append(y[said == i], y), np.append(n[said == i], pooled)) for i in range(languages)])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
          label_column: str = "toxic", sample: int = SAMPLE) -> Classifier:
    """A classifier from labelled rows whose crc32 of the id is no multiple of five: fitted on a sample of them, its thresholds set on
    all others. Without labels every score is below one half. Null ids and labels are left out; of clashing
    labels of an id the largest counts."""
    known = _known(labels, id_column, label_column)
    share = min(1.0, sample / max(1, known.count()))
    model = fit_sample(docs, known, share, id_column, text_column, lang_column)
    labelled = docs.join(known.filter(~_fitted(share)).select(F.col("lid").alias(id_column)), id_column, "left_semi")
    model.shifts = calibrated(raw_odds(labelled, model, id_column, text_column), known, share, model.languages.shape[1])
    return model


def _scored(odds: DataFrame, shifts: np.ndarray) -> DataFrame:
    above = F.col("odds") - F.element_at(F.array(*map(F.lit, shifts.tolist())), F.col("said") + 1)
    score = 1 / (1 + F.exp(-F.least(F.greatest(above, F.lit(-MOST_ODDS)), F.lit(MOST_ODDS))))
    return odds.select("id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def score(docs: DataFrame, model: Classifier, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, held_out, score (0 to 1) and predicted (1 from one half).

    Null and empty texts are scored by the constants alone. Repeated rows each give a row; an empty table an empty table.
    """
    return _scored(raw_odds(docs, model, id_column, text_column), model.shifts)


def op7_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted. As ``train`` and ``score``, but every text is run through the classifier once."""
    known = _known(labels, "doc_id", "toxic")
    share = min(1.0, SAMPLE / max(1, known.count()))
    model = fit_sample(docs, known, share, "doc_id", "text", "lang")
    odds = stored(raw_odds(docs, model))
    return _scored(odds, calibrated(odds, known, share, model.languages.shape[1])).withColumnRenamed("id", "doc_id")
