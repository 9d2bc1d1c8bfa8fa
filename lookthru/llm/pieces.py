"""SentencePiece encoding and decoding by a streaming Viterbi search.

The lattice of pieces over a text is searched from left to right. A place keeps one backpointer: the piece that ends
there on the best path. Only places within the longest piece's length can still begin a piece, so as soon as the
backpointer paths of those places meet in one boundary, everything up to it is committed and forgotten; the window held
is the uncommitted rest, not the text.

Unigram models choose the piece by the sum of scores. BPE models have no path score, but a lattice of the same form: the
encoding of a prefix is a prefix of encodings, so each place has exactly one last piece, namely the one that may
follow the last piece at its start. Two pieces may follow each other if merging their characters alone gives just
these two. Both give the ids of the library for the same model; characters outside the vocabulary become
byte pieces or the unknown id.

No piece of the usual models holds a blank behind another character. Where that is so, every blank begins
a boundary on which all paths meet, and equal words between boundaries are encoded once per task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lookthru.llm.text import slices

BLANK = "▁"
BLOCK = 256            # characters by which the lattice grows
MEMO_WORDS = 400_000   # encoded words after which a task's memory of them starts anew
MEMO_PAIRS = 1_000_000
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if tag & 7 == 2 else {1: 8, 5: 4}[tag & 7]
            yield tag >> 3, data[at:at + size]
            at += size


class Model:
    """Pieces, scores and settings of a model file. The file's content is given, so tasks need no path."""

    def __init__(self, data: bytes):
        self.name = hashlib.sha256(data).hexdigest()
        self.texts, self.scores, self.kinds = [], [], []
        trainer, normal = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.texts.append(piece.get(1, b"").decode())
                self.scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(piece.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if normal.get(2) or 4 in self.kinds or trainer.get(24, 0):
            raise ValueError("models with a character map, user-defined pieces or blanks as suffixes aren't supported")
        self.bpe, self.byte_fallback = trainer.get(3, 1) == 2, bool(trainer.get(35, 0))
        self.prefix, self.squeeze = bool(normal.get(3, 1)), bool(normal.get(4, 1))
        self.ids = {t: i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == 1}
        self.unknown = self.kinds.index(2) if 2 in self.kinds else 0
        self.bytes = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(self.texts, self.kinds)) if k == 6}
        self.longest = max(map(len, self.ids), default=1)
        self.by_words = all(BLANK not in t.lstrip(BLANK) for t in self.ids)
        self.floor = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY

    def normal(self, text: str) -> str:
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", BLANK)


def load(path: str) -> Model:
    with open(path, "rb") as file:
        return Model(file.read())


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        #: Ends of pieces, with the piece's id, or -1 if no piece is like that. What isn't here ends no piece.
        self.tails: dict[str, int] = {}
        for text in model.ids:
            for i in range(len(text)):
                self.tails.setdefault(text[i:], -1)
        self.tails.update(model.ids)
        self.odd: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}
        self.cut = _boundaries(model)
        self.parts = _Memo(lambda text: tuple(self.ids(self.pieces(_blocks(text)))))
        self.words = _Memo(self._word)  # each behind one blank that is not part of the key

    def _word(self, word: str) -> tuple[int, ...]:
        parts = self.cut.split(BLANK + word)
        return self.parts[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable(map(self.parts.__getitem__, parts)))

    def _merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best neighbours first."""
        ids, scores, parts = self.model.ids, self.model.scores, list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or scores[piece] > best):
                    best, at = scores[piece], i
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _follows(self, key: int, before: str, piece: str) -> bool:
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs.clear()
        got = self.pairs[key] = self._merged(before + piece) == ([before, piece] if before else [piece])
        return got

    def _grow_bpe(self, window: str, start: int, length: list[int], last: list[int]) -> None:
        """Backpointers (length of the last piece) of the places after ``start``, and the last piece's number: its id, or one of
        ``odd`` for a character that is no piece; -1 where the text begins."""
        tails, pairs, odd = self.tails, self.pairs, self.odd
        for end in range(start + 1, len(window) + 1):
            for at in range(end - 1, -1, -1):
                piece = window[at:end]
                got = tails.get(piece)
                if got is None or got < 0:
                    if at == end - 1:
                        number = odd.setdefault(piece, len(self.model.texts) + len(odd))
                    elif got is None:
                        break
                    else:
                        continue
                else:
                    number = got
                before = last[at]
                key = before << 24 | number
                fits = pairs.get(key)
                if fits is None:
                    fits = self._follows(key, window[at - length[at]:at], piece)
                if fits:
                    length.append(end - at)
                    last.append(number)
                    break
            if len(length) != end + 1:
                raise AssertionError("every place has a last piece")

    def _grow_unigram(self, window: str, start: int, length: list[int], score: list) -> None:
        """Backpointers and scores of the places after ``start``; of equal scores the longer piece wins."""
        tails, scores, floor = self.tails, self.model.scores, self.model.floor
        for end in range(start + 1, len(window) + 1):
            best, size = score[end - 1] + floor, 1
            for at in range(end - 1, -1, -1):
                got = tails.get(window[at:end])
                if got is None:
                    break
                if got >= 0 and score[at] + scores[got] >= best:
                    best, size = score[at] + scores[got], end - at
            length.append(size)
            score.append(best)

    def pieces(self, blocks: Iterable[str]) -> Iterator[str]:
        """The pieces of a normalised text that arrives in blocks, each piece as soon as it is sure.

        ``length[i]`` is the length of the last piece on the best path to place i of the window.
        """
        longest = self.model.longest
        grow, state = (self._grow_bpe, [-1]) if self.model.bpe else (self._grow_unigram, [0.0])
        window, length = "", [0]
        for block in blocks:
            start = len(window)
            window += block
            grow(window, start, length, state)
            end = len(window)
            if end < 4 * longest:
                continue
            open_ = set(range(end - longest + 1, end + 1))  # places where a later piece may begin: follow them back
            while len(open_) > 1:
                place = max(open_)
                open_.remove(place)
                open_.add(place - length[place])
            keep = (cut := open_.pop()) - length[cut]  # the piece before the cut stays: it decides what may follow
            if keep > 0:
                yield from self._path(window, length, keep)
                window, length, state = window[keep:], [0, *length[keep + 1:]], state[keep:]
        yield from self._path(window, length, len(window))

    @staticmethod
    def _path(window: str, length: list[int], place: int) -> list[str]:
        out = []
        while place:
            out.append(window[place - length[place]:place])
            place -= length[place]
        return out[::-1]

    def ids(self, pieces: Iterable[str]) -> Iterator[int]:
        model, was_unknown = self.model, False
        for piece in pieces:
            known = model.ids.get(piece)
            if known is not None:
                yield known
            elif model.byte_fallback:
                yield from (model.bytes[b] for b in piece.encode())
            elif not was_unknown:
                yield model.unknown
            was_unknown = known is None

    def encode(self, text: str) -> np.ndarray:
        model = self.model
        text = model.normal(text)
        if not text:
            return np.zeros(0, np.int32)
        if not model.by_words or (not model.byte_fallback):
            return np.fromiter(self.ids(self.pieces(_blocks(text))), np.int32)
        words = text.split(BLANK)
        head = words.pop(0)  # before the first blank
        ids = self.ids(self.pieces(_blocks(head))) if head else ()
        if "" in words:  # a run of blanks belongs to the word behind it
            joined, run = [], ""
            for word in words[:-1]:
                if word:
                    joined.append(run + word)
                    run = ""
                else:
                    run += BLANK
            words = [*joined, run + words[-1]]
        return np.fromiter(chain(ids, chain.from_iterable(map(self.words.__getitem__, words))), np.int32)


def _boundaries(model: Model) -> re.Pattern:
    """Places inside of words that no piece reaches across: around line breaks and tabs that are in no piece, and
    between a letter or digit and a sign that doesn't follow it in any piece."""
    pieces = "\x00".join(model.ids)
    none = "".join(c for c in "\n\t\r" if c not in pieces)
    behind: dict[str, str] = {}
    for letter, sign in set(re.findall(r"(?s)([^\W_])(?=([^\w\x00]))", pieces)):
        behind[sign] = behind.get(sign, "") + letter
    signs = [c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_"]
    free = "".join(c for c in signs if c not in behind)
    sides = [f"(?<=[^\\W_])(?=[{re.escape(free)}])"] if free else []
    sides += [f"(?<=[^\\W_])(?<![{behind[c]}])(?={re.escape(c)})" for c in signs if c in behind]
    sides += [f"(?<=[{none}])|(?=[{none}])"] if none else []
    return re.compile("|".join(sides) or r"(?!)")


def _blocks(text: str) -> Iterator[str]:
    return (text[i:i + BLOCK] for i in range(0, len(text), BLOCK))


class _Memo(dict):
    """Ids by text. When full, it starts anew but takes over again what it held before and meets once more, so that
    frequent texts stay."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.make, self.before = make, {}

    def trim(self) -> None:
        if len(self) > MEMO_WORDS:
            self.before = dict(self)
            self.clear()

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.before.get(text)
        if ids is None:
            ids = self.make(text)
        if len(text) <= 64:
            self[text] = ids
        return ids


class Decoder:
    def __init__(self, model: Model):
        self.model = model
        self.table = [t.replace(BLANK, " ") for t in model.texts]
        for i, kind in enumerate(model.kinds):
            if kind == 3:
                self.table[i] = ""
            elif kind == 2:
                self.table[i] = " ⁇ "
        self.byte = {i: b for b, i in model.bytes.items()}
        self.table_bytes = np.zeros(len(self.table), bool)   # bytes beyond ASCII, that only make sense together
        for i, b in self.byte.items():
            self.table[i] = chr(b)
            self.table_bytes[i] = b > 127

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become the replacement character."""
        if self.table_bytes[ids].any():
            parts, held = [], bytearray()
            for i in ids.tolist():
                if self.table_bytes[i]:
                    held.append(self.byte[i])
                    continue
                parts += [held.decode("utf-8", "replace"), self.table[i]]
                held.clear()
            text = "".join([*parts, held.decode("utf-8", "replace")])
        else:
            text = "".join(map(self.table.__getitem__, ids.tolist()))
        return text[1:] if self.model.prefix and text.startswith(" ") else text


_KNOWN: dict[str, tuple[Encoder, Decoder]] = {}


def _coders(model: Model) -> tuple[Encoder, Decoder]:
    """The worker's encoder and decoder of a model; what they remember serves later tasks of the worker too."""
    if model.name not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[model.name] = Encoder(model), Decoder(model)
    encoder, decoder = _KNOWN[model.name]
    encoder.words.trim()
    encoder.parts.trim()
    return encoder, decoder


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (array of int), n_tokens and round_trip (decoding gives the text again, blanks
    that the model's settings take out aside).

    Null and empty texts have no ids and round-trip. Repeated rows each give a row; an empty table an empty table.
    """
    model = load(path)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches):
        for part in slices(batches, "text"):
            encoder, decoder = _coders(model)
            found, same = [], []
            for text in part.column("text").to_pylist():
                ids = encoder.encode(text or "")
                found.append(ids)
                want = text or ""
                same.append(decoder.decode(ids) == (" ".join(x for x in want.split(" ") if x) if model.squeeze else want))
            sizes = np.array([len(x) for x in found], np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes)))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(found), pa.int32())),
                 pa.array(sizes), pa.array(same)], ["id", "ids", "n_tokens", "round_trip"])

    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return given.mapInArrow(run, f"id {kind}, ids array<int>, n_tokens bigint, round_trip boolean")


def decode(rows: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, text) of id lists; null gives null, an id outside the vocabulary an error."""
    model = load(path)
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            decoder = _coders(model)[1]
            texts = [None if ids is None else decoder.decode(np.array(ids, np.int32)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], ["id", "text"])

    given = rows.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    return given.mapInArrow(run, f"id {kind}, text string")


def op4_pieces(docs: DataFrame, path: str) -> DataFrame:
    return encode(docs, path).withColumnRenamed("id", "doc_id")
