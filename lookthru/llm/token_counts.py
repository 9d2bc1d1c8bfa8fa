"""Token counts without ids: pieces are counted once per distinct pre-token and summed over its frequency in a text.

Texts are taken in blocks of bounded size. A block gives its distinct pre-tokens, packed by a hash of the
pre-token, and one row with the pre-token frequencies of its texts. The packs meet by that hash, where each pre-token is
counted by the library, and the counts go back to their block, where frequencies and counts are joined and summed.
So the shuffles carry distinct pre-tokens per block and small numbers: neither texts nor ids, and no row for
every word. A group never holds more than one block.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from lookthru.llm.text import ranges, slices

BLOCK_BYTES = 8 << 20
PACKS = 1024            # packs that a block's pre-tokens are dealt to
MEMO = 400_000          # pre-tokens whose counts a task remembers; emptied beyond
LIMIT = 1024
#: The byte-level pre-tokenizer's pattern: fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRE = regex.compile(PATTERN)
_LONE = regex.compile(r" (?=\s|$)")
_TOKENIZERS: dict[str, Tokenizer] = {}


def _tokenizer(content: str) -> Tokenizer:
    key = xxhash.xxh64_hexdigest(content.encode())
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = Tokenizer.from_str(content)
    return _TOKENIZERS[key]


def _pack(values: list[bytes]) -> bytes:
    sizes = np.array([len(v) for v in values], np.int32)
    return zlib.compress(np.int32(len(values)).tobytes() + sizes.tobytes() + b"".join(values), 1)


def _unpack(data: bytes) -> list[bytes]:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data, np.int32, 1)[0])
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(data, np.int32, n, 4))
    return [data[a:b] for a, b in zip([4 + 4 * n, *ends.tolist()], ends.tolist())]


def _ints(values: np.ndarray) -> bytes:
    return zlib.compress(values.astype(np.int32).tobytes(), 1)


def _read(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.int32)


def _chunks(text: str, special: regex.Pattern | None) -> list[str]:
    """Parts of a text that pre-tokenization treats on their own: cut before each blank with something behind it.

    Such a blank always begins a pre-token, whatever stands before. Texts in which blanks meet other white space
    are given as pre-tokens; added tokens are parts of their own."""
    if special is not None and special.search(text):
        out, at = [], 0
        for m in special.finditer(text):
            out += [*_PRE.findall(text[at:m.start()]), m[0]]
            at = m.end()
        return out + _PRE.findall(text[at:])
    if _LONE.search(text):
        return _PRE.findall(text)
    first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)] if first else [" " + x for x in rest]


def _numbered(values: Iterable[str]) -> tuple[np.ndarray, list[str]]:
    """A number for each value, and the distinct values in the order of their numbers."""
    known: dict[str, int] = {}
    numbers = np.fromiter((known.setdefault(v, len(known)) for v in values), np.int64)
    return numbers, list(known)


class _Block:
    """Texts gathered until a block is full."""

    def __init__(self, special: regex.Pattern | None):
        self.special, self.ids, self.sizes, self.counts, self.parts = special, [], [], [], []
        self.hash = xxhash.xxh64()

    def add(self, ids: pa.Array, texts: list[str | None]) -> None:
        self.ids.append(ids)
        for text in texts:
            data = (text or "").encode()
            self.hash.update(data + b"\xff")
            parts = _chunks(text, self.special) if text else []
            self.sizes.append(len(data))
            self.counts.append(len(parts))
            self.parts += parts

    def rows(self, name: str) -> Iterator[tuple[int, str, object, object, bytes | None, bytes, bytes | None]]:
        codes, chunks = _numbered(self.parts)
        special = self.special
        cut = [[c] if special is not None and special.fullmatch(c) else _PRE.findall(c) for c in chunks]
        sizes = np.array([len(c) for c in cut], np.int64)
        inner, tokens = _numbered(chain.from_iterable(cut))
        starts = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        own = sizes[codes]
        pairs = np.repeat(doc, own) * max(1, len(tokens)) + inner[ranges(starts[codes], own)]
        pairs, freq = np.unique(pairs, return_counts=True)
        ptr = np.searchsorted(pairs, np.arange(len(self.counts) + 1) * max(1, len(tokens)))
        yield (-1 - xxhash.xxh32_intdigest(name), name, pa.concat_arrays(self.ids), np.array(self.sizes, np.int64), _ints(ptr),
               _ints(np.diff(pairs % max(1, len(tokens)), prepend=0)), _ints(freq))
        data = [t.encode() for t in tokens]
        pack = np.array([xxhash.xxh32_intdigest(d) % PACKS for d in data], np.int64)
        order = np.argsort(pack, kind="stable")
        cuts = np.flatnonzero(np.diff(pack[order], prepend=-1)).tolist() if len(order) else []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            at = order[a:b]
            yield int(pack[at[0]]), name, None, None, None, _ints(at), _pack([data[i] for i in at.tolist()])


_NAMES = ["route", "block", "ids", "sizes", "ptr", "codes", "data"]


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()),
         pa.array([None if x is None else x.to_pylist() for x in columns[2]], pa.list_(kind)), pa.array(columns[3], pa.list_(pa.int64())),
         *(pa.array(c, pa.binary()) for c in columns[4:])], _NAMES)


class _Pieces(dict):
    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def of(self, tokens: list[bytes]) -> np.ndarray:
        new = [t for t in tokens if t not in self]
        if new:
            if len(self) > MEMO:
                self.clear()
                new = tokens
            found = self.tokenizer.encode_batch([t.decode() for t in new], add_special_tokens=False)
            self.update(zip(new, (len(f.ids) for f in found)))
        return np.array([self[t] for t in tokens], np.int32)


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8) and n_tokens as the library gives them for the tokenizer file,
    without special tokens added; those inside a text count as the library's default has it.

    Null and empty texts have no tokens. Repeated rows each give a row; an empty table gives an empty table. Only
    byte-level tokenizers are supported; others raise ValueError.
    """
    with open(path, encoding="utf-8") as file:
        content = file.read()
    made = json.loads(content)
    pre = made.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or made.get("normalizer"):
        raise ValueError("only byte-level tokenizers without prefix blank and normalizer are supported")
    added = sorted((t["content"] for t in made.get("added_tokens", [])), key=len, reverse=True)
    pattern = "|".join(map(regex.escape, added))
    kind = docs.schema[id_column].dataType.simpleString()

    def cut(batches):
        special, block, n = regex.compile(pattern) if pattern else None, None, 0
        for part in slices(batches, "text"):
            id_kind = part.schema.field("id").type
            block = block or _Block(special)
            block.add(part.column("id"), part.column("text").to_pylist())
            if sum(block.sizes) >= BLOCK_BYTES:
                yield _batch(list(block.rows(f"{TaskContext.get().partitionId()}-{n}-{block.hash.hexdigest()}")), id_kind)
                block, n = None, n + 1
        if block:
            yield _batch(list(block.rows(f"{TaskContext.get().partitionId()}-{n}-{block.hash.hexdigest()}")), id_kind)

    def count(batches):
        pieces = None
        for batch in batches:
            pieces = _Pieces(_tokenizer(content)) if pieces is None else pieces
            data = [None if r < 0 else zlib.compress(pieces.of(_unpack(d)).tobytes(), 1)
                    for r, d in zip(batch.column("route").to_pylist(), batch.column("data").to_pylist())]
            data = [old if new is None else new for old, new in zip(batch.column("data").to_pylist(), data)]
            yield batch.set_column(6, "data", pa.array(data, pa.binary()))

    def total(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        head = next(i for i, r in enumerate(rows["route"]) if r < 0)
        codes = [_read(c) for r, c in zip(rows["route"], rows["codes"]) if r >= 0]
        counts = [_read(d) for r, d in zip(rows["route"], rows["data"]) if r >= 0]
        n = np.full(sum(map(len, codes)), -1, np.int64)
        for c, d in zip(codes, counts):
            n[c] = d
        if (n < 0).any():
            raise RuntimeError("a block's pre-tokens are incomplete: its input rows came in another order when read again")
        ptr, freq = _read(rows["ptr"][head]), _read(rows["data"][head]).astype(np.int64)
        total_ = np.concatenate(([0], np.cumsum(n[_codes(rows["codes"][head])] * freq)))
        ids = table.column("ids").combine_chunks().take(pa.array([head])).flatten()
        return pa.table({"id": ids, "n_bytes": pa.array(rows["sizes"][head], pa.int64()), "n_tokens": pa.array(total_[ptr[1:]] - total_[ptr[:-1]])})

    given = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = f"route bigint, block string, ids array<{kind}>, sizes array<bigint>, ptr binary, codes binary, data binary"
    counted = given.mapInArrow(cut, schema).repartition("route").mapInArrow(count, schema)
    return counted.groupBy("block").applyInArrow(total, f"id {kind}, n_bytes bigint, n_tokens bigint")


def _codes(data: bytes) -> np.ndarray:
    return np.cumsum(_read(data).astype(np.int64))


def op5_token_counts(docs: DataFrame, path: str) -> DataFrame:
    return (count_tokens(docs, path).withColumn("over_limit", F.col("n_tokens") > LIMIT).withColumnRenamed("id", "doc_id"))
