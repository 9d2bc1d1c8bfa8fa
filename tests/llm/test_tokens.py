import itertools
import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from lookthru.llm import pieces, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", "ing", "it's", "'ll", " ", "  ", "   ", "\n", "\t", " \n", "\n ", "\r\n", "é", "ß", "\U00010348", "梦", "▁", "12", "3", "<", "<s>", "http://",
         "<|endoftext|>", "###", ".", ",", "zzz", "_", "St.", " " * 36, "e" * 90, "\x00"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_bpe_ids_and_texts_equal_the_library():
    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load(MODEL)
    encoder, decoder = pieces.Encoder(model), pieces.Decoder(model)
    for text in texts(1500, 1):
        ids = encoder.encode(text)
        assert ids.tolist() == library.encode(text)
        assert decoder.decode(ids) == library.decode(ids.tolist())


def test_streaming_without_word_boundaries_holds_a_bounded_window():
    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load(MODEL)
    model.by_words = False
    encoder, widest = pieces.Encoder(model), 0
    grow = encoder._grow_bpe

    def watched(window, *rest):
        nonlocal widest
        widest = max(widest, len(window))
        grow(window, *rest)

    encoder._grow_bpe = watched
    for text in [*texts(150, 2), " ".join(texts(400, 3)), "ab" * 5000]:
        assert encoder.encode(text).tolist() == library.encode(text)
    assert widest <= pieces.BLOCK + 8 * model.longest


def test_unigram_paths_are_the_best_of_all():
    model = pieces.load(MODEL)
    rng = random.Random(4)
    model.bpe, model.ids = False, {p: i for i, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "▁", "▁a", "▁ab"])}
    model.scores, model.longest, model.floor = [rng.uniform(-9, -1) for _ in model.ids], 3, -30.0
    encoder = pieces.Encoder(model)
    for _ in range(200):
        text = "▁" + "".join(rng.choice("abcx") for _ in range(rng.randint(1, 9)))

        def total(parts):
            return sum(model.scores[model.ids[p]] if p in model.ids else model.floor if len(p) == 1 else -1e9 for p in parts)

        best = max(total([text[i:j] for i, j in zip((0, *cut), (*cut, len(text)))])
                   for n in range(len(text)) for cut in itertools.combinations(range(1, len(text)), n))
        assert abs(total(list(encoder.pieces([text]))) - best) < 1e-9


def test_encode_and_decode_tables(spark, odd):
    got = pieces.op4_pieces(odd, MODEL).collect()
    assert all(r.round_trip for r in got) and len(got) == odd.count()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((str(r.doc_id), library.encode(r.text or "")) for r in odd.collect())
    assert sorted((str(r.doc_id), r.ids) for r in got) == want and all(len(r.ids) == r.n_tokens for r in got)
    back = pieces.decode(pieces.op4_pieces(odd.filter("text is not null"), MODEL), MODEL).collect()
    assert sorted((str(r.id), r.text) for r in back) == sorted((str(r.doc_id), r.text) for r in odd.filter("text is not null").collect())
    assert pieces.op4_pieces(odd.limit(0), MODEL).collect() == []


def test_counts_equal_the_library(spark, data, odd, monkeypatch):
    library = Tokenizer.from_file(JSON)
    mixed = spark.createDataFrame(list(enumerate(texts(1200, 5))), "doc_id long, text string")
    for docs in (spark.read.parquet(f"{data}/documents.parquet"), mixed, odd):
        rows = [(r.doc_id, r.text or "") for r in docs.collect()]
        want = []
        for (i, text), found in zip(rows, library.encode_batch([t for _, t in rows], add_special_tokens=False)):
            want.append((str(i), len(text.encode()), len(found.ids), len(found.ids) > 1024))
        got = [(str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op5_token_counts(docs, JSON).collect()]
        assert sorted(got) == sorted(want)
    assert token_counts.op5_token_counts(odd.limit(0), JSON).collect() == []


def test_packed_numbers_and_texts_come_back():
    values = [b"", b"a", "é\n".encode(), b"\x00" * 9]
    assert token_counts._unpack(token_counts._pack(values)) == values and token_counts._unpack(token_counts._pack([])) == []
    assert token_counts._read(token_counts._ints(np.array([3, -1, 7]))).tolist() == [3, -1, 7]
