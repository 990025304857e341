import hashlib
import random
import string

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from storepulse.llm import piece_bpe
from storepulse.llm.piece_bpe import Decoder, Encoder, decode_pieces, encode_pieces, load_pieces, round_trip
from storepulse.llm.queries import QUERIES
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def pieces():
    return load_pieces(PATH)


def test_any_text(library, pieces):
    rnd, enc, dec = random.Random(7), Encoder(pieces), Decoder(pieces)
    letters = list("abcdefghijklmnopqrstuvwxyz  ..,ABCTHE \n\t0123▁éèßñ漢字é😀\x00<>=-*_#")
    for k in range(4000):
        s = "".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 8, 30, 90]))) if k % 3 else " " * rnd.randrange(45) + rnd.choice(["a", "the", "", "\n"]) + " " * rnd.randrange(20)
        ids = enc.encode(s)
        assert ids.tolist() == library.encode(s), s
        assert dec.decode(ids) == library.decode(ids.tolist()), s


def test_words_that_need_stepping_back(library, pieces):
    enc, rnd = Encoder(pieces), random.Random(8)
    long = [t for t in pieces.texts if len(t) > 4 and t.isascii()]
    for _ in range(3000):
        s = "".join(x[rnd.randrange(3):len(x) - rnd.randrange(3)] for x in rnd.sample(long, 4))
        assert enc.encode(s).tolist() == library.encode(s), s


def test_long_runs_without_spaces(library, pieces):
    rnd, dec = random.Random(10), Decoder(pieces)
    base64 = string.ascii_letters + string.digits + "+/"
    for letters in (string.digits, string.hexdigits, base64, "".join(map(chr, range(0x4E00, 0x5E00))) + "，。"):
        s = "".join(rnd.choices(letters, k=100_000))
        for text in (s, f"see {s} and  {s[:2000]}"):
            ids = Encoder(pieces).encode(text)
            assert ids.tolist() == library.encode(text)
            assert dec.decode(ids) == text


def test_bounded_tables(library, pieces, monkeypatch):
    monkeypatch.setattr(piece_bpe, "PAIRS_KEPT", 5)
    enc, rnd = Encoder(pieces, 1000), random.Random(9)
    for _ in range(300):
        s = " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]) for _ in range(9))
        assert enc.encode(s).tolist() == library.encode(s)
        assert len(enc.by_word) <= 6 and len(enc.fits) <= 5


def test_query_equals_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op9_piece_codec"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_edges(spark, library, pieces, edge_docs, empty_docs):
    rows = round_trip(edge_docs, pieces).collect()
    assert len(rows) == 15
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids) and r.score == (None if r.n_chars is None and r.lang is None else 7)
    two = decode_pieces(encode_pieces(edge_docs, pieces), pieces)
    assert sorted(map(str, two.select("ids", "decoded").collect())) == sorted(str(r) for r in round_trip(edge_docs, pieces).select("ids", "decoded").collect())
    assert round_trip(empty_docs, pieces).count() == 0
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert decode_pieces(none, pieces).first().decoded is None
    assert Decoder(pieces).decode(np.array([], dtype=np.int32)) == ""
