import hashlib
import struct

import pytest

from prepkit.llm import byte_bpe as B

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def encoding():
    codec = B.codec(B.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def rows(df):
    return {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.encode_documents(df).collect()}


def expected(pairs, encoding):
    out = set()
    for d, t in pairs:
        ids = encoding.encode_ordinary(t or "")
        out.add((d, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(),
                 hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_documents_like_the_library(table, encoding):
    docs = table("documents")
    assert rows(docs) == expected([(r.doc_id, r.text) for r in docs.collect()], encoding)


def test_odd_rows(odd, empty, encoding):
    assert rows(odd) == expected([(r.doc_id, r.text) for r in odd.collect()], encoding)
    assert rows(empty) == set()


TRICKY = ["'s", " 's", "it's", "it''s", "x 'sample", "we'll've", "'LL 'll", "a\n's b", "  two", "a  b", "a \n b\n\n", "\n\nx",
          "\t\tx\t", "12ab34", "½ x² Ⅷ", "don't!!'t", " a  b", "a b", "\x1cq\x1d", "<|endoftext|> x", "日本語 テスト",
          "é ñ", "🙂🙂 🙂", "a'", "' a", " '", "''''s", "a 'd", "\r\n 'm", " ", "  ", "é's", "'re're're", "\x00 \x00"]


def test_tricky_texts_in_one_batch(spark, encoding):
    pairs = list(enumerate(TRICKY))
    df = spark.createDataFrame(pairs, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: list(r.ids) for r in B.encode_documents(df, with_ids=True).collect()}
    assert got == {d: encoding.encode_ordinary(t) for d, t in pairs}


def test_random_texts(spark, encoding):
    import random
    rnd = random.Random(4)
    alphabet = "aA'sStTlLdDmM  \n\t.é½5 日!"
    pairs = [(i, "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40)))) for i in range(3000)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = {r.doc_id: list(r.ids) for r in B.encode_documents(df, with_ids=True).collect()}
    assert got == {d: encoding.encode_ordinary(t) for d, t in pairs}


def test_a_long_text_in_pieces(spark, encoding, monkeypatch):
    monkeypatch.setattr(B, "PIECE", 50)
    import numpy as np
    text = "".join(f"word{i} it's  \n{i}é" for i in range(400)) + "x" * 500
    raw = np.frombuffer(text.encode(), np.uint8)
    codec = B.codec(B.vocabulary_path())
    parts = [codec.encode(raw, np.array([a, b]))[0] for a, b in B._pieces(raw, 0, len(raw))]
    assert len(parts) > 50
    assert np.concatenate(parts).tolist() == encoding.encode_ordinary(text)


def test_the_hash_is_minimal_and_perfect():
    codec = B.codec(B.vocabulary_path())
    places = codec.hash(codec.keys)
    assert sorted(places.tolist()) == list(range(len(codec.ranks)))
