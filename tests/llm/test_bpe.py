import hashlib

import pytest
from tokenizers import Tokenizer

from tidemark.llm.bpe import default_vocabulary, encode_decode, loaded

ODD = ["", "<|endoftext|>", "a<|endoftext|>b<|endoftext|><|endoftext|>", "<|endof", "aaaaaaa aaaa ananan eded", "  x\n\n  y\t", "日本語 ééé 😀😀 don't I'll", " 　 a", "a" * 5000, "́e\x00\x7f"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def test_words_equal_the_library(library):
    bpe = loaded(open(default_vocabulary(), encoding="utf-8").read())
    words = [" the", "ananananan", "aaaaaaaa", " pneumonia", "x", "éé", "\n\n\n"]
    ids, n = bpe.encode_words([w.encode() for w in words])
    assert n.sum() == len(ids)
    at = 0
    for w, k in zip(words, n):
        assert ids[at : at + k].tolist() == library.encode(w, add_special_tokens=False).ids
        at += k


def test_round_trip_equals_the_library(spark, documents, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (100, None), (None, "x")] + [(1000 + r.doc_id, r.text) for r in documents.collect()]
    got = encode_decode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    for r in got:
        want = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_odd_tables(spark, odd):
    got = encode_decode(odd, with_ids=False)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == odd.count()
    assert encode_decode(odd.limit(0)).count() == 0
    assert {r.n_tokens for r in got.where("doc_id in (1, 2)").collect()} == {0}
