import hashlib
import random

import pytest
from tokenizers import Tokenizer

from voxelmill.llm import bpe

ALPHABET = "abcdefghijklmnopqrstuvwxyz" * 2 + "ABCΣσςİıßéüñ'’s 0123456789²½Ⅷ٣ \t\n\x0b\x0c\r\x1c\x1d\x1f\x85\xa0   　​﻿\x00!?.,-–😀中文字áﬁǅ"


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(bpe.vocabulary()), bpe.encoder(bpe.vocabulary())


def test_random_texts_are_encoded_and_decoded_as_by_the_library(both):
    library, own = both
    picked = random.Random(3)
    for _ in range(3000):
        text = "".join(picked.choice(ALPHABET) for _ in range(picked.randint(0, 40)))
        if picked.random() < 0.2:
            text = text[:7] + picked.choice(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|"]) + text[7:]
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "a" * 3000, "ab" * 2000, "!" * 999, "the" * 1000, "é" * 500])
def test_long_and_empty_texts(both, text):
    library, own = both
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_small_stores_forget_without_harm(both, monkeypatch):
    _, own = both
    monkeypatch.setattr(bpe, "MOST_KEPT", 5)
    fresh = bpe.PrefixEncoder(bpe.vocabulary())
    text = "one two three four five six seven eight nine ten one two"
    assert fresh.encode(text) == own.encode(text)


def test_columns_of_documents(both, documents):
    library, _ = both
    clash = documents.withColumnRenamed("shard", "ids")
    rows = bpe.decode_documents(bpe.encode_documents(clash, bpe.vocabulary()), bpe.vocabulary()).collect()
    assert len(rows) == documents.count()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)


def test_digests(both, documents):
    library, _ = both
    texts = {r["doc_id"]: r["text"] or "" for r in documents.collect()}
    for r in bpe.digests(documents, bpe.vocabulary()).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_and_nothing(spark, documents):
    ids = spark.createDataFrame([(1, None), (2, [5, 6]), (3, [])], "id int, ids array<int>")
    assert [r["decoded"] for r in bpe.decode_documents(ids, bpe.vocabulary()).orderBy("id").collect()] == [None, "& '", ""]
    assert bpe.digests(documents.limit(0), bpe.vocabulary()).count() == 0


def test_one_pass_gives_what_two_give(documents):
    path = bpe.vocabulary()
    two = bpe.decode_documents(bpe.encode_documents(documents, path), path).drop("text")
    one = bpe.encode_and_decode(documents, path)
    assert sorted(one.columns) == sorted(two.columns)
    assert sorted(map(str, one.select(two.columns).collect())) == sorted(map(str, two.collect()))


def test_single_words_are_kept_once():
    """Tokens of a piece that is one word are kept with the piece, not a second time with its words."""
    own = bpe.PrefixEncoder(bpe.vocabulary())
    assert own.encode("plainly plainly") and not own.words.new and len(own.pieces.new) == 1
    assert own.encode("Plainly plainly,") == [*own.encode("plainly"), *own.encode("plainly,")] and "plainly" in own.words.new
