import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folio.llm import bpe, words

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b\n\n c\t d", "<|endoftext|>x <|endoftext|>", "日本語テスト １２３ 안녕", "it's we'll 'S can't x\x1cy\x85z",
    "x's y've 'll 're z'll'd I'm 'tis rock'n'roll 's", "'", "a'", "''s", "\n's \t's  's", "a'sb c'rex d'r e'l f'll", "🙂👍🏽 é", " " * 50 + "x" * 3000,
    "\x00\x01�", "ß" * 1000, "ªº ½ 一二三 ​‍﻿", "lower" * 400,
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts() -> list[str]:
    r = random.Random(7)
    out = list(ODD)
    out += ["".join(r.choice("ab1 \n\t.,'sS<|>éß日　\x1c²Ⅷ́🙂") for _ in range(r.randint(1, 40))) for _ in range(600)]
    out += ["".join(chr(r.choice([r.randint(1, 0x2FFF), r.randint(32, 127)])) for _ in range(r.randint(1, 30))) for _ in range(600)]
    out += ["".join(r.choice("aeinrst") for _ in range(r.randint(1, 300))) for _ in range(200)]
    return out


def test_scalar_and_batch_equal_the_library(vocabulary, library):
    codec = bpe.codec(vocabulary)
    got = []
    for ids, counts in bpe.encoded(bpe.batch_encoder(vocabulary), texts()):
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    for text, batch in zip(texts(), got, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert batch == want
        assert codec.encode(text) == want
        assert codec.decode(want) == library.decode(want, skip_special_tokens=False) == text


def test_table_survives_being_emptied(vocabulary, monkeypatch):
    monkeypatch.setattr(bpe, "ENTRIES", 50)
    monkeypatch.setattr(bpe, "POOL", 200)
    small = bpe.BatchEncoder(bpe.codec(vocabulary))
    r = random.Random(1)
    for _ in range(20):
        some = [" ".join("".join(r.choice("abcde") for _ in range(4)) for _ in range(r.randint(1, 30))) for _ in range(3)]
        ids, _ = small.encode(some)
        assert ids.tolist() == [i for t in some for i in bpe.codec(vocabulary).encode(t)]


def test_pair_test_equals_merging(vocabulary):
    codec, r = bpe.codec(vocabulary), random.Random(3)

    def merged(data: bytes) -> list[int]:
        ids = [codec.tokens.index(bytes([b])) for b in data]
        while True:
            ranks = [(codec.rank[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in codec.rank]
            if not ranks:
                return ids
            k = min(ranks)[1]
            by = {t: i for i, t in enumerate(codec.tokens)}
            ids[k : k + 2] = [by[codec.tokens[ids[k]] + codec.tokens[ids[k + 1]]]]

    for _ in range(60):
        a, b = r.randrange(256, 2000), r.randrange(256, 2000)
        assert codec.fits(a, b) == (merged(codec.tokens[a] + codec.tokens[b]) == [a, b])


def test_frames(spark, vocabulary):
    rows = [(1, "Hello world", 5), (2, None, 6), (None, "", 7), (1, "Hello world", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = bpe.encode(docs, vocabulary).collect()
    assert [len(r["ids"]) for r in out] == [2, 0, 0, 2]
    back = bpe.decode(bpe.encode(docs, vocabulary).drop("text"), vocabulary).collect()
    assert [r["text"] for r in back] == ["Hello world", "", "", "Hello world"]
    trip = bpe.round_trip(docs, vocabulary).collect()
    assert [r["doc_id"] for r in trip] == [1, 2, None, 1]
    assert trip[1]["ids_sha256"] == trip[2]["decoded_sha256"] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert bpe.round_trip(docs.limit(0), vocabulary).count() == 0


def test_tables_are_dropped_when_a_task_of_another_operator_ends(vocabulary):
    bpe.batch_encoder(vocabulary)
    words.release(drop=False)  # the next task of the same operator finds them
    assert bpe.batch_encoder.cache_info().currsize and bpe.codec.cache_info().currsize
    words.release()
    assert not bpe.batch_encoder.cache_info().currsize and not bpe.codec.cache_info().currsize
