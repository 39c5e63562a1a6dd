import random

import pytest

from lodestone.llm import encode as E

P = pytest.importorskip("public_tokenizers")
TEXTS = ["Hello world, it's 42!", "", None, " \n\t  x", "<|endoftext|>", "naïve façade — “quotes”", "中文文本。日本語テキスト", "مرحبا بالعالم", "नमस्ते दुनिया", "🙂👩‍👩‍👧 emoji", "a" * 3000, "\r\n\r\n  tail ", "﻿bom", "ab" * 999 + "c", "½ Ⅷ ²", "don't we'll I'd THEY'RE", "\x1c\x85\xa0　."]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def encode(texts):
    flat, offsets = E.encoder(E.default_vocabulary()).encode(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_equals_the_library(library):
    assert encode(TEXTS) == [e.ids for e in library.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


def test_random_texts(library):
    rng = random.Random(1)
    bits = ["a", "aa", "  ", "\n", "é", "ß", "中", "ا", "9", "12", "'s", "'ll", "_", "🙂", "‍", "\xa0", "½", "ह", "ि", "A", "\t", "the", " The"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(80))) for _ in range(1500)]
    assert encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_long_runs(library, monkeypatch):
    rng = random.Random(2)
    runs = ["".join(rng.choice(bits) for _ in range(700)) for bits in ("ab", "aaaab", "thereandin", "абв", "中文字", "etaoinshrdlu")] + ["a" * 5000, "ab" * 3000, "=" * 4097]
    texts = [f"x {r} y" for r in runs] + [" ".join(runs), "é" * 513]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encode(texts) == want
    monkeypatch.setattr(E, "LONG", 1)  # every word by heap
    monkeypatch.setattr(E, "_encoders", {})
    assert encode(texts) == want and encode(TEXTS) == [e.ids for e in library.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


def test_long_runs_are_quick(library):
    import time

    text = "".join(random.Random(3).choice("abcdefghij") for _ in range(400_000))
    began = time.perf_counter()
    got = encode([text])
    assert time.perf_counter() - began < 5
    assert got == [library.encode(text, add_special_tokens=False).ids]


def test_round_trip(library):
    for text, ids in zip(TEXTS, encode(TEXTS)):
        assert library.decode(ids, skip_special_tokens=False) == (text or "")


def test_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(E, "MEMORY", 3)
    for _ in range(3):
        assert encode(TEXTS) == [e.ids for e in library.encode_batch([t or "" for t in TEXTS], add_special_tokens=False)]


def test_table(spark, library):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(TEXTS + TEXTS[:2])], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in E.encode_documents(df).collect()}
    assert got == {k: e.ids for k, e in enumerate(library.encode_batch([t or "" for t in TEXTS + TEXTS[:2]], add_special_tokens=False))}
    assert E.encode_documents(df.limit(0)).count() == 0
    other = E.encode_documents(df, P.path("byte_bpe_multi_50k.tiktoken")).collect()
    assert {r["doc_id"]: r["ids"] for r in other} != got
