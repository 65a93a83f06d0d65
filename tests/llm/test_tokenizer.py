"""Encoding against the public libraries and the defining merge procedure; exact round trips."""

import random

import pytest

from fieldmill.llm import tokenizer as tk

DATA = None
try:
    with open(tk.VOCABULARY, "rb") as f:
        DATA = f.read()
except OSError:
    pytest.skip("no vocabulary here", allow_module_level=True)

PIECES = ["a", "b", "  ", "\n", "\r\n", "\t", "\x1c", "\x85", "　", " ", "é", "한", "국", "🤖", "1", "23", "'s", "'ll", "ÿ", "​", "﻿", "́", "\xa0", "Ⅷ", "²", "<|endoftext|>", "$", "_", "-", "the", "ing", "2024-01-02T03:04:05Z", "0.123456"]


@pytest.fixture(scope="module")
def encoder():
    return tk.Encoder(DATA)


def texts(n=3000, longest=30):
    r = random.Random(5)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_equals_the_public_library(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    from public_tokenizers import PATTERN

    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=tk.read_ranks(DATA), special_tokens={})
    for text in texts():
        assert encoder.encode(text) == other.encode_ordinary(text)


def test_transducer_equals_merging_bytes(encoder):
    r = random.Random(6)
    ranks = tk.read_ranks(DATA)
    for _ in range(500):
        word = bytes(r.choice(b"abcdefeeeeettttinghs 0123456789==--\xc3\xa9\xed\x95\x9c") for _ in range(r.randint(1, 40)))
        assert encoder.machine.encode(word) == tk.merge_bytes(word, ranks)


def test_small_memory_gives_the_same(encoder):
    small = tk.Encoder(DATA, memory=3)
    small.machine.max_states = 50
    for text in texts(300):
        assert small.encode(text) == encoder.encode(text)


def test_very_long_texts(encoder):
    for text in ("word " * 300_000, "x" * 3000, " " * 5000, "\n" * 3000 + "a"):
        ids = encoder.encode(text)
        assert b"".join(encoder.machine.entries[i] for i in ids).decode() == text


def test_corpus_rows_and_round_trip(spark):
    made = [(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (4, " \n", None), (None, "한국어 텍스트", "y"), (1, "Hello world", "x")]
    df = spark.createDataFrame(made, "doc_id bigint, text string, ids string")
    out = tk.encode_corpus(df, "doc_id", "text")
    got = sorted(((r["doc_id"], r["ids"]) for r in out.collect()), key=str)
    assert len(got) == 6 and (2, []) in got and (3, []) in got and got.count((1, [15496, 995])) == 2
    back = {r["doc_id"]: r["text"] for r in tk.decode_corpus(out, "doc_id", "ids").collect()}
    assert back == {1: "Hello world", 2: "", 3: "", 4: " \n", None: "한국어 텍스트"}
    assert tk.encode_corpus(df.limit(0), "doc_id", "text").count() == 0
    counted = tk.count_tokens(df, "text").groupBy().sum("n_tokens").first()[0]
    assert counted == sum(len(x[1]) for x in got)


def test_incremental_utf8():
    r = random.Random(7)
    for _ in range(300):
        data = bytes(r.choice([0x41, 0x80, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF]) for _ in range(r.randint(0, 12)))
        machine = tk.Utf8Machine()
        cut = r.randint(0, len(data))
        got = machine.feed(data[:cut]) + machine.feed(data[cut:]) + machine.close()
        assert got == data.decode("utf-8", "replace")


def test_one_long_word_keeps_the_states_bounded():
    ranks = tk.read_ranks(DATA)
    machine, free = tk.BpeTransducer(ranks, max_states=500), tk.BpeTransducer(ranks)
    r = random.Random(1)
    word = "".join(r.choice("etaoinshrdlu") for _ in range(20_000)).encode()
    assert machine.encode(word) == free.encode(word) and len(machine.states) <= 501 < len(free.states)
