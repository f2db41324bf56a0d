"""The encoder against a library with the same vocabulary, and its texts back from the ids."""

import base64
import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sonolith.llm.bpe import PATTERN, RankQueue, encoder
from sonolith.llm.tokens import VOCABULARY, count_tokens, encode_texts

CONTENT = open(VOCABULARY, "rb").read()
OURS = encoder(CONTENT)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, CONTENT.splitlines())}
THEIRS = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_equals_library(text):
    assert OURS.encode(text) == THEIRS.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 9_000 + "é" * 999, " " * 5_000, "x\r\n\r\n  y\t", "<|endoftext|>", "🤫👨‍👩‍👧" * 300])
def test_long_and_odd(text):
    ids = OURS.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert b"".join({v: k for k, v in RANKS.items()}[i] for i in set(ids[:1])) and THEIRS.decode(ids) == text


def test_queue_gives_lowest_rank_and_leftmost():
    r, queue = random.Random(1), RankQueue()
    entries = [(r.randrange(70_000), r.randrange(1000)) for _ in range(3000)]
    for rank, at in entries:
        queue.push(rank, at)
    assert [queue.pop() for _ in entries] == sorted(entries)
    assert queue.pop() is None


def test_tables(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "two words", "x"), (4, "two words", "x")], "doc_id long, text string, ids string")
    out = encode_texts(df.select("doc_id", "text", "ids"))
    assert sorted((r.doc_id, r.ids) for r in out.collect()) == [(1, []), (2, []), (3, [220]), (4, [11545, 2456]), (4, [11545, 2456])]
    assert sorted(r.tokens for r in count_tokens(df).collect()) == [0, 0, 1, 2, 2]
    assert encode_texts(df.limit(0).select("doc_id", "text")).count() == 0
