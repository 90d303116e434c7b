import base64
import random

import tiktoken
from hypothesis import given, settings, strategies as st

from arborix.llm.bpe import PATTERN, Encoder, RankQueue
from arborix.llm.tokens import VOCABULARY, encode

RAW = open(VOCABULARY, "rb").read()
OWN = Encoder(RAW)
PUBLIC = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}, special_tokens={})
TEXTS = ["", " ", "Hello  world\n\n\t x", "<|endoftext|>", "naïve 日本語 🙂🙂", "a" * 30_000, "ab" * 9_000 + "!" * 5_000, "don't WE'LL 12345678901234", "﻿​\x00", "é" * 4_000]


def test_against_the_public_library():
    for t in TEXTS:
        assert OWN.encode(t) == PUBLIC.encode_ordinary(t)
    assert OWN.encode(None) == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    assert OWN.encode(text) == PUBLIC.encode_ordinary(text)


def test_long_pretokens():
    rng = random.Random(4)
    for _ in range(20):
        t = "".join(rng.choice("aeinrst") for _ in range(rng.randrange(500, 4000)))
        assert OWN.encode(t) == PUBLIC.encode_ordinary(t)


def test_queue_order():
    rng, q, held = random.Random(6), RankQueue(50_000), []
    q.fill({})
    for _ in range(4000):
        if rng.random() < 0.55:
            r, p = rng.randrange(50_000), rng.randrange(100)
            q.push(r, p)
            held.append((r, p))
        elif held:
            r = q.first()
            low = min(held)
            assert (r, q.pop(r)) == low
            held.remove(low)
        else:
            assert q.first() == -1


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(90, None, "x"), (90, "twice", "x"), (None, "k", "x")]
    got = encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), "doc_id", "text").collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == sorted((str(i), PUBLIC.encode_ordinary(t or "")) for i, t, _ in rows)
    assert encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
    bad = spark.sql("select 1L as doc_id, cast(X'61FF62' as string) as text")
    assert list(encode(bad, "doc_id", "text").first().ids) == PUBLIC.encode_ordinary("a�b")
