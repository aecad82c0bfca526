import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotalign.llm.token_counts import count_in_order, count_tokens, load_tokenizer, stands_alone

PATH = public_tokenizers.path("word_bpe_49k.json")
with open(PATH, "rb") as file:
    TOKENIZER = load_tokenizer(file.read())
PARTS = ["a", "the", "ing", " ", "  ", "\n", "'s", "'", "'re", "é", "é", "́" * 3, "12", "3", "!!", "===", "...", "\x1c",
         "漢字", "🙂", "aaaa", "\r\n", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "Ab", "각", "İ"]
CHUNK, OVERLAP = 700, 300


def whole(text):
    return len(TOKENIZER.encode(text or "", add_special_tokens=False))


def long_texts():
    rng = random.Random(7)
    yield from ("a" * 5000, "thing" * 900, "=" * 4000 + "x", "漢字" * 1500, "́" * 3000 + "x" * 2000, "'s" * 2000, "1" * 3000)
    yield from (" " * 4000, "<|endoftext|>" * 300, "é" * 2000, "각" * 900, "🙂" * 2000, "ab" * 1000 + " " * 3000 + "cd" * 900)
    for _ in range(20):
        yield "".join(rng.choice(PARTS) * rng.choice((1, 1, 1, 2, 40)) for _ in range(900))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=60).map("".join), st.integers(1, 60))
def test_any_splice_gives_the_library_s_count(text, times):
    text = (text.encode("utf-8", "ignore").decode()) * times
    assert count_in_order(TOKENIZER, text, chunk=CHUNK, overlap=OVERLAP) == whole(text)


def test_long_runs_and_parts_of_texts():
    for text in long_texts():
        assert count_in_order(TOKENIZER, text, chunk=CHUNK, overlap=OVERLAP) == whole(text)
        starts = [o[0] for o in TOKENIZER.encode(text, add_special_tokens=False).offsets]
        assert count_in_order(TOKENIZER, text, 900, 2500, CHUNK, OVERLAP) == sum(900 <= s < 2500 for s in starts)


def test_spread_chunks_give_the_library_s_count(make_docs):
    texts = list(long_texts()) + [None, "", "short"]
    rows = count_tokens(make_docs(texts), PATH, chunk=CHUNK, overlap=OVERLAP).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.text == texts[row.doc_id] and row.n_tokens == whole(row.text) and row.n_bytes == len((row.text or "").encode())


def test_one_text_of_many_megabytes(spark, words):
    rng = random.Random(2)
    text = " ".join(rng.choice(words) for _ in range(300_000)) + "x" * 200_000
    frame = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [r.n_tokens for r in count_tokens(frame, PATH).collect()] == [whole(text)] * 2


def test_odd_rows(odd_docs, no_docs):
    counted = count_tokens(odd_docs.withColumn("n_tokens", F.lit("own")), PATH)
    assert counted.columns == odd_docs.columns + ["n_tokens", "n_bytes"] and counted.count() == odd_docs.count()
    assert all(r.n_tokens == whole(r.text) and r.n_bytes == len((r.text or "").encode()) for r in counted.collect())
    assert count_tokens(no_docs, PATH).count() == 0
    with pytest.raises(ValueError):
        count_tokens(no_docs, PATH, chunk=500, overlap=300)


def test_boundaries_avoid_joining_characters():
    assert stands_alone("a") and stands_alone("漢") and not stands_alone("́") and not stands_alone("ᅡ")
