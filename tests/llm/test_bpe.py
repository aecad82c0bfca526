from array import array

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotalign.llm.bpe import bpe_decode, bpe_encode, bpe_round_trip, decode_ids, make_encoder, parse_ranks, read_ranks

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = parse_ranks(read_ranks(PATH))
LIBRARY = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODERS = [make_encoder(RANKS, public_tokenizers.PATTERN, *leaf) for leaf in ((1, 2), (3, 5), (16, 8), (1024, 256))]
PARTS = ["a", "the", "ing", " ", "  ", "\n", "\t", "'s", "'", "'re", "é", "12", "3", "!!", "...", "\x1c", " ", "漢字", "🙂", "aaaa", "\r\n"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.text(max_size=4), max_size=40).map("".join))
def test_any_tree_gives_the_library_s_ids(text):
    text = text.encode("utf-8", "ignore").decode()
    wanted = LIBRARY.encode_ordinary(text)
    assert all(encode(text).tolist() == wanted for encode in ENCODERS)
    table = [b""] * 50_256
    for token, rank in RANKS.items():
        table[rank] = token
    assert decode_ids(wanted, table, leaf_ids=2) == text.encode()


def test_long_runs():
    for text in ("a" * 5000, "thing" * 1500, " " * 4000 + "x", "!" * 3000, "\n" * 2500, "ab" * 3000 + " " * 3000):
        assert all(encode(text).tolist() == LIBRARY.encode_ordinary(text) for encode in ENCODERS)


def test_odd_rows(odd_docs, no_docs):
    encoded = bpe_encode(odd_docs, PATH, public_tokenizers.PATTERN)
    decoded = bpe_decode(encoded, PATH)
    assert decoded.columns == odd_docs.columns + ["ids", "n_tokens", "decoded"]
    for row in decoded.collect():
        assert bytes(row.decoded) == (row.text or "").encode()
        assert array("I", bytes(row.ids)).tolist() == LIBRARY.encode_ordinary(row.text or "") and len(row.ids) == 4 * row.n_tokens
    assert bpe_encode(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
    again = bpe_encode(odd_docs.withColumn("ids", F.lit(1)), PATH, public_tokenizers.PATTERN)
    assert again.schema["ids"].dataType.simpleString() == "binary"


def test_round_trip_in_one_process_equals_two_steps(odd_docs, no_docs):
    once = bpe_round_trip(odd_docs, PATH, public_tokenizers.PATTERN)
    twice = bpe_decode(bpe_encode(odd_docs, PATH, public_tokenizers.PATTERN), PATH).withColumn(
        "round_trip", F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary"))
    assert once.columns == [*[c for c in odd_docs.columns if c != "text"], "ids", "n_tokens", "round_trip"]
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.select(*once.columns).collect()))
    assert bpe_round_trip(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
