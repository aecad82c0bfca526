from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from slotalign.llm.bpe import parse_ranks, read_ranks
from slotalign.llm.token_shards import feistel_slots, read_sequences, training_shards, write_binary_shards

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=parse_ranks(read_ranks(PATH)), special_tokens={})
SEPARATOR = 50_256


@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 17, 1000, 4097])
def test_slots_are_a_permutation(count):
    slots = feistel_slots(np.arange(count), count, key=11)
    assert sorted(slots) == list(range(count))
    if count >= 1000:
        assert (slots != feistel_slots(np.arange(count), count, key=12)).mean() > 0.9
        assert abs(np.corrcoef(np.arange(count), slots)[0, 1]) < 0.1


def test_shards_hold_all_tokens_in_their_slots(make_docs, words, tmp_path):
    texts = [" ".join(words[i:i + 37 * (i % 5)]) for i in range(60)] + [None, ""]
    docs = make_docs(texts).coalesce(1)
    shards = training_shards(docs, PATH, public_tokenizers.PATTERN, 3, SEPARATOR, length=16, per_shard=32)
    tokens = []
    for text in texts:
        if text:
            tokens += LIBRARY.encode_ordinary(text) + [SEPARATOR]
    tokens += [SEPARATOR] * (-len(tokens) % 16)
    records = np.array(tokens, dtype="<u2").reshape(-1, 16)
    placed = {s: r.tobytes() for s, r in zip(feistel_slots(np.arange(len(records)), len(records), 3), records)}
    rows = shards.orderBy("shard").collect()
    assert [r.first_slot for r in rows] == [32 * i for i in range(len(rows))] and {r.stride for r in rows} == {32}
    assert b"".join(bytes(r.payload) for r in rows) == b"".join(placed[s] for s in range(len(records)))
    # Resume in the middle of a shard.
    got = {r.slot: bytes(r.record) for r in read_sequences(shards, 41, 30).collect()}
    assert got == {s: placed[s] for s in range(41, 71)}
    files = write_binary_shards(shards, f"file://{tmp_path}/out").collect()
    assert all(Path(r.path).read_bytes() == bytes(rows[r.shard].payload) for r in files) and len(files) == len(rows)
    assert len(list((tmp_path / "out").iterdir())) == len(rows)


def test_partitions_do_not_lose_tokens(make_docs, words):
    texts = [" ".join(words[i:i + 50]) for i in range(100)]
    shards = training_shards(make_docs(texts).repartition(7), PATH, public_tokenizers.PATTERN, 3, SEPARATOR, length=16, per_shard=8)
    ids = np.concatenate([np.frombuffer(bytes(r.payload), "<u2") for r in shards.collect()])
    wanted = np.concatenate([LIBRARY.encode_ordinary(t) for t in texts])
    assert np.array_equal(np.sort(ids[ids != SEPARATOR]), np.sort(wanted))


def test_odd_rows(odd_docs, no_docs):
    shards = training_shards(odd_docs, PATH, public_tokenizers.PATTERN, 3, SEPARATOR, length=64).collect()
    ids = np.concatenate([np.frombuffer(bytes(r.payload), "<u2") for r in shards])
    wanted = [t for r in odd_docs.collect() if r.text for t in LIBRARY.encode_ordinary(r.text)]
    assert np.array_equal(np.sort(ids[ids != SEPARATOR]), np.sort(wanted))
    assert training_shards(no_docs, PATH, public_tokenizers.PATTERN, 3, SEPARATOR).count() == 0
    with pytest.raises(Exception, match="token of the vocabulary"):
        training_shards(odd_docs, PATH, public_tokenizers.PATTERN, 3, 100).count()
