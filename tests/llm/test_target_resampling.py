import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from slotalign.llm.slices import blocks
from slotalign.llm.target_resampling import CUT, FeatureHasher, kth_key, resample
from slotalign.storage import stage

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, longest, buckets):
    words = WORD.findall((text or "").translate(LOWER))
    runs = [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain_resample(docs, targets, percent=10, longest=1, buckets=10_000, min_words=20):
    made = [(id, *plain_features(text, longest, buckets)) for id, text in docs]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for _, _, found in made:
        np.add.at(s, found, 1)
    for text in targets:
        np.add.at(t, plain_features(text, longest, buckets)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + buckets) / ((s[b] + 1) * (t.sum() + buckets)))) for b in range(buckets)]
    rows = []
    for id, words, found in made:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if id is None else id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([id, len(found), weight, score, words])
    able = sorted((r for r in rows if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return rows, able[:percent * len(able) // 100]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", " ", "  ", "-", "É", "漢字", "\n", "x" * 60, "9"]) | st.text(max_size=5), max_size=30).map("".join),
       st.integers(1, 3), st.sampled_from([1, 7, 1 << 20]))
def test_features_of_any_slices_are_those_of_the_text(text, longest, size):
    text = text.encode("utf-8", "ignore").decode()
    hasher = FeatureHasher(997, longest)
    for texts in ([text], ["one two", text, None, text + " " + text]):
        found = {i: [] for i in range(len(texts))}
        for block in blocks(texts, CUT, hasher.ahead, size):
            for numbers, made in hasher.features(block):
                for i, bucket in zip(numbers.tolist(), made.tolist()):
                    found[i].append(bucket)
        assert all(sorted(found[i]) == sorted(plain_features(t, longest, 997)[1]) for i, t in enumerate(texts))


@pytest.mark.parametrize("longest", [1, 2])
def test_draw_equals_a_plain_one(make_docs, words, spark, longest):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(words[:200 + i]) for _ in range(rng.randint(0, 60))) for i in range(300)] + [None, "", "!!"]
    targets = [" ".join(rng.choice(words[150:260]) for _ in range(80)) for _ in range(20)]
    target = spark.createDataFrame([(t,) for t in targets + [None]], "text string")
    rows = resample(make_docs(texts), target, percent=30, longest=longest).collect()
    wanted, drawn = plain_resample(list(enumerate(texts)), targets, 30, longest)
    assert sorted((r.doc_id, r.n_features, r.weight, r.score) for r in rows) == sorted(tuple(r[:4]) for r in wanted)
    assert [r.doc_id for r in sorted((r for r in rows if r.rank), key=lambda r: r.rank)] == [r[0] for r in drawn]


def test_repeated_rows_ties_and_null_ids(make_docs, words):
    docs = make_docs([" ".join(words[:30])] * 200).withColumn("doc_id", F.when(F.col("doc_id") > 120, F.col("doc_id") % 2))
    rows = resample(docs, make_docs([]), percent=37).collect()
    ranks = sorted(r.rank for r in rows if r.rank)
    assert len(rows) == 200 and ranks == list(range(1, 75))
    ranked = sorted((r for r in rows if r.rank), key=lambda r: r.rank)
    order = [(-r.score, r.doc_id is None, r.doc_id or 0) for r in ranked]
    assert order == sorted(order) and max(order) <= min((-r.score, r.doc_id is None, r.doc_id or 0) for r in rows if not r.rank)


def test_quickselect_finds_every_rank(spark):
    rng = random.Random(9)
    keys = [(rng.randint(0, 5), None if i % 9 == 0 else str(i), i) for i in range(400)]
    frame = stage(spark.createDataFrame(keys, "a long, b string, c long"))
    ordered = sorted(keys, key=lambda k: (k[0], k[1] is not None, k[1] or "", k[2]))
    for rank in (1, 2, 57, 200, 399, 400):
        assert kth_key(frame.withColumn("n", F.col("b").isNotNull().cast("int")), ["a", "n", "b", "c"], rank, pivots=5)[3] == ordered[rank - 1][2]
    assert kth_key(frame, ["a", "c"], 401) is None and kth_key(frame, ["a", "c"], 0) is None


def test_odd_rows(odd_docs, no_docs):
    rows = resample(odd_docs, odd_docs, percent=50).collect()
    assert len(rows) == odd_docs.count() and [r.rank for r in rows if r.rank] == [1]
    assert resample(no_docs, odd_docs).count() == 0
