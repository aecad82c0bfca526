import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slotalign.llm import near_dedup
from slotalign.llm import words as word_hashes
from slotalign.llm.components import connected_components
from slotalign.llm.frequent import frequent
from slotalign.llm.near_dedup import (Sampler, Weights, keep_one_of_each_class, near_duplicate_classes, shingle_extract,
                                      weighted_jaccard)
from slotalign.llm.lm_score import unpack
from slotalign.llm.words import WordHasher, distinct, shingles


def brute_classes(texts):
    """Classes by all pairs, in plain Python."""
    hasher = WordHasher()
    [words] = list(hasher.chunks(pa.array(texts)))
    hashes, times, bounds = distinct(*shingles(words, 5))
    counts = dict(zip(*np.unique(hashes, return_counts=True)))
    often = np.array(sorted(h for h, n in counts.items() if n >= near_dedup.SHARE * len(texts)), dtype=np.uint64)
    weights = Weights(often, np.array([counts[h] for h in often]), len(texts)).of(hashes, times)
    vectors = [(hashes[i:j], weights[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = texts[i] == texts[j] and texts[i]
            if find(i) != find(j) and (same or (len(vectors[i][0]) and weighted_jaccard(vectors[i], vectors[j]) >= 0.8)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.fixture(scope="module")
def corpus(words):
    """Copies, near copies with one to eight edits each, and unrelated texts that share a line."""
    rng = random.Random(9)
    line = "all rights reserved by the owner of this text"
    texts = []
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 200]))]
        for _ in range(40 if group == 0 else 4):
            copy = list(base)
            for _ in range(rng.randint(0, 8)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [line + " " + " ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    texts += ["two words", "Two  WORDS!", "two words", "", "!!!", "!!!"] + [texts[0]] * 20
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("small", [8, 1])
def test_classes_equal_all_pairs(make_docs, corpus, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", small)  # 1 sends all through the filter on rare shingles
    got = near_duplicate_classes(make_docs(corpus)).orderBy("doc_id").toPandas()
    wanted = [i if not t else c for i, (c, t) in enumerate(zip(brute_classes(corpus), corpus))]
    assert got["class_id"].tolist() == wanted
    assert "score" in got and "findings" in got


def test_samples_agree_as_often_as_texts_do():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**63, 4000).astype(np.uint64)
    weights = np.where(rng.random(4000) < 0.5, 1.0, rng.uniform(0.5, 3, 4000))
    other = np.where(rng.random(4000) < 0.3, weights * rng.uniform(0.3, 1, 4000), weights)
    sampler = Sampler(bands=600, rows=1)
    bands = [sampler.bands_of(hashes, w, np.array([0, 4000]))[0] for w in (weights, other)]
    exact = np.minimum(weights, other).sum() / np.maximum(weights, other).sum()
    assert abs((bands[0] == bands[1]).mean() - exact) < 0.06


def test_frequent_counts_are_exact(spark, words):
    rng = random.Random(2)
    texts = [" ".join(["a common run of words"] * (i % 7 == 0) + [rng.choice(words) for _ in range(9)]) for i in range(700)]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    values, counts = frequent(frame, shingle_extract, 0.05, len(texts))
    assert counts.max() == 100 and (counts >= 35).all()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


def test_odd_rows(odd_docs, no_docs):
    got = near_duplicate_classes(odd_docs).collect()
    assert sorted((r.doc_id, r.class_id) for r in got if r.doc_id is not None) == [(1, 1), (2, 2), (3, 3), (4, 4), (4, 4), (5, 5)]
    assert [r.class_id for r in got if r.doc_id is None] == [None, None]
    kept = keep_one_of_each_class(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == 7
    assert near_duplicate_classes(no_docs).count() == 0 and keep_one_of_each_class(no_docs).count() == 0


def test_long_texts_meet_by_their_rarest_shingles(spark, words):
    """Two altered copies of 200,000 words, an unrelated one as long, and short ones: one pair, found in bounded rows."""
    rng = random.Random(12)
    base = [rng.choice(words) for _ in range(200_000)]
    copy = list(base)
    for at in rng.sample(range(len(copy)), 2_000):
        copy[at] = rng.choice(words)
    texts = [" ".join(t) for t in (base, copy, [rng.choice(words) for _ in range(200_000)], base[:300], base[:280])]
    rows = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "node binary, _text string")
    placed = rows.select("node", "node").toDF("node", "component")
    no_weights = spark.sparkContext.broadcast((np.array([], np.uint64), np.array([]), len(texts)))
    found = near_dedup.prefix_pairs(rows, placed, no_weights, 0.8)
    assert {(r.a[0], r.b[0]) for r in found.collect()} == {(0, 1), (3, 4)}


def test_working_memory_of_a_task(words):
    """What a task holds beside its batch: a small part of the texts in work, however many there are."""
    rng = random.Random(14)
    texts = pa.array([" ".join(rng.choice(words) for _ in range(400)) for _ in range(2500)])  # five megabytes
    weights, sampler, hasher = Weights(np.array([], np.uint64), np.array([]), len(texts)), Sampler(), WordHasher()
    tracemalloc.start()
    for part in hasher.chunks(texts):
        sampler.bands_of(*weights.vectors(part))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6


def test_frequencies_of_all_shingles_are_exact(spark, make_docs, corpus, monkeypatch):
    """Blocks of a few texts and many ranges tell each text in how many texts each of its shingles stands."""
    texts = [t for t in corpus if t]
    [words] = list(WordHasher().chunks(pa.array(texts)))
    hashes, times, bounds = distinct(*shingles(words, 5))
    values, which, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    assert counts.max() >= 20 and (counts == 1).any() and (counts == 2).any()
    monkeypatch.setattr(word_hashes, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(near_dedup, "BLOCK_WORDS", 500)
    monkeypatch.setattr(near_dedup, "RANGE_VALUES", 1000)
    monkeypatch.setattr(near_dedup, "SAMPLED", 300)
    rows = near_dedup.with_node(make_docs(texts).select(F.col("text").alias("_text")), "_text")
    assert near_dedup.packed_blocks(rows).count() > 10
    weights = spark.sparkContext.broadcast((np.empty(0, np.uint64), np.empty(0, np.int64), len(texts)))
    got = {bytes(r.node): (r.bands, unpack(r.frequencies)) for r in near_dedup.signatures(rows, weights).collect()}
    for text, i, j in zip(texts, bounds[:-1], bounds[1:]):
        if j > i:
            bands, frequencies = got[hashlib.md5(text.encode()).digest()]
            assert frequencies.tolist() == counts[which[i:j]].tolist()
            idf = 1 - np.log(frequencies) / (2 * np.log(len(texts)))
            each = Sampler().bands_of(hashes[i:j], (1 + np.log(times[i:j])) * idf, np.array([0, j - i]))
            assert bands == each[0].view(np.int64).tolist()
    assert len(got) == len({t for t, i, j in zip(texts, bounds[:-1], bounds[1:]) if j > i})


def test_shingles_in_few_documents_weigh_less_than_those_in_one(make_docs, words):
    """A passage in eight of 1,000 texts makes two of them alike to 0.81 if it counts as unique, to 0.78 by its idf."""
    rng = random.Random(15)

    def some(n):
        return [rng.choice(words) + str(rng.randrange(10**6)) for _ in range(n)]

    passage = some(100)
    texts = [" ".join(passage + some(11)) for _ in range(2)] + [" ".join(some(150) + passage + some(150)) for _ in range(6)]
    pair = some(100)
    texts += [" ".join(pair + some(11)) for _ in range(2)]  # as long, but in two texts only
    texts += [" ".join(some(12)) for _ in range(990)]
    got = {r.doc_id: r.class_id for r in near_duplicate_classes(make_docs(texts)).collect()}
    assert got == {i: i for i in range(1000)} | {9: 8}


def test_one_row_is_kept_of_repeated_ids(odd_docs):
    """Rows are told apart by id and text together, NULL ids too."""
    kept = keep_one_of_each_class(odd_docs.unionByName(odd_docs)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted({(r.doc_id or 0, r.text or "") for r in odd_docs.collect()})
