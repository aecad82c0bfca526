import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from slotalign.llm import lm_score
from slotalign.llm.lm_score import MU, cross_entropy_difference
from slotalign.storage import stage


def plain_losses(texts, target, share):
    """The same models with dictionaries of strings."""
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    pairs = lambda ws: list(zip(ws, ws[1:]))
    total = sum(len(split(t)) for t in texts)
    counts = Counter(w for t in texts for w in split(t))
    bigrams = Counter(p for t in texts for p in pairs(split(t)))
    vocabulary = {w for w, n in counts.items() if n >= share / 2 * total}
    kept_pairs = {p for p, n in bigrams.items() if n >= share / 2 * total}
    words = sum(len(split(t)) for t in target)

    def model(corpus):
        name = lambda w: w if w in vocabulary else None
        single, double, kept = Counter(), Counter(), Counter()
        for t in corpus:
            single.update(map(name, split(t)))
            for p in pairs(split(t)):
                if p in kept_pairs:
                    double[p] += 1
                    kept[name(p[0])] += 1
        scale = words / max(1, sum(single.values()))

        def loss(ws):
            out = 0.0
            for i, w in enumerate(ws):
                p = (single[name(w)] * scale + 0.5) / (words + 0.5 * (len(vocabulary) + 1))
                if i:
                    v = name(ws[i - 1])
                    p = (double[(ws[i - 1], w)] * scale + (single[v] * scale - kept[v] * scale + MU) * p) / (single[v] * scale + MU)
                out -= math.log(p)
            return out / len(ws)

        return loss

    near, far = model(target), model(texts)
    return [(len(split(t)), *((near(split(t)), far(split(t))) if split(t) else (None, None))) for t in texts]


def test_losses_equal_plain_models(make_docs, spark, words):
    rng = random.Random(3)
    some = words[:80]
    texts = [" ".join(rng.choice(some[:40] if i % 3 else some) for _ in range(rng.randint(1, 40))) for i in range(200)] + ["", None, "?!"]
    target = [t for i, t in enumerate(texts) if i % 3 and t]
    share = 0.004
    held = stage(spark.createDataFrame([(t,) for t in target], "text string"))
    # One task and block, so that the candidates are exactly the values over half the share.
    rows = cross_entropy_difference(make_docs(texts).coalesce(1), held, share=share).orderBy("doc_id").collect()
    for row, (n, near, far) in zip(rows, plain_losses(texts, target, share)):
        assert row.n_words == n
        if n:
            assert abs(row.target_loss - near) < 1e-4 and abs(row.background_loss - far) < 1e-4
            assert abs(row.difference - (row.target_loss - row.background_loss)) < 1e-9
        else:
            assert row.target_loss is None and row.difference is None
    inside = [r.difference for r in rows if r.doc_id % 3 and r.difference is not None]
    outside = [r.difference for r in rows if r.doc_id % 3 == 0 and r.difference is not None]
    assert sum(inside) / len(inside) < sum(outside) / len(outside)


def test_odd_rows(odd_docs, no_docs):
    target = stage(odd_docs.where("doc_id = 4").select("text"))
    rows = cross_entropy_difference(odd_docs, target).collect()
    assert len(rows) == odd_docs.count() and all((r.difference is None) == (r.n_words == 0) for r in rows)
    assert cross_entropy_difference(no_docs, target).count() == 0
    assert cross_entropy_difference(odd_docs, target.limit(0)).count() == odd_docs.count()


@pytest.fixture(scope="module")
def long_case(make_docs, spark, words):
    """Over a million words, so that a single word is far below any share that goes to all tasks."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(400_000)) for _ in range(3)]
    texts += [" ".join(rng.choice(words) for _ in range(30)) for _ in range(20)] + ["rare words a b", "rare words a b", "once", None]
    target = texts[0:1] + texts[5:12] + ["rare words a b"]
    return texts, target, make_docs(texts), stage(spark.createDataFrame([(t,) for t in target], "text string"))


def test_rare_words_and_bigrams_count(long_case):
    texts, target, documents, held = long_case
    rows = cross_entropy_difference(documents, held).orderBy("doc_id").collect()
    for row, (n, near, far) in zip(rows, plain_losses(texts, target, 0)):
        assert row.n_words == n
        if n:
            assert abs(row.target_loss - near) < 1e-6 and abs(row.background_loss - far) < 1e-6


@pytest.mark.parametrize("given", [{"hot_share": 0.01}, {"hot_share": 1.0}, {"share": 0.004}])
def test_layout_and_hot_entries_have_no_effect(make_docs, spark, words, given):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(words[:60]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    target = texts[::3]
    held = stage(spark.createDataFrame([(t,) for t in target], "text string"))
    made = [cross_entropy_difference(make_docs(texts).repartition(n), held, **given).orderBy("doc_id").collect() for n in (1, 7)]
    assert made[0] == made[1]
    for row, (n, near, far) in zip(made[0], plain_losses(texts, target, given.get("share", 0))):
        assert row.n_words == n and (not n or abs(row.target_loss - near) < 1e-6 and abs(row.background_loss - far) < 1e-6)


def test_blocks_send_each_entry_once(make_docs, spark, words, monkeypatch):
    """Blocks and ranges of any size give the same losses; what is sent is a few bytes a word, in a few rows."""
    rng = random.Random(7)
    texts = [" ".join(rng.choice(words[:300]) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    held = stage(spark.createDataFrame([(t,) for t in texts[::4]], "text string"))
    once = cross_entropy_difference(make_docs(texts), held).orderBy("doc_id").collect()
    for row, (n, near, far) in zip(once, plain_losses(texts, texts[::4], 0)):
        assert row.n_words == n and (not n or abs(row.target_loss - near) < 1e-6 and abs(row.background_loss - far) < 1e-6)
    packed = stage(lm_score.packed_blocks(spark.createDataFrame(list(enumerate(texts)), "key long, _text string").coalesce(1), 0)
                   .withColumn("block", F.lit(0).cast("long")))
    sent = lm_score.entries(packed, 5).toPandas()
    total = sum(len(t.split()) for t in texts)
    assert packed.count() == 1 and len(sent) == 5 and sent[["entries", "times", "ends"]].map(len).sum().sum() < 10 * total
    monkeypatch.setattr(lm_score, "BLOCK_WORDS", 1000)
    monkeypatch.setattr(lm_score, "RANGE_VALUES", 2000)
    assert cross_entropy_difference(make_docs(texts), held).orderBy("doc_id").collect() == once
