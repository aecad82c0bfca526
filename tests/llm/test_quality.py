import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from slotalign.llm.quality import BUCKET_BITS, DITTO, Features, QualityModel, train_quality, with_quality


def test_scores_add_up_features():
    """Against sums over features found one by one."""
    rng = np.random.default_rng(1)
    model, features = QualityModel(rng.normal(size=1 << BUCKET_BITS).astype(np.float32), 0.25), Features()
    texts = ["ab ab cd", "", "é x", "x", None, "cd"]
    alone = {}
    for text in texts:
        parts = list(features.of(pa.array([text or ""])))
        buckets = np.concatenate([b for b, _, _ in parts])
        mean = model.weights[buckets].astype(float).mean() if len(buckets) else 0.0
        alone[text] = 1 / (1 + np.exp(-(mean + 0.25)))
    together = model.scores(features, pa.array(texts))
    assert np.allclose(together, [alone[t] for t in texts])
    words, low, high = next(features.of(pa.array(["ab ab cd", "cd"])))
    assert words[1] == DITTO and words[2] == words[3] != DITTO and (low.tolist(), high.tolist()) == ([0, 3], [3, 4])


def test_held_out_accuracy(spark, make_docs, words):
    rng = random.Random(6)
    texts, marks = [], []
    for i in range(500):
        picked = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        good = rng.random() < 0.7
        bad = [w.upper() + "!!" for w in picked] if i % 2 else [w for w in picked for _ in range(9)]
        texts.append(" ".join(picked if good else bad))
        marks.append(int(good))
    docs = make_docs(texts)
    labels = spark.createDataFrame(list(enumerate(marks)) + [(0, marks[0]), (7, None), (10_000, 1)], "doc_id long, quality int")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train_quality(docs, labels, "quality", ~held_out)
    rows = with_quality(docs, model).where(held_out).select("doc_id", "score").collect()
    right = [(r.score >= 0.3) == bool(marks[r.doc_id]) for r in rows]
    assert len(rows) > 60 and sum(right) / len(right) > 0.97
    again = train_quality(docs.repartition(3), labels.repartition(2), "quality", ~held_out)
    assert np.array_equal(model.weights, again.weights)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 1), (None, 0)], "doc_id long, quality int")
    model = train_quality(odd_docs, labels, "quality", F.lit(True))
    rows = with_quality(odd_docs, model)
    assert rows.columns.count("score") == 1 and rows.where("score between 0 and 1").count() == odd_docs.count()
    none = train_quality(no_docs, labels.limit(0), "quality", F.lit(True))
    assert with_quality(no_docs, none).count() == 0
    assert {r.score for r in with_quality(odd_docs, none).collect()} == {0.5}
