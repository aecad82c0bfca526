import numpy as np
import pytest
from pyspark.sql import functions as F

from slotalign.llm import permutation_index
from slotalign.llm.permutation_index import footrule_savings, nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def frame_of(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0.5) for i, v in vectors], SCHEMA)


def brute(vectors, query, neighbours):
    scores = {i: float((v * vectors[query]).sum() / np.sqrt((v * v).sum() * (vectors[query] ** 2).sum())) for i, v in vectors.items() if i != query}
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:neighbours]


def test_savings_are_half_the_footrule_distance():
    rng = np.random.default_rng(3)
    near = np.array([rng.permutation(12)[:5] for _ in range(40)])
    order = np.argsort(near.ravel(), kind="stable")
    starts = np.searchsorted(near.ravel()[order], np.arange(13))
    saved = footrule_savings(near[0], starts, order // 5, order % 5, 40)
    for row, got in zip(near, saved):
        place = {p: k for k, p in enumerate(row)}
        own = {p: k for k, p in enumerate(near[0])}
        distance = sum(abs(own.get(p, 5) - place.get(p, 5)) for p in own.keys() | place.keys())
        assert 30 - 2 * got == distance


@pytest.mark.parametrize("block,query_bytes", [(8192, 32_000_000), (300, 2000)])
def test_recall_and_exact_scores(spark, monkeypatch, block, query_bytes):
    monkeypatch.setattr(permutation_index, "BLOCK", block)
    monkeypatch.setattr(permutation_index, "QUERY_BYTES", query_bytes)
    rng = np.random.default_rng(1)
    values = rng.normal(size=(1500, 24)).astype(np.float32)
    values[:300] = values[0] + 0.1 * values[:300]
    vectors = {i: v.astype(np.float64) for i, v in enumerate(values)}
    rows = nearest_neighbours(frame_of(spark, enumerate(values)), F.col("vec_id") % 50 == 0).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(found) == set(range(0, 1500, 50)) and all(sorted(x) == [1, 2, 3, 4, 5] for x in found.values())
    hits = 0
    for query, ranks in found.items():
        exact = brute(vectors, query, 1499)
        scores = dict(exact)
        assert all(abs(scores[i] - s) < 1e-12 for i, s in ranks.values())
        assert [ranks[k] for k in range(1, 6)] == sorted(ranks.values(), key=lambda x: (-x[1], x[0]))
        hits += len({i for i, _ in exact[:5]} & {i for i, _ in ranks.values()})
    assert hits / (5 * len(found)) >= 0.9


def test_ties_and_odd_rows(spark):
    nan = float("nan")
    same = [(i, [1.0, 2.0]) for i in range(40, 10, -1)]
    vectors = same + [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, [2.0, 1.0]), (60, None), (61, []), (62, [0.0, 0.0]), (63, [nan, 1.0]),
                      (64, [None, 1.0]), (65, [float("inf"), 1.0]), (66, [1.0]), (None, [1.0, 2.0])]
    rows = nearest_neighbours(frame_of(spark, vectors), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in rows if r.query_id == 0] == [11, 12, 13, 14, 15]
    assert [r.vec_id for r in rows if r.query_id == 50] == [0, 11, 12, 13, 14]
    assert {r.query_id for r in rows} == {0, 50}
    few = nearest_neighbours(frame_of(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0])]), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(0, 1, 1)]
    assert nearest_neighbours(frame_of(spark, []), F.lit(True)).count() == 0
    assert nearest_neighbours(frame_of(spark, [(0, [1.0])]), F.lit(True)).count() == 0
