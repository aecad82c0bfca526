import random

import pyarrow as pa
import pytest

from slotalign.llm import decontaminate
from slotalign.llm.decontaminate import find_overlaps, remove_contaminated
from slotalign.llm.words import WordHasher, Words


def best_overlap(doc, item):
    """Most equal words of any gapless stretch with at least 80 % equal words and the best score of its diagonal."""
    best = 0
    for shift in range(-len(item), len(doc)):
        score = begin = top = equal = 0
        stretch = (0, 0)
        for k in range(len(item)):
            same = 0 <= k + shift < len(doc) and doc[k + shift] == item[k]
            if score <= 0:
                score, begin = 0, k
            score += 1 if same else decontaminate.MISMATCH
            if score > top:
                top, stretch = score, (begin, k + 1)
        equal = sum(0 <= k + shift < len(doc) and doc[k + shift] == item[k] for k in range(*stretch))
        if equal >= 0.8 * (stretch[1] - stretch[0]):
            best = max(best, equal)
    return best


@pytest.fixture(scope="module")
def case(spark, words):
    rng = random.Random(4)
    pick = lambda n: [rng.choice(words) for _ in range(n)]
    items = [pick(n) for n in (5, 7, 8, 9, 15, 15, 30, 30, 50, 4, 0)]
    docs = [pick(80) for _ in range(20)]
    for n, item in enumerate(items[:9]):
        for edits in (0, 1 if len(item) >= 15 else 0):
            changed = list(item)
            for k in range(0, len(item), 6) if edits else ():
                changed[k] = "changed"
            docs.append(pick(10) + changed + pick(10))
    docs += [pick(5) + items[8][20:32] + pick(5), items[6][:6] + pick(40), []]
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(99, None)], "item_id long, text string")
    return items, docs, benchmark


@pytest.mark.parametrize("block_chars", [8_000_000, 150])
def test_equals_brute_force(make_docs, case, monkeypatch, block_chars):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block_chars)
    items, docs, benchmark = case
    wanted = set()
    for d, doc in enumerate(docs):
        for i, item in enumerate(items):
            if len(item) >= decontaminate.MIN_ITEM_WORDS and best_overlap(doc, item) >= min(decontaminate.MIN_MATCHED, -(-4 * len(item) // 5)):
                wanted.add((d, i))
    table = make_docs([" ".join(d) for d in docs])
    got = {(r.doc_id, r.item_id) for r in find_overlaps(table, benchmark).collect()}
    assert got == wanted and len(wanted) >= 15
    clean = {r.doc_id for r in remove_contaminated(table, benchmark).collect()}
    assert clean == set(range(len(docs))) - {d for d, _ in wanted}


def test_place_of_an_overlap(make_docs, spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    benchmark = spark.createDataFrame([(7, item), (7, item)], "item_id long, text string")
    changed = "so it goes: " + item.replace("six", "6").upper()
    [row] = find_overlaps(make_docs([changed]), benchmark).collect()
    assert (row.doc_id, row.item_id, row.doc_word, row.item_word, row.n_words, row.n_equal) == (0, 7, 3, 0, 12, 11)


def test_odd_rows(spark, odd_docs, no_docs, case):
    benchmark = case[2]
    assert find_overlaps(odd_docs, benchmark).count() == 0
    assert remove_contaminated(odd_docs, benchmark).count() == odd_docs.count()
    assert find_overlaps(no_docs, benchmark).count() == 0
    nothing = benchmark.limit(0)
    assert find_overlaps(odd_docs, nothing).count() == 0 and remove_contaminated(odd_docs, nothing).count() == odd_docs.count()


def most_equal(doc, item):
    """Most equal words of any gapless stretch with at least 80 % equal words."""
    best = 0
    for shift in range(1 - len(item), len(doc)):
        same = [0 <= k + shift < len(doc) and doc[k + shift] == item[k] for k in range(len(item))]
        for i in range(len(item)):
            equal = 0
            for j in range(i, len(item)):
                equal += same[j]
                if 5 * equal >= 4 * (j - i + 1):
                    best = max(best, equal)
    return best


def test_more_copied_text_does_not_hide_a_passage(make_docs, spark):
    item = [f"word{k}" for k in range(72)]
    copied = [w if k < 12 or k % 4 else "changed" for k, w in enumerate(item)]
    table = make_docs([" ".join(copied), " ".join(copied[:12])])
    got = {r.doc_id: r.n_equal for r in find_overlaps(table, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {0: most_equal(copied, item), 1: 12} and got[0] < sum(map(str.__eq__, copied, item))
    assert remove_contaminated(table, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("changes", [0.15, 0.2, 0.25])
def test_all_stretches(make_docs, spark, words, changes):
    rng = random.Random(9)
    items = [[rng.choice(words) for _ in range(n)] for n in (45, 59, 100) for _ in range(6)]
    docs = [["before"] * 3 + ["changed" if rng.random() < changes else w for w in item] + ["after"] * 3 for item in items]
    benchmark = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = find_overlaps(make_docs([" ".join(d) for d in docs]), benchmark).collect()
    best = {(i, i): most_equal(doc, item) for i, (doc, item) in enumerate(zip(docs, items))}
    assert {(r.doc_id, r.item_id): r.n_equal for r in rows} == {k: n for k, n in best.items() if n >= 10}
    for r in rows:
        doc, item = docs[r.doc_id][r.doc_word:][:r.n_words], items[r.item_id][r.item_word:][:r.n_words]
        assert sum(map(str.__eq__, doc, item)) == r.n_equal and doc[0] == item[0] and doc[-1] == item[-1]


@pytest.mark.parametrize("hits", [decontaminate.HITS, 3])
def test_diagonals_equal_all_pairs_of_places(words, monkeypatch, hits):
    """Runs of few different words, so that seeds repeat and follow each other."""
    monkeypatch.setattr(decontaminate, "HITS", hits)
    rng = random.Random(6)

    def text(size):
        return [w for _ in range(size) for w in [rng.choice(words[:3])] * rng.choice((1, 1, 2, 9))][:size]

    items, docs = [text(n) for n in (5, 8, 12, 30, 30, 60)], [text(rng.randint(0, 70)) for _ in range(12)]
    seeds = decontaminate.BenchmarkSeeds(pa.array([" ".join(i) for i in items]))
    [found] = WordHasher().chunks(pa.array([" ".join(d) for d in docs]))
    wanted, owner = set(), found.owner()
    for mask, postings in seeds.tables.items():
        here, at = decontaminate.seeds_within(found, mask)
        there, places = decontaminate.seeds_within(Words(0, seeds.hashes, seeds.bounds), mask)
        used = set(postings.places.tolist())
        wanted |= {(owner[i], seeds.owner[j], i - j) for s, i in zip(here, at) for t, j in zip(there, places) if s == t and j in used}
    got = [tuple(r) for r in seeds.diagonals(found).tolist()]
    assert len(got) == len(set(got)) > 500 and set(got) == wanted


def test_a_repeated_word_on_both_sides(make_docs, spark):
    item, text = ["again"] * 100, ["again"] * 60_000
    benchmark = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    [row] = find_overlaps(make_docs([" ".join(text), "another text"]), benchmark).collect()
    assert (row.doc_id, row.doc_word, row.item_word, row.n_words, row.n_equal) == (0, 0, 0, 100, 100)


@pytest.mark.parametrize("size", [5, 6, 7, 8])
def test_short_items_with_one_changed_word(make_docs, spark, size):
    item = [f"word{k}" for k in range(size)]
    docs = [["x", *item[:k], "changed", *item[k + 1:], "y"] for k in range(size)] + [item, item[1:], item[:-1], item[2:], item[1:-1]]
    benchmark = spark.createDataFrame([(size, " ".join(item))], "item_id long, text string")
    rows = find_overlaps(make_docs([" ".join(d) for d in docs]), benchmark).collect()
    assert {r.doc_id: r.n_equal for r in rows} == {i: size - (i != size) for i in range(size + 3)}
