import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from slotalign.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, least=30, top=2000):
    counts = {}
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            own = counts.setdefault("und" if lang is None else lang, Counter())
            own[()] += len(words)
            own.update(tuple(words[i:i + k]) for k in range(1, 5) for i in range(len(words) - k + 1))
    rows = set()
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    around[p[i:i + k]] = max(around[p[i:i + k]], a)
        scored = []
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            if p not in around or 100 * around[p] < 80 * a:
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            rows.add((lang, rank, phrase.decode(), -a, l, r, f[()], -score))
    return rows


@pytest.fixture(scope="module")
def texts(words):
    rng = random.Random(8)
    fixed = ["one fixed passage of words", "New York, new york city", "the\tTHE the the", "É漢字 x", "a b;c d"]
    made = []
    for i in range(500):
        parts = [rng.choice(words[:25]) if rng.random() < 0.7 else rng.choice(fixed) for _ in range(rng.randint(0, 60))]
        made.append(rng.choice([" ", " ", "  ", "\n", ". "]).join(parts))
    return made + [None, "", " . ", "x" * 5000 + " y"]


@pytest.mark.parametrize("setting", ["usual", "small parts", "all spread", "small blocks"])
def test_equals_plain_counts(make_docs, texts, setting, monkeypatch):
    if setting == "small parts":
        monkeypatch.setattr(C, "PART_WINDOWS", 300)
    if setting == "all spread":
        monkeypatch.setattr(C, "PART_WINDOWS", 300)
        monkeypatch.setattr(C, "HOT_SHARE", 1e-9)
    if setting == "small blocks":
        monkeypatch.setattr(C, "BLOCK_WINDOWS", 50)
    langs = {i: (None, "en", "de", "und")[i % 7 % 4] for i in range(len(texts))}
    docs = make_docs(texts, langs)
    found = C.collocations(docs, top=40)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in found.collect()} == plain([(langs[i], t) for i, t in enumerate(texts)], top=40)


def test_windows_of_long_texts_are_counted_once(make_docs, words):
    rng = random.Random(6)
    text = " ".join(rng.choice(words[:30]) for _ in range(300_000)) + "."
    assert {tuple(r) for r in C.collocations(make_docs([text, text])).collect()} == plain([("en", text)] * 2)


def test_only_pairs_that_fill_a_part_are_spread(make_docs, words, monkeypatch):
    """Others would be sent one by one to be counted, and their windows not folded."""
    rng, pack, seen = random.Random(3), C.pack_windows, []
    monkeypatch.setattr(C, "pack_windows", lambda frame, parts, hot: seen.append((parts, len(hot))) or pack(frame, parts, hot))
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(50)]
    C.frequent_phrases(make_docs(texts))
    monkeypatch.setattr(C, "PART_WINDOWS", 1000)
    C.frequent_phrases(make_docs([*texts, "a b " * 3000]))
    assert seen == [(1, 0), (16, 4)]


def test_large_counts_are_exact(spark):
    counted = spark.createDataFrame([(9_007_199_254_740_993, 9_007_199_254_740_995, 2)], "a long, l long, r long")
    ratio = counted.select(F.expr(f"(CAST(a AS DECIMAL(28, 0)) * {C.FACTOR}BD) div (CAST(l AS DECIMAL(28, 0)) + r)").alias("s")).first().s
    assert ratio == 2_000_000 * 9_007_199_254_740_993 // 9_007_199_254_740_997


def test_odd_rows(odd_docs, no_docs):
    assert C.collocations(no_docs).count() == 0
    wanted = plain([(r.lang, r.text) for r in odd_docs.collect()])
    assert {tuple(r) for r in C.collocations(odd_docs).collect()} == wanted
