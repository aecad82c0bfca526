import random

import numpy as np
import pyarrow as pa
import pytest

from slotalign.llm.language import PRIOR_WEIGHT, UNKNOWN, identify, page_evidence, train_profiles, trigrams

SYLLABLES = {"aa": ["ba", "do", "ki", "lu"], "bb": ["sch", "ung", "ein", "ver"], "cc": ["eau", "tion", "ou", "ment"]}


@pytest.fixture(scope="module")
def sample(make_docs):
    rng = random.Random(2)
    langs = {i: rng.choice(["aa", "aa", "bb", "cc"]) for i in range(240)}
    text = lambda lang, n: " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(3)) for _ in range(n))
    texts = [text(langs[i], rng.choice([3, 30])) for i in range(240)]
    return texts, langs, make_docs(texts, langs, {i: f"host {langs[i] if i % 3 else 'mixed'}" for i in range(240)})


def test_posterior_equals_plain_arithmetic(sample):
    """Text, declared language and host priors without the row's own count, computed row by row."""
    texts, langs, docs = sample
    profiles = train_profiles(docs)
    rows = {r.doc_id: r for r in identify(docs, profiles, "text", declared="lang", host="source").collect()}
    names = profiles.languages
    evidence = np.array([[profiles.log_probabilities[k][trigrams(pa.array([t]))[0]].astype(float).sum()
                          / np.sqrt(len(trigrams(pa.array([t]))[0])) for k in range(len(names))] for t in texts])
    soft = np.exp(evidence - evidence.max(1, keepdims=True))
    soft /= soft.sum(1, keepdims=True)
    total = len(texts)
    base = (soft.sum(0) + 1) / (total + len(names))
    hosts = [f"host {langs[i] if i % 3 else 'mixed'}" for i in range(total)]
    for i in range(total):
        same = [j for j in range(total) if langs[j] == langs[i]]
        declared = np.log((soft[same].sum(0) + len(same) / total) / (base * total + 1))
        others = np.maximum(0, soft[[j for j in range(total) if hosts[j] == hosts[i]]].sum(0) - soft[i])
        prior = (others + PRIOR_WEIGHT * base) / (others.sum() + PRIOR_WEIGHT)
        score = evidence[i] + declared + np.log(prior)
        posterior = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        assert abs(rows[i].probability - posterior.max()) < 1e-6 and rows[i].language == names[posterior.argmax()]
    assert np.mean([rows[i].language == langs[i] for i in range(total)]) > 0.99


def test_evidence_of_pages(spark):
    pages = spark.createDataFrame([
        (1, "https://User@M.Shop.example.DE:80/x?y", "<!doctype html><HTML class=a LANG='De-at'><script>var en</script><p>Guten&nbsp;Tag<!-- no -->"),
        (2, None, None), (3, "nonsense", "<html><body>x")], "page_id long, url string, html string")
    one, two, three = page_evidence(pages).orderBy("page_id").collect()
    assert (one.declared, one.host, one.domain, one.suffix) == ("de", "m.shop.example.de", "example.de", "de")
    assert one.visible.split() == ["Guten", "Tag"]
    assert (two.declared, two.host, two.visible) == (None, None, None) and (three.declared, three.host) == (None, None)


def test_odd_rows(sample, odd_docs, no_docs):
    profiles = train_profiles(sample[2])
    rows = identify(odd_docs, profiles, "text", declared="lang", suffix="node", host="source", domain="source")
    assert rows.columns == odd_docs.columns + ["language", "probability"] and rows.count() == odd_docs.count()
    assert {r.language for r in rows.collect() if r.doc_id in (1, 2, 3)} == {UNKNOWN}
    assert identify(no_docs, profiles, "text", host="source").count() == 0
    nothing = train_profiles(no_docs)
    assert {r.language for r in identify(odd_docs, nothing, "text").collect()} == {UNKNOWN}
