import random
import sys
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline as pipeline  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from slotalign.llm.bpe import parse_ranks, read_ranks  # noqa: E402
from slotalign.llm.queries import QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, words, tmp_path_factory):
    """A small folder of tables whose right result is known."""
    rng = random.Random(1)
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = pick(30)
    clean = [pick(rng.randint(20, 80)) for _ in range(30)]
    edited = clean[0].split()
    edited[3] = "edited"
    secret = pick(20) + " token = abcdefgh12345678 " + pick(20)
    texts = clean + [clean[1], " ".join(edited), clean[2], pick(9) + " " + item + " " + pick(9), secret, "", None, "12 34 !!"]
    rows = [(i, t, "en", "s1", len(t or ""), "mine") for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("planted")
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = {i: t for i, t in enumerate(clean)}
    if len(clean[0].split()) < 50:  # one edit changes five of few shingles
        kept[31] = texts[31]
    kept[34] = secret
    return str(folder), texts, kept


def test_stages_and_result(spark, planted):
    folder, texts, kept = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontaminate", "redact_secrets", "tokens"]
    ids = {}
    for name, function in pipeline.STAGES:
        out = function(spark, docs, folder)
        if name != "tokens":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = pipeline.stage(out)
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    assert ids["language_id"] == set(range(35))
    assert ids["near_dedup"] == set(kept) | {33}
    assert ids["decontaminate"] == ids["redact_secrets"] == ids["tokens"] == set(kept)
    library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=parse_ranks(read_ranks(public_tokenizers.path(pipeline.RANKS))))
    rows = {r.doc_id: r for r in docs.collect()}
    for i, text in kept.items():
        wanted = library.encode_ordinary(text.replace("token = abcdefgh12345678", "[SECRET]"))
        assert rows[i].n_tokens == len(wanted) and rows[i].round_trip
    assert pipeline.run(spark, folder).count() == len(kept)


@pytest.mark.parametrize("name,function", pipeline.STAGES)
def test_stages_take_odd_rows(spark, planted, odd_docs, no_docs, name, function):
    out = function(spark, odd_docs, planted[0])
    assert out.count() <= odd_docs.count() and (name == "tokens" or out.columns == odd_docs.columns)
    assert function(spark, no_docs, planted[0]).count() == 0


@pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_query(spark, name):
    from oracle_check import differences, oracle_frame

    assert name in queries()
    result = queries()[name](spark, SF_DIR).toPandas()
    assert len(result)
    if name in oracle_sql():
        assert differences(result, oracle_frame(SF_DIR, oracle_sql()[name])) is None


def test_tokens_take_one_process_per_task_and_small_batches(spark, planted):
    docs = spark.read.parquet(f"{planted[0]}/documents.parquet")
    plan = pipeline.tokens(spark, docs, planted[0])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= pipeline.BATCH_ROWS


def test_numbered_queries_are_all_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and "pipeline" in queries()
