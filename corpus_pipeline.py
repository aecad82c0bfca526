"""A training-data pipeline over ``documents``.

Language identification, near-duplicate removal, benchmark decontamination, secret redaction, tokens.
Each stage takes what its predecessor kept and returns the columns of ``documents``; the last one returns
the tokens. Columns that a stage does not know pass through, whatever their names.

Defined results: documents without letters or without a likely language go in the first stage, so NULL and
empty texts do. NULL ids are kept. Of repeated rows one stays. Empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotalign.llm.bpe import bpe_round_trip
from slotalign.llm.decontaminate import remove_contaminated
from slotalign.llm.language import UNKNOWN, identify, train_profiles
from slotalign.llm.near_dedup import keep_one_of_each_class
from slotalign.llm.secret_scan import extend_ledger, join_findings, redact
from slotalign.storage import stage

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Rows that go to Python at once, held on both sides; whole texts have kilobytes.
BATCH_ROWS = 1000


def in_small_batches(spark: SparkSession) -> None:
    """The session's Arrow batches have ``BATCH_ROWS`` rows at most; results do not depend on it."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def prefixed(docs: DataFrame) -> DataFrame:
    """``docs`` with names that no operator uses."""
    return docs.toDF(*[f"in_{c}" for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a likely language, by their text, declared language and source."""
    in_small_batches(spark)
    named = prefixed(docs)
    profiles = train_profiles(named, "in_text", "in_lang")
    judged = identify(named, profiles, "in_text", declared="in_lang", host="in_source")
    return judged.where(F.col("language") != UNKNOWN).select(*named.columns).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies."""
    in_small_batches(spark)
    return keep_one_of_each_class(prefixed(docs), "in_doc_id", "in_text").toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold benchmark passages."""
    in_small_batches(spark)
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mask; ``n_chars`` follows the new text."""
    named = prefixed(docs)
    found = join_findings(named, extend_ledger(named, text="in_text"), text="in_text", all_rows=False)
    masked = F.when(F.size("findings") > 0, redact(F.col("in_text"), F.col("findings"))).otherwise(F.col("in_text"))
    changed = {"in_text": masked}
    if "in_n_chars" in named.columns:
        changed["in_n_chars"] = F.when(F.size("findings") > 0, F.char_length(masked)).otherwise(F.col("in_n_chars")) \
            .cast(named.schema["in_n_chars"].dataType)
    return found.withColumns(changed).select(*named.columns).toDF(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    in_small_batches(spark)
    encoded = bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "round_trip")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate),
          ("redact_secrets", redact_secrets), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
