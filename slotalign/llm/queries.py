"""The registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stage
from .bpe import bpe_decode, bpe_encode
from .collocations import collocations
from .decontaminate import find_overlaps
from .language import identify, page_evidence, train_profiles
from .lm_score import cross_entropy_difference
from .near_dedup import near_duplicate_classes
from .permutation_index import nearest_neighbours
from .pseudonyms import KINDS, pseudonymise
from .quality import train_quality, with_quality
from .secret_scan import RULES, describe, extend_ledger, join_findings, of_kinds
from .target_resampling import resample
from .token_counts import count_tokens
from .token_shards import training_shards

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe_encode(texts, ranks, public_tokenizers.PATTERN).drop("text")
    return bpe_decode(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, scanned once per content and joined back to all documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("findings")
    base = of_kinds(found, [rule.kind for rule in RULES if rule.base])
    return join_findings(documents, extend_ledger(documents)).select("doc_id", *[
        F.size(of_kinds(found, [kind])).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")],
        F.sha2(describe(base), 256).alias("base_sha256"), describe(found).alias("spans"))


def span_list_sql(rule_no: int) -> str:
    rule = RULES[rule_no]
    hits, pieces, long_enough = f"h{rule_no}", f"p{rule_no}", f"length(v{rule_no}[i]) >= {rule.min_chars}"
    before = f"list_sum(list_transform({pieces}[1:i], lambda x: length(x)))"
    return f"""list_transform(list_filter(range(1, len({hits}) + 1), lambda i: {long_enough}), lambda i: {{
        'start': {before} + coalesce(list_sum(list_transform({hits}[1:i - 1], lambda x: length(x))), 0),
        'no': {rule_no}, 'kind': '{rule.kind}',
        'end': {before} + list_sum(list_transform({hits}[1:i], lambda x: length(x)))}})"""


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def described_sql(condition: str) -> str:
    return (f"array_to_string(list_transform(list_filter(spans, lambda s: {condition}), "
            "lambda s: concat(s.kind, ':', s.start::BIGINT, ':', s.end::BIGINT)), ',')")


ORACLES["op7_secret_spans"] = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, {', '.join(
    f"regexp_extract_all(text, {quoted(r.pattern)}) AS h{i}, string_split_regex(text, {quoted(r.pattern)}) AS p{i}, "
    f"regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS v{i}" for i, r in enumerate(RULES))} FROM texts),
found AS (SELECT doc_id, list_sort(flatten([{', '.join(span_list_sql(i) for i in range(len(RULES)))}])) AS spans FROM cut)
SELECT doc_id, {', '.join(f"len(list_filter(spans, lambda s: s.kind = '{k}'))::BIGINT AS n_{k}"
                          for k in ('assign', 'access', 'hex'))},
    sha256({described_sql('s.no < 3')}) AS base_sha256, {described_sql('true')} AS spans
FROM found"""


@query
def op2_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark passages, with the items and the places."""
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return near_duplicate_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op5_page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page from its text, markup, address and host; profiles are learned from documents."""
    profiles = train_profiles(table(spark, sf_dir, "documents"))
    return identify(page_evidence(table(spark, sf_dir, "pages")), profiles, "visible", declared="declared",
                    suffix="suffix", host="host", domain="domain", keep=["page_id", "declared", "host"])


@query
def op4_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document; a fifth of the ids is never learned from."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = train_quality(documents, table(spark, sf_dir, "labels"), "quality", ~held_out)
    return with_quality(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for each query vector."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op9_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much likelier every document is among those labelled good than among all."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Labels grow with the documents, so both sides are shuffled at every size.
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().hint("merge")
    target = stage(documents.join(good, "doc_id", "left_semi").select("text"))
    return cross_entropy_difference(documents, target).drop("text")


@query
def op3_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of all documents' tokens in training order."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    shards = training_shards(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, key=20240229, separator=50256)
    return shards.withColumn("payload_sha256", F.sha2("payload", 256))


@query
def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how much of each kind there was."""
    made = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="corpus key 1")
    return made.select("doc_id", "text", *[
        F.size(of_kinds(F.col("found"), [kind])).cast("long").alias(f"n_{kind}") for kind in KINDS])


MAX_TOKENS = 2048


@query
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes and tokens of every document, and whether it is longer than a context."""
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))


@query
def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by how much their words look like those of the benchmark."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# The SQL below forms CRC-32 over the hexadecimal form of a word's bytes, by the table of the reflected polynomial.

ORACLES["op12_target_resampling"] = f"""
WITH entries AS (SELECT list(c ORDER BY i) AS entries FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
  FROM range(256) t(i))),
words AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
  UNION ALL
  SELECT 'b', 0, regexp_extract_all({LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
used AS (SELECT side, id, unnest(words) AS word FROM words),
each AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM used)),
bucket AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM each CROSS JOIN entries),
s AS (SELECT bucket, count(*) AS s FROM used JOIN bucket USING (word) WHERE side = 'd' GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM used JOIN bucket USING (word) WHERE side = 'b' GROUP BY 1),
totals AS (SELECT count(*) FILTER (side = 'd') AS all_s, count(*) FILTER (side = 'b') AS all_t FROM used),
gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (all_s + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (all_t + 10000))::DOUBLE)) AS gain
  FROM s FULL JOIN t USING (bucket) CROSS JOIN totals),
sums AS (SELECT id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight
  FROM used JOIN bucket USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN sums ON id = doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
    CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END::BIGINT AS rank FROM ranked"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of every language of the documents."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER_SQL}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
each AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM words),
starts AS (SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4
  FROM each WINDOW p AS (PARTITION BY piece ORDER BY i)),
totals AS (SELECT lang, count(*) AS n FROM starts GROUP BY 1),
counted AS (
  SELECT lang, w1 AS p, count(*) AS f FROM starts GROUP BY 1, 2
  UNION ALL SELECT lang, w1 || ' ' || w2, count(*) FROM starts WHERE w2 IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, count(*) FROM starts WHERE w3 IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM starts WHERE w4 IS NOT NULL GROUP BY 1, 2),
phrases AS MATERIALIZED (SELECT lang, p AS phrase, string_split(p, ' ') AS p, f FROM counted WHERE f >= 30),
candidates AS (SELECT lang, p, f AS a FROM phrases WHERE len(p) > 1),
parted AS MATERIALIZED (SELECT lang, p, a, k, array_to_string(p[:k], ' ') AS first, array_to_string(p[k + 1:], ' ') AS rest
  FROM candidates JOIN range(1, 4) s(k) ON k < len(p)),
cuts AS MATERIALIZED (SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score FROM parted c
  JOIN phrases x ON x.lang = c.lang AND x.phrase = first JOIN phrases y ON y.lang = c.lang AND y.phrase = rest),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_ones AS (SELECT c.lang, c.p[i:i + k - 1] AS p, max(c.a) AS most FROM candidates c
  JOIN range(2, 4) s(k) ON k < len(c.p) JOIN range(1, 4) t(i) ON i + k - 1 <= len(c.p) GROUP BY 1, 2),
kept AS (SELECT w.* FROM worst w LEFT JOIN inner_ones USING (lang, p) WHERE most IS NULL OR 100 * most < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM kept)
SELECT lang, rank, array_to_string(p, ' ') AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""
