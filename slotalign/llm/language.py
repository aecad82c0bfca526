"""Language identification by fusing Bayesian evidence.

For each row and language, ``log p(language | host) + log p(declared | language) + log p(suffix | language)
+ sqrt(n) * mean log p(letters | language)`` is normalised over the languages.

* The text model is a table of letter trigrams, hashed to 2^16 buckets, per language, counted over all
  labelled texts. Trigrams of a text depend on each other, hence the square root of their number.
* What the text alone says gives soft counts. Grouped sums of them give the chance of a declared language
  or an address suffix under each language, and priors: that of a host is smoothed with its domain's, and
  that with the overall one. A row's own count is taken out of its host's and domain's sums.

Defined results: a row whose text is NULL, empty or without letters, or whose best language has a
probability under ``MIN_PROBABILITY``, gets the language ``und``. A NULL declared language, suffix or host is no
evidence. Of equally likely languages the first by name wins. Repeated rows are judged alike. An empty
table gives no rows; without any labelled text all rows are ``und``. Columns named like the results are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stage
from .arrow import add_columns, small_slices
from .joins import join_counted

BUCKET_BITS = 16
MIN_PROBABILITY = 0.5
PRIOR_WEIGHT = 5.0
UNKNOWN = "und"


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of a few texts, and the bounds of each text."""
    lowered = pc.binary_join_element_wise(pc.utf8_lower(pc.fill_null(texts, "")), "\n", "")
    lowered = lowered.combine_chunks() if isinstance(lowered, pa.ChunkedArray) else lowered
    kind = np.int64 if pa.types.is_large_string(lowered.type) else np.int32
    offsets = np.frombuffer(lowered.buffers()[1], kind)[lowered.offset:lowered.offset + len(lowered) + 1].astype(np.int64)
    codes = np.arange(256, dtype=np.uint32)
    letters = np.where((codes >= 128) | ((codes >= 97) & (codes < 123)), codes, 32).astype(np.uint32)
    data = letters[np.frombuffer(lowered.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]]
    offsets = offsets - offsets[0]
    middle = np.flatnonzero(data[1:-1] != 32) + 1  # texts end in a blank, so none runs into the next
    joint = (data[middle - 1] << np.uint32(16)) | (data[middle] << np.uint32(8)) | data[middle + 1]
    buckets = (joint * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)
    return buckets, np.searchsorted(middle, offsets)


@dataclass(frozen=True)
class Profiles:
    """Log probabilities of trigram buckets, one row per language."""

    languages: list[str]
    log_probabilities: np.ndarray


def train_profiles(labelled: DataFrame, text: str = "text", language: str = "lang") -> Profiles:
    """Profiles from all rows that have a text and a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in small_slices(batch):
                buckets, bounds = trigrams(part.column(1))
                for name, low, high in zip(part.column(0).to_pylist(), bounds[:-1], bounds[1:]):
                    if name not in counts:
                        counts[name] = np.zeros(1 << BUCKET_BITS, np.int64)
                    counts[name] += np.bincount(buckets[low:high], minlength=1 << BUCKET_BITS) if high - low > 4096 else 0
                    if high - low <= 4096:
                        np.add.at(counts[name], buckets[low:high], 1)
        for name, numbers in counts.items():
            seen = np.flatnonzero(numbers)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen)), pa.array(seen.astype(np.int32)),
                                              pa.array(numbers[seen])], names=["language", "bucket", "n"])

    rows = labelled.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(language, text) \
        .mapInArrow(run, "language string, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n")) \
        .toArrow()  # at most 2^16 rows per language
    names = sorted(set(rows["language"].to_pylist()))
    counts = np.full((len(names), 1 << BUCKET_BITS), 0.05)
    place = {name: i for i, name in enumerate(names)}
    counts[[place[n] for n in rows["language"].to_pylist()], rows["bucket"].to_numpy()] += rows["n"].to_numpy()
    return Profiles(names, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def with_text_evidence(frame: DataFrame, profiles: Profiles, text: str) -> DataFrame:
    """``frame`` with ``_evidence``, the weighted log likelihood per language, NULL without letters."""
    shared = frame.sparkSession.sparkContext.broadcast(profiles.log_probabilities)

    def work():
        table = shared.value

        def each(part: pa.RecordBatch) -> list[pa.Array]:
            buckets, bounds = trigrams(part.column(text))
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes > 0)
            scores = np.zeros((len(sizes), len(table)))
            for i, row in enumerate(table):
                if len(full):
                    scores[full, i] = np.add.reduceat(row[buckets], bounds[:-1][full], dtype=np.float64)
            scores /= np.sqrt(np.maximum(sizes, 1))[:, None]
            lists = pa.ListArray.from_arrays(
                np.arange(0, scores.size + 1, scores.shape[1], dtype=np.int32) if scores.shape[1]
                else np.zeros(len(sizes) + 1, np.int32), pa.array(scores.ravel()),
                mask=pa.array((sizes == 0) | (scores.shape[1] == 0)))
            return [lists]

        return each

    return add_columns(frame, {"_evidence": T.ArrayType(T.DoubleType())}, work)


def softmax(scores: Column) -> Column:
    raised = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda a, b: a + b))


def add_up(frame: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Sums of the soft counts ``_soft`` by ``keys``, as ``_sums`` and ``_rows``."""
    sums = [F.coalesce(F.sum(F.get("_soft", i)), F.lit(0.0)).alias(f"_s{i}") for i in range(size)]
    rows = frame.groupBy(*keys) if keys else frame.groupBy()
    return rows.agg(F.count("*").alias("_rows"), *sums).select(*keys, "_rows", F.array(*[f"_s{i}" for i in range(size)]).alias("_sums"))


def identify(frame: DataFrame, profiles: Profiles, text: str, declared: str | None = None, suffix: str | None = None,
             host: str | None = None, domain: str | None = None, min_probability: float = MIN_PROBABILITY,
             keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) with ``language`` and its ``probability``."""
    size = len(profiles.languages)
    keep = [c for c in (keep if keep is not None else frame.columns) if c not in ("language", "probability")]
    if not size:
        return frame.select(*keep, F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("probability"))
    used = {"_declared": declared, "_suffix": suffix, "_host": host, "_domain": domain}
    carried = [] if text in keep else [F.col(text).alias("_text")]
    wide = frame.select(*keep, *carried, *[
        (F.col(c) if c else F.lit(None)).cast("string").alias(n) for n, c in used.items()])
    evidence = with_text_evidence(wide, profiles, "_text" if carried else text).drop("_text")
    evidence = evidence.withColumn("_soft", softmax(F.col("_evidence")))

    # One aggregation over the combinations of what is known beside the text; all else comes from it.
    grouped = stage(add_up(evidence.where("_soft IS NOT NULL"), list(used), size))
    resum = [F.sum(F.get("_sums", i)).alias(f"_s{i}") for i in range(size)]

    def level(keys: list[str]) -> DataFrame:
        rows = grouped.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)) if keys else grouped
        return rows.groupBy(*keys).agg(F.sum("_rows").alias("_rows"), *resum)

    overall = level([]).first()
    total = int(overall["_rows"] or 0)
    base = [(float(overall[f"_s{i}"] or 0.0) + 1.0) / (total + size) for i in range(size)]

    def likelihood(key: str, name: str) -> DataFrame:
        # log p(value | language), smoothed with the share of the value in all rows
        terms = [F.log((F.col(f"_s{i}") + F.col("_rows") / F.lit(float(max(total, 1)))) / F.lit(base[i] * total + 1.0))
                 for i in range(size)]
        return stage(level([key]).select(key, "_rows", F.array(*terms).alias(name)))

    result = evidence
    for key, name in (("_declared", "_of_declared"), ("_suffix", "_of_suffix")):
        if used[key]:
            result = join_counted(result, likelihood(key, name), key, "_rows", total)
        else:
            result = result.withColumn(name, F.lit(None).cast("array<double>"))
    sums = F.array(*[f"_s{i}" for i in range(size)])
    for key, name in (("_domain", "_in_domain"), ("_host", "_in_host")):
        if used[key]:
            result = join_counted(result, stage(level([key]).select(key, "_rows", sums.alias(name))), key, "_rows", total)
        else:
            result = result.withColumn(name, F.lit(None).cast("array<double>"))

    def smoothed(name: str, parent: Column) -> Column:
        others = F.zip_with(name, "_soft", lambda all_rows, own: F.greatest(F.lit(0.0), all_rows - F.coalesce(own, F.lit(0.0))))
        known = F.aggregate(others, F.lit(0.0), lambda a, b: a + b)
        prior = F.zip_with(others, parent, lambda n, p: (n + PRIOR_WEIGHT * p) / (known + PRIOR_WEIGHT))
        return F.when(F.col(name).isNull() | F.col("_soft").isNull(), parent).otherwise(prior)

    result = result.withColumn("_prior", smoothed("_in_domain", F.array(*[F.lit(p) for p in base])))
    result = result.withColumn("_prior", smoothed("_in_host", F.col("_prior")))
    nothing = F.array(*[F.lit(0.0)] * size)
    scores = F.zip_with("_evidence", F.transform("_prior", lambda p: F.log(p)), lambda a, b: a + b)
    for name in ("_of_declared", "_of_suffix"):
        scores = F.zip_with(scores, F.coalesce(name, nothing), lambda a, b: a + b)
    result = result.withColumn("_posterior", softmax(scores))
    best = F.array_max("_posterior")
    names = F.array(*[F.lit(n) for n in profiles.languages])
    sure = F.col("_evidence").isNotNull() & (best >= min_probability)
    return result.select(*keep, F.when(sure, F.get(names, (F.array_position("_posterior", best) - 1).cast("int")))
                         .otherwise(UNKNOWN).alias("language"), F.coalesce(best, F.lit(0.0)).alias("probability"))


def page_evidence(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with what the markup and the address say: ``declared``, ``host``, ``domain``, ``suffix``, ``visible``."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    visible = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[A-Za-z#0-9]+;", " ")
    named = pages.withColumn("host", F.nullif(host, F.lit("")))
    return named.withColumns({
        "declared": F.nullif(declared, F.lit("")), "visible": visible,
        "domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})
