r"""Secret scanning through an incremental ledger of blobs, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds one row per
(blob, rule version) with the findings of that blob. A run scans only pairs which the ledger lacks, one
text per blob, appends them, and joins findings back to all paths and versions with that content.

Rules are read leftmost and without overlap, each kind for itself. Offsets are code points, the end is
exclusive. The base kinds come first, in the order of ``RULES``.

Defined results: a NULL text counts as empty and has no findings. Repeated rows, equal texts and ties share
one scan and get one result row each. An empty table gives no rows. Columns beside the text are kept as
given; a column named ``blob`` or ``findings`` is replaced. A text with very many
secrets is worked on in blocks of about the square root of their number, so its cost stays far below the square.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stage
from .joins import join_counted

RULE_VERSION = 1


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``min_chars`` applies to capture group ``group`` of each match of ``pattern``."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 0
    base: bool = False


# Minimum lengths of the two plain runs are part of their patterns: such a run is matched whole or not at
# all, so this equals matching every run and dropping the short ones, without listing the short ones.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, min_chars=8, base=True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

SPAN = "struct<start:int,kind_no:int,end:int,kind:string>"


def with_blob(versions: DataFrame, text: str = "text") -> DataFrame:
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def block_width(size: Column) -> Column:
    """Elements per block when ``size`` of them are worked on in about as many blocks as a block has elements."""
    return F.ceil(F.sqrt(size)).cast("int")


def block_starts(size: Column, width: Column) -> Column:
    return F.sequence(F.lit(0), size - 1, width)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """All values up to each one, joined; ``values`` is a non-empty array of INT.

    Appending to an array copies it, so blocks are walked one by one and their totals then carried over.
    """
    empty = F.array().cast("array<int>")

    def append(state: Column, value: Column) -> Column:
        last = F.try_element_at(state, F.lit(-1))
        return F.concat(state, F.array(F.when(last.isNull(), value).otherwise(join(last, value))))

    def of_blocks(blocks: Column) -> Column:
        totals = F.aggregate(F.transform(blocks, lambda b: F.element_at(b, -1)), empty, append)
        return let(totals, lambda t: F.flatten(F.transform(blocks, lambda block, no: F.when(no == 0, block).otherwise(
            let(F.get(t, no - 1), lambda before: F.transform(block, lambda value: join(before, value)))))))

    def of_values(all_values: Column) -> Column:
        width = block_width(F.size(all_values))
        return let(F.transform(block_starts(F.size(all_values), width), lambda at: F.aggregate(
            F.slice(all_values, at + 1, width), empty, append)), of_blocks)

    return let(values, of_values)


def spans_of(rule: Rule, kind_no: int, hits: Column, values: Column, pieces: Column) -> Column:
    """Spans from the matches and the pieces between them, whose lengths add up to the offsets."""

    # Bound here, as an expression that is used once would be put into the loop and be matched again for every span.
    found = F.struct(hits.alias("hits"), pieces.alias("pieces"), values.alias("values"))

    def spans(found: Column) -> Column:
        lengths = F.transform(found["hits"], lambda hit, i: F.char_length(F.get(found["pieces"], i)) + F.char_length(hit))
        return let(running(lengths, lambda before, length: before + length), lambda ends: F.filter(
            F.transform(found["hits"], lambda hit, i: F.struct(
                (F.get(ends, i) - F.char_length(hit)).alias("start"), F.lit(kind_no).alias("kind_no"),
                F.get(ends, i).alias("end"), F.lit(rule.kind).alias("kind"))),
            lambda _, i: F.char_length(F.get(found["values"], i)) >= rule.min_chars))

    return F.when(F.size(hits) > 0, let(found, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``blob, findings``: the spans of all rules in each text, by start and then in the order of the rules."""
    value = F.coalesce(F.col(text), F.lit(""))
    hits = blobs.select("blob", value.alias("_text"), *[
        F.regexp_extract_all(value, F.lit(rule.pattern), F.lit(0)).alias(f"_hits{i}") for i, rule in enumerate(rules)])
    cut = hits.select("blob", *[f"_hits{i}" for i in range(len(rules))], *[
        F.when(F.size(f"_hits{i}") > 0, F.split("_text", rule.pattern, -1)).alias(f"_pieces{i}")
        for i, rule in enumerate(rules)], *[
        F.when(F.size(f"_hits{i}") > 0, F.regexp_extract_all("_text", F.lit(rule.pattern), F.lit(rule.group)))
        .alias(f"_values{i}") for i, rule in enumerate(rules) if rule.group])
    spans = [spans_of(rule, i, F.col(f"_hits{i}"), F.col(f"_values{i}" if rule.group else f"_hits{i}"),
                      F.col(f"_pieces{i}")) for i, rule in enumerate(rules)]
    return cut.select("blob", F.array_sort(F.concat(*spans)).alias("findings"))


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rule_version: int, text: str = "text") -> DataFrame:
    """One ``blob, text`` row for each content that the ledger has not scanned under ``rule_version``.

    Copies are merged before the shuffle, so a text with a third of all rows costs one row per task.
    """
    contents = with_blob(versions.select(text), text)
    if ledger is not None:
        seen = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        contents = contents.join(seen, "blob", "left_anti")
    return contents.dropDuplicates(["blob"])


def extend_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES,
                  rule_version: int = RULE_VERSION, text: str = "text") -> DataFrame:
    """The ledger with the findings of all contents of ``versions``; new rows are scanned and written once."""
    fresh = scan(unseen_blobs(versions, ledger, rule_version, text), rules, text)
    written = stage(fresh.select("blob", F.lit(rule_version).alias("rule_version"), "findings"))
    return written if ledger is None else ledger.select(written.columns).unionByName(written)


def append_to_ledger(spark: SparkSession, path: str, versions: DataFrame, rules: tuple[Rule, ...] = RULES,
                     rule_version: int = RULE_VERSION, text: str = "text", first: bool = False) -> DataFrame:
    """Keep the ledger at ``path`` (Parquet) up to date with ``versions``; ``first`` starts a new one."""
    ledger = None if first else spark.read.parquet(path)
    fresh = scan(unseen_blobs(versions, ledger, rule_version, text), rules, text)
    fresh.select("blob", F.lit(rule_version).alias("rule_version"), "findings").write.parquet(
        path, mode="errorifexists" if first else "append")
    return spark.read.parquet(path)


def join_findings(versions: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION,
                  text: str = "text", all_rows: bool = True) -> DataFrame:
    """``versions`` with ``blob`` and ``findings``: every path and version gets what its content holds.

    With ``all_rows`` off, contents without findings are not looked up; their findings are NULL. Contents
    with very many copies are looked up without being moved.
    """
    addressed = with_blob(versions.drop("findings"), text)
    scanned = ledger.where((F.col("rule_version") == rule_version) & (F.lit(all_rows) | (F.size("findings") > 0)))
    copies = with_blob(versions.select(text), text).groupBy("blob").agg(F.count("*").alias("_copies"))
    side = stage(scanned.select("blob", "findings").dropDuplicates(["blob"]).join(copies, "blob"))
    return join_counted(addressed, side, "blob", "_copies", versions.count())


def describe(findings: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(findings: Column, kinds: list[str]) -> Column:
    return F.filter(findings, lambda s: s["kind"].isin(kinds))


def redact(text: Column, findings: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with every run of overlapping or touching spans replaced by one ``mask``."""

    def masked(ends: Column) -> Column:
        # What stands before each run of spans; later spans of a run have nothing before them.
        gaps = F.transform(findings, lambda span, i: F.struct(
            F.when(i == 0, 0).otherwise(F.get(ends, i - 1)).alias("since"), span["start"].alias("until"), (i == 0).alias("first")))
        gaps = F.filter(gaps, lambda gap: gap["first"] | (gap["until"] > gap["since"]))
        rest = F.substring(text, F.element_at(ends, -1) + 1, F.char_length(text))
        return F.concat(let(gaps, before_runs), rest)

    def before_runs(gaps: Column) -> Column:
        # The text is cut once for each block of gaps, and each gap out of its block.
        width = block_width(F.size(gaps))
        return F.array_join(F.transform(block_starts(F.size(gaps), width), lambda at: let(
            F.slice(gaps, at + 1, width), of_block)), "")

    def of_block(gaps: Column) -> Column:
        begin, end = F.get(gaps, 0)["since"], F.element_at(gaps, -1)["until"]
        return let(F.substring(text, begin + 1, end - begin), lambda part: F.array_join(F.transform(gaps, lambda gap: F.concat(
            F.substring(part, gap["since"] - begin + 1, gap["until"] - gap["since"]), F.lit(mask))), ""))

    ends = running(F.transform(findings, lambda span: span["end"]), lambda before, end: F.greatest(before, end))
    return F.when(F.size(findings) > 0, let(ends, masked)).otherwise(text)
