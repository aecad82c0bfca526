"""Loaders for whitespace-separated text chains.

Text files are split like any other Spark input. The order of the samples, which burn and thin
need, is rebuilt from the path, the start of the split and the place inside the split; these are
pinned by writing the parsed lines once, and later jobs read that table. Where several lines make a sample, they are put
together in the task that reads them; only what a split's end cuts apart is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chain import PosteriorChain, split_entries
from ..functions.columns import nan_to_null
from ..storage import add_offsets, block_sizes, join_blocks, join_in_order, stage

# Fixed values of the file layouts.
PRODUCT_SPACE_METADATA = 5      # trailing columns; the first of them holds the source count minus one
FIXED_METADATA = 4              # trailing columns
DIMENSION_FILE = "dimension_chain.dat."
DIMENSION_PARAMS = 8
LOW_NUMBER = 8                  # files with at most this many samples can be left out


def load_samples(spark: SparkSession, path: str, num_params_per_source: int, fill_value: float = math.nan,
                 burn: int = 0, thin: int = 1, remove_low_numbers: bool = False) -> PosteriorChain:
    """Load a chain, choosing the layout by what ``path`` holds.

    A folder with one file per number of sources is stacked; a file is told by its column count.
    Burn and thin do not apply to product-space files.
    """
    if _is_dimension_folder(spark, path):
        return load_samples_by_dimension(spark, path, fill_value, burn, thin, remove_low_numbers)
    columns = _first_width(spark, path)
    for metadata, load in ((PRODUCT_SPACE_METADATA, load_samples_product_space),
                           (FIXED_METADATA, load_samples_fixed_num_sources)):
        if columns > metadata and (columns - metadata) % num_params_per_source == 0:
            options = {"fill_value": fill_value} if load is load_samples_product_space else {
                "burn": burn, "thin": thin}
            return load(spark, path, num_params_per_source, **options)
    raise ValueError(f"{columns} columns in {path!r} fit neither text layout for {num_params_per_source} parameters per source")


def load_samples_product_space(spark: SparkSession, path: str, num_params_per_source: int,
                               fill_value: float = math.nan) -> PosteriorChain:
    """One row per sample, S_max*P parameters and five metadata columns."""
    lines = _parsed_lines(spark, path)
    _common_width(lines)
    return decode_product_space(_numbered(lines), num_params_per_source, fill_value)


def load_samples_fixed_num_sources(spark: SparkSession, path: str, num_params_per_source: int,
                                   burn: int = 0, thin: int = 1) -> PosteriorChain:
    """One row per sample, S*P parameters and four metadata columns."""
    lines = _parsed_lines(spark, path)
    width = _common_width(lines)
    return decode_fixed(_numbered(lines), width, num_params_per_source).get_chain(burn, thin)


def load_samples_by_dimension(spark: SparkSession, folder: str, fill_value: float = math.nan, burn: int = 0,
                              thin: int = 1, remove_low_numbers: bool = False,
                              num_params_per_source: int = DIMENSION_PARAMS) -> PosteriorChain:
    """A folder of ``dimension_chain.dat.<k>`` files in which k consecutive lines form a sample.

    The files are stacked in ascending k, and burn and thin apply to the stack.
    """
    pattern = f"{folder.rstrip('/')}/{DIMENSION_FILE}*"
    if burn < 0 or thin < 1:
        raise ValueError("burn must not be negative and thin must be at least 1")
    # One row per split; files for no source hold no samples.
    located = _data_lines(spark, pattern).withColumn("sources", _suffix()).where("sources > 0")
    width = F.size(F.split("line", r"\s+"))
    splits = stage(located.groupBy("sources", "path", "block").agg(
        F.count("*").alias("_size"), F.min(width).alias("low"), F.max(width).alias("high")))
    sizes = {int(row["sources"]): row["size"] for row in splits.groupBy("sources").agg(F.sum("_size").alias("size")).collect()}
    kept = sorted(k for k in sizes if not remove_low_numbers or sizes[k] // k > LOW_NUMBER)
    if not kept:
        asked = f" of more than {LOW_NUMBER} samples" if remove_low_numbers else ""
        raise ValueError(f"{folder!r} has no {DIMENSION_FILE}<k> file{asked}; lines by k: {sizes}")
    for sources in kept:
        if sizes[sources] % sources:
            raise ValueError(f"{DIMENSION_FILE}{sources} ends inside a sample: {sizes[sources]} lines")
    splits = splits.where(F.col("sources").isin(kept))
    low, high = splits.agg(F.min("low"), F.max("high")).first()
    if low != high:
        raise ValueError(f"rows must have one width, found {low} to {high}")
    if low != num_params_per_source:
        raise ValueError(f"lines must have {num_params_per_source} columns")
    pieces = stage(stitch_samples(located.where(F.col("sources").isin(kept)), splits, {k: sizes[k] for k in kept}, burn, thin))
    return join_pieces(pieces, kept[-1], num_params_per_source, fill_value)


def stitch_samples(located: DataFrame, splits: DataFrame, sizes: dict[int, int], burn: int, thin: int) -> DataFrame:
    """``sample_id, slot, whole, rows``: the lines of every sample, put together where they are read.

    A sample is whole unless a split ends inside it; then each split has a piece of it, which begins at ``slot``. The
    number of a line follows from its place in its split and from the lines of the splits before it.
    """
    base = _stack_starts(located.sparkSession, sizes)
    order = ["sources", "path", "block"]
    numbered = add_offsets(splits.select(*order, "_size"), order).join(F.broadcast(base), "sources").select(
        "path", "block", (F.col("_before") - F.col("line_start")).alias("_line"), "sample_start")
    values = F.split("line", r"\s+").cast("array<double>").alias("values")
    placed, in_order = join_in_order(located.select("sources", "path", "block", values), numbered, ["path", "block"])
    lines = placed.select("sources", "_line", "sample_start", "values")
    if not in_order:
        raise ValueError("the folder has more splits than can be numbered at once; set spark.sql.files.maxPartitionBytes higher")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            sources, first, start = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3))
            # A split's lines follow one another; its source count and first line name it.
            fresh = np.append(True, (np.diff(sources) != 0) | (np.diff(first) != 0))
            begin = np.flatnonzero(fresh)
            place = np.arange(len(first)) - np.repeat(begin, np.diff(begin, append=len(first)))
            if (sources[0], first[0]) == last:
                place[:begin[1] if len(begin) > 1 else len(place)] += seen
            last, seen = (sources[-1], first[-1]), int(place[-1]) + 1
            held.append((sources, start + (first + place) // sources, (first + place) % sources, batch.column(3)))
            made, rest = put_together(held, False)
            held = [rest] if rest else []
            yield made
        if held:
            yield put_together(held, True)[0]

    pieces = lines.mapInArrow(assemble, "sample_id long, slot long, whole boolean, rows array<array<double>>")
    later = F.col("sample_id") - burn
    return pieces.where((later >= 0) & (later % thin == 0)).withColumn("sample_id", F.floor(later / thin))


def put_together(held: list, ended: bool) -> tuple[pa.RecordBatch, tuple | None]:
    """Pieces of consecutive lines of one sample; the last piece is kept back if more lines may follow."""
    sources, samples, slots = (np.concatenate([part[i] for part in held]) for i in range(3))
    values = pa.concat_arrays([part[3] for part in held])
    fresh = np.append(True, (np.diff(samples) != 0) | (np.diff(slots) != 1))
    begin = np.flatnonzero(fresh)
    length = np.diff(begin, append=len(samples))
    whole = length == sources[begin]
    rest, stop = None, len(begin)
    if not ended and not whole[-1]:
        stop -= 1
        at = int(begin[-1])
        rest = (sources[at:], samples[at:], slots[at:], values[at:])
    offsets = pa.array(np.append(begin[:stop], begin[stop] if stop < len(begin) else len(samples)).astype(np.int32))
    begin = begin[:stop]
    return pa.RecordBatch.from_arrays([pa.array(samples[begin]), pa.array(slots[begin]), pa.array(whole[:stop]),
                                       pa.ListArray.from_arrays(offsets, values)], names=["sample_id", "slot", "whole", "rows"]), rest


def join_pieces(pieces: DataFrame, num_sources: int, num_params: int, fill_value: float = math.nan) -> PosteriorChain:
    """Whole samples as they are, and the pieces of the others, at most two of each split, by a shuffle."""
    ordered = F.sort_array(F.collect_list(F.struct("slot", "rows"))).getField("rows")
    cut = pieces.where("NOT whole").groupBy("sample_id").agg(F.flatten(ordered).alias("rows"))
    samples = pieces.where("whole").select("sample_id", "rows").unionByName(cut)
    present = F.transform("rows", lambda values: F.transform(values, nan_to_null))
    padding = F.array_repeat(_padding(fill_value, num_params), num_sources - F.size("rows"))
    return PosteriorChain(samples.select("sample_id", F.concat(present, padding).alias("entries")),
                          num_sources, num_params, trans_dimensional=True)


def _stack_starts(spark: SparkSession, sizes: dict[int, int]) -> DataFrame:
    """Where the lines and samples of each number of sources begin in the stack; at most one row per slot of the chain."""
    starts, line_start, sample_start = [], 0, 0
    for sources in sorted(sizes):
        starts.append((sources, line_start, sample_start))
        sample_start += sizes[sources] // sources
        line_start += sizes[sources]
    return spark.createDataFrame(starts, "sources int, line_start long, sample_start long")


def decode_product_space(rows: DataFrame, num_params: int, fill_value: float = math.nan) -> PosteriorChain:
    """A chain from ``sample_id, values`` rows in the product-space layout."""
    size = F.size("values")
    count = F.rint(F.get("values", size - PRODUCT_SPACE_METADATA) + 1).cast("int")
    fits = (count >= 0) & (count * num_params <= size - PRODUCT_SPACE_METADATA)
    checked = F.when(fits, count).otherwise(F.raise_error(F.concat(
        F.lit("a row of "), size.cast("string"), F.lit(" columns does not hold "),
        F.coalesce(count.cast("string"), F.lit("NULL")), F.lit(" sources"))).cast("int"))
    counted = rows.select("sample_id", "values", checked.alias("sources"))
    num_sources = counted.agg(F.max("sources")).first()[0]
    if num_sources is None:
        raise ValueError("the chain has no samples")
    data = F.slice("values", 1, F.col("sources") * num_params)
    present = split_entries(data, num_sources, num_params)
    padding = _padding(fill_value, num_params)
    entries = F.transform(present, lambda entry, slot: F.when(slot < F.col("sources"), entry).otherwise(padding))
    return PosteriorChain(counted.select("sample_id", entries.alias("entries")), num_sources, num_params,
                          trans_dimensional=True)


def decode_fixed(rows: DataFrame, width: int, num_params: int) -> PosteriorChain:
    """A chain from ``sample_id, values`` rows of ``width`` columns in the fixed layout."""
    num_sources, rest = divmod(width - FIXED_METADATA, num_params)
    if rest or num_sources < 1:
        raise ValueError(f"{width} columns do not hold sources of {num_params} parameters")
    entries = split_entries(F.col("values"), num_sources, num_params)
    return PosteriorChain(rows.select("sample_id", entries.alias("entries")), num_sources, num_params)


def _padding(fill_value: float, num_params: int) -> Column:
    fill = F.lit(None if math.isnan(fill_value) else float(fill_value)).cast("double")
    return F.array(*[fill] * num_params)


def _data_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that hold data: comments removed, blanks dropped."""
    text = F.trim(F.translate(F.substring_index("value", "#", 1), "\t\r", "  "))
    located = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        text.alias("line"))
    return located.where("line != ''")


def _suffix() -> Column:
    """The number that a dimension file's name ends with; another ending raises."""
    ending = F.regexp_extract("path", DIMENSION_FILE.replace(".", r"\.") + r"([^/]*)(/[^/]*)?$", 1)
    return F.when(ending.rlike(r"^\d{1,9}$"), ending.cast("int")).otherwise(F.raise_error(F.concat(
        F.lit("no source count at the end of the name of "), F.col("path"))).cast("int"))


def _parsed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines as arrays."""
    parsed = _data_lines(spark, path).select("path", "block", F.monotonically_increasing_id().alias("place"),
                                             F.split("line", r"\s+").cast("array<double>").alias("values"))
    return stage(parsed.withColumn("width", F.size("values")))


def _numbered(lines: DataFrame) -> DataFrame:
    """``sample_id`` = number of the line in the order of path, split and place."""
    place = ["path", "block"]
    blocks = add_offsets(block_sizes(lines, place, "place"), place)
    joined = join_blocks(lines, blocks, place)
    return joined.select("values", (F.col("_before") + F.col("place") - F.col("_first")).alias("sample_id"))


def _common_width(lines: DataFrame) -> int:
    low, high = lines.agg(F.min("width"), F.max("width")).first()
    if low != high or low is None:
        raise ValueError(f"rows must have one width, found {low} to {high}")
    return low


def _first_width(spark: SparkSession, path: str) -> int:
    first = _data_lines(spark, path).select(F.size(F.split("line", r"\s+"))).first()
    if first is None:
        raise ValueError(f"{path!r} holds no data")
    return first[0]


def _is_dimension_folder(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds files, or folders of part files, that are named by their number of sources."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{DIMENSION_FILE}*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return found is not None and len(found) > 0
