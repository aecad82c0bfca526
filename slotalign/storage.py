"""Written tables in the shared checkpoint folder, and row numbering on top of them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A broadcast side is one row per written block, some hundred bytes each with a path, or some tens with a number;
# above this size Spark chooses the join.
MAX_BROADCAST_BYTES = 128_000_000

_local_root: str | None = None


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only for local masters."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="slotalign-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return _local_root


def stage(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared folder and read it back.

    Later jobs scan columnar files instead of repeating the lineage, and a lost executor costs
    one re-read of its splits.
    """
    spark = frame.sparkSession
    path = f"{checkpoint_root(spark)}/staged-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def block_sizes(staged: DataFrame, block: list[str], place: str) -> DataFrame:
    """One row per block (file split or written partition): its first place and its row count."""
    return staged.groupBy(*block).agg(F.min(place).alias("_first"), F.count("*").alias("_size"))


def add_offsets(sizes: DataFrame, block_order: list[str]) -> DataFrame:
    """The number of rows in all earlier blocks; the unpartitioned window runs over blocks only."""
    earlier = Window.orderBy(*block_order).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0).cast("long")))


def join_blocks(staged: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """Attach per-block values; the blocks are written once, and broadcast if their size allows it."""
    return join_in_order(staged, blocks, on)[0]


def join_in_order(rows: DataFrame, blocks: DataFrame, on: list[str]) -> tuple[DataFrame, bool]:
    """As ``join_blocks``, and whether the rows stayed in their order, as they do in a broadcast."""
    written = stage(blocks)
    keys = F.sum(sum((F.length(F.col(c).cast("string")) for c in on), F.lit(48)))
    small = (written.agg(keys).first()[0] or 0) <= MAX_BROADCAST_BYTES
    return rows.join(F.broadcast(written) if small else written, on), small


# Ids of one bitmap, and how many a bitmap must hold on average to be worth its four kilobytes.
BITMAP_BITS = 1 << 15
BITMAP_BYTES = BITMAP_BITS // 8 + 64
MIN_IDS_PER_BITMAP = 512


def number_ids(frame: DataFrame, ids: DataFrame | None = None, key: str = "sample_id") -> DataFrame:
    """``frame`` with its unique whole-number ``key`` replaced by the rank of it, without moving a row of ``frame``.

    The ids become one bit each: a bitmap per stretch of 32,768 of them, with the number of ids before it. A rank is that
    number and the bits below. ``ids`` may name the ids in another frame, in which each occurs once or more often, for
    instance the rows that ``frame`` was grouped from; their partial bitmaps are dense if ids come in order. Bitmaps are
    broadcast if their size allows it. Ids that are NULL, repeated or far apart are numbered by sorting.
    """
    named = frame if ids is None else ids
    stretch, place = F.shiftright(key, 15), F.col(key).bitwiseAND(BITMAP_BITS - 1)
    maps = stage(named.select(stretch.alias("_stretch"), place.alias("_bit")).groupBy("_stretch").agg(
        F.bitmap_construct_agg("_bit").alias("_bits"), F.count("*").alias("_rows"), F.count("_bit").alias("_known"))
        .withColumn("_size", F.bitmap_count("_bits")))
    found = maps.agg(F.count("*").alias("maps"), F.sum("_size").alias("ids"), F.sum("_rows").alias("rows"), F.sum("_known").alias("known")).first()
    unique = ids is not None or found["ids"] == found["rows"]
    if found["maps"] and (found["known"] < found["rows"] or not unique or found["ids"] < MIN_IDS_PER_BITMAP * (found["maps"] - 1)):
        return number_rows(frame, [key])
    before = add_offsets(maps.select("_stretch", "_size"), ["_stretch"]).drop("_size")
    ranks = stage(maps.select("_stretch", "_bits").join(before, "_stretch"))
    ranks = F.broadcast(ranks) if found["maps"] * BITMAP_BYTES <= MAX_BROADCAST_BYTES else ranks
    joined = frame.withColumn("_stretch", stretch).join(ranks, "_stretch")
    # Whole bytes below the id's bit, then the lower bits of its own byte.
    whole = F.shiftright(place, 3).cast("int")
    own = F.conv(F.hex(F.substring("_bits", whole + 1, F.lit(1))), 16, 10).cast("int")
    lower = own.bitwiseAND(F.expr(f"shiftleft(1, cast({key} & 7 AS INT)) - 1"))
    rank = F.col("_before") + F.bitmap_count(F.substring("_bits", F.lit(1), whole)) + F.bit_count(lower)
    return joined.select(rank.cast("long").alias(key), *[c for c in frame.columns if c != key])


def number_rows(frame: DataFrame, order_by: list[str], into: str = "sample_id") -> DataFrame:
    """Dense 0-based row numbers in the order of ``order_by``, without a single-task window.

    Rows are range partitioned and sorted, the partition number and the place inside it are
    pinned by writing them, and the partition sizes are turned into offsets. Range partitioning reads
    its input twice, so that is written first.
    """
    placed = (
        stage(frame).repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    staged = stage(placed)
    blocks = add_offsets(block_sizes(staged, ["_part"], "_place"), ["_part"])
    numbered = join_blocks(staged, blocks, ["_part"])
    number = F.col("_before") + F.col("_place") - F.col("_first")
    keep = [c for c in frame.columns if c != into]
    return numbered.select(number.alias(into), *keep)
