"""Chains made from the relational test tables; every row of a table takes part.

Money is summed in whole cents and divided once, so a chain value does not depend on the order in
which rows arrive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..chain import PosteriorChain

CENTS_PER_THOUSAND = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hundredths(column: str) -> Column:
    """Whole hundredths of a non-negative amount."""
    return F.floor(F.col(column) * 100 + 0.5)


def _position(column: str, values: list[str]) -> Column:
    return (F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)) - 1).cast("int")


def line_number_chain(spark: SparkSession, sf_dir: str) -> PosteriorChain:
    """Sample = order, slot = line number; quantity, price in thousands and discount totals."""
    return PosteriorChain.from_long(
        table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), F.col("l_linenumber") - 1,
        [F.col("l_quantity"), hundredths("l_extendedprice"), hundredths("l_discount")],
        num_sources=7, merge=F.sum, divide_by=[1, CENTS_PER_THOUSAND, 100])


def return_flag_chain(spark: SparkSession, sf_dir: str) -> PosteriorChain:
    """Sample = order, slot = return flag; quantity and price totals."""
    return PosteriorChain.from_long(
        table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), _position("l_returnflag", ["A", "N", "R"]),
        [F.col("l_quantity"), hundredths("l_extendedprice")],
        num_sources=3, merge=F.sum, divide_by=[1, CENTS_PER_THOUSAND])


def line_status_chain(spark: SparkSession, sf_dir: str) -> PosteriorChain:
    """Sample = order, slot = line status; quantity and price totals."""
    return PosteriorChain.from_long(
        table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), _position("l_linestatus", ["F", "O"]),
        [F.col("l_quantity"), hundredths("l_extendedprice")],
        num_sources=2, merge=F.sum, divide_by=[1, CENTS_PER_THOUSAND])


def discounted_chain(spark: SparkSession, sf_dir: str) -> PosteriorChain:
    """Sample = order, slot = return flag; the second parameter is missing without discounted lines."""
    price = F.when(F.col("l_discount") >= 0.05, hundredths("l_extendedprice"))
    return PosteriorChain.from_long(
        table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), _position("l_returnflag", ["A", "N", "R"]),
        [F.col("l_quantity"), price],
        num_sources=3, merge=F.sum, divide_by=[1, CENTS_PER_THOUSAND])


def part_chain(spark: SparkSession, sf_dir: str) -> PosteriorChain:
    """Sample = part, slot = last digit of the order; quantity and price totals. Many entries want one label."""
    return PosteriorChain.from_long(
        table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_orderkey") % 10,
        [F.col("l_quantity"), hundredths("l_extendedprice")],
        num_sources=10, merge=F.sum, divide_by=[1, CENTS_PER_THOUSAND])


def amount_chain(spark: SparkSession, sf_dir: str) -> PosteriorChain:
    """Sample = order, slot = quantity, price or line number; its total and that of the tax. Line numbers count with a discount only."""
    number = F.when(F.col("l_discount") >= 0.05, F.col("l_linenumber") * 100)
    amounts = F.array(hundredths("l_quantity"), hundredths("l_extendedprice"), number.cast("long"))
    entries = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax", F.posexplode(amounts).alias("slot", "amount"))
    return PosteriorChain.from_long(
        entries.where("amount IS NOT NULL"), F.col("l_orderkey"), F.col("slot"), [F.col("amount"), hundredths("l_tax")],
        num_sources=3, merge=F.sum, divide_by=[100, 100])


def wide_part_chain(spark: SparkSession, sf_dir: str) -> PosteriorChain:
    """Sample = part, slot = order modulo 20, eight parameters: the width of a real chain."""
    amounts = [hundredths(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    days = F.datediff("l_shipdate", F.lit("1990-01-01").cast("date"))
    return PosteriorChain.from_long(
        table(spark, sf_dir, "lineitem"), F.col("l_partkey"), F.col("l_orderkey") % 20,
        [*amounts, F.col("l_linenumber"), F.col("l_suppkey") % 97, F.col("l_orderkey") % 89, days],
        num_sources=20, merge=F.sum, divide_by=[100, CENTS_PER_THOUSAND, 100, 100, 1, 10, 10, 1000])


def embedding_chain(spark: SparkSession, sf_dir: str) -> PosteriorChain:
    """Sample = vector, slot = its label, parameters = means of eight coordinates each, so that all take part."""
    def fold(i: int) -> Column:
        return F.aggregate(F.slice("embedding", 8 * i + 1, 8), F.lit(0.0), lambda a, x: a + x.cast("double")) / 8

    return PosteriorChain.from_long(
        table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("label"), [fold(i) for i in range(8)], num_sources=10)
