"""Run registered queries against their SQL counterparts: ``python tests/oracle_check.py DIR [NAME ..]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def oracle_frame(sf_dir: str, sql: str) -> pd.DataFrame:
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection.execute(sql).df()


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    for name in frame.columns:
        if pd.api.types.is_numeric_dtype(frame[name]):
            frame = frame.assign(**{name: frame[name].astype(float) + 0.0})
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def differences(result: pd.DataFrame, expected: pd.DataFrame) -> str | None:
    result, expected = canonical(result), canonical(expected)
    if list(result.columns) != list(expected.columns):
        return f"columns {list(result.columns)} and {list(expected.columns)}"
    if len(result) != len(expected):
        return f"{len(result)} and {len(expected)} rows"
    unequal = ~((result == expected) | (result.isna() & expected.isna()))
    if unequal.any(axis=None):
        rows = unequal.any(axis=1)
        return f"{int(rows.sum())} rows differ:\n{result[rows].head(3)}\n{expected[rows].head(3)}"
    return None


def main(sf_dir: str, names: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as registered

    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    oracles = registered.oracle_sql()
    for name, query in registered.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        result = query(spark, sf_dir).toPandas()
        middle = time.time()
        wrong = differences(result, oracle_frame(sf_dir, oracles[name])) if name in oracles else "no SQL"
        print(f"{name:26s} {len(result):8d} rows  spark {middle - start:6.2f}s  sql {time.time() - middle:6.2f}s  "
              f"{wrong or 'equal'}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
