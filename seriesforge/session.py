"""Session factory and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", **conf: str) -> SparkSession:
    """A local session with UTC, AQE and few shuffle partitions; conf adds or replaces settings."""
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
    }
    return SparkSession.builder.master(f"local[{cores}]").config(map=base | conf).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or ValueError naming the columns that it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def first_present(df: DataFrame, names: list[str]) -> str:
    """The first of names that df has; decided when the plan is built."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"none of {', '.join(names)}")
