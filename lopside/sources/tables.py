"""Reading and writing tables with declared schemas."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("csv", "parquet", "json", "orc")
SPLITS = 4  # of an input, for each core, from which on its rows stay as they are read


class MissingColumns(ValueError):
    """Raised at plan time, before any job runs."""


def check_inputs(df: DataFrame, required: Iterable[str]) -> DataFrame:
    """Fail early when a required column is absent; else return ``df``."""
    absent = [name for name in required if name not in df.columns]
    if absent:
        raise MissingColumns(f"input lacks columns: {', '.join(absent)}")
    return df


def check_path(spark: SparkSession, path: str) -> str:
    """Fail early when nothing lies at ``path`` (any Hadoop file system)."""
    try:
        spark.read.format("binaryFile").load(path)  # lists the path, reads nothing
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from None
        raise
    return path


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    """Scan a table. A declared schema avoids a pass over the data to infer one."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    check_path(spark, path)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        if schema is None:
            raise ValueError("csv needs a declared schema")
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(fmt).load(path)


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error",
    partition_by: list[str] | None = None,
) -> None:
    """Write without an index column; ``partition_by`` splits e.g. by ``split``."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input over all cores.

    A small file is one split, or one row group, and would keep all narrow work on
    one core. Rows of an input with SPLITS splits a core stay as they are read.
    ``spark.lopside.input.partitions`` sets the number of partitions.
    """
    if df.isStreaming:
        return df
    wanted = df.sparkSession.conf.get("spark.lopside.input.partitions", None)
    if wanted is not None:
        return df.repartition(int(wanted))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= SPLITS * cores else df.repartition(2 * cores)
