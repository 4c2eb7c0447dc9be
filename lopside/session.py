"""Session defaults and the two lineage helpers every module shares."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

# Settings that hold at any size. Partition counts and memory are left to the
# cluster; AQE coalesces and splits shuffle partitions at run time.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(app: str = "lopside", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the defaults plus ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULT_CONF | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the folder the cluster names; invent one only for a local session."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        named = tempfile.mkdtemp(prefix="lopside-ckpt-")
    context.setCheckpointDir(named)
    return named


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Used where several jobs read the same expensive intermediate. The written
    table cuts the lineage, survives the loss of any executor, and, unlike a
    checkpointed RDD, is columnar: later jobs read only their columns and push
    their filters into the scan.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of parameters as a local relation (no Python job behind it)."""
    parsed = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in parsed.fields]
    table = pa.table(
        {f.name: pa.array(list(c), to_arrow_type(f.dataType)) for f, c in zip(parsed.fields, columns)}
    )
    return spark.createDataFrame(table, parsed)
