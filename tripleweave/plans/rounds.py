"""Working storage and loop helpers shared by the iterative operators.

Loops cut their lineage by writing each round's state as a parquet table in the folder
the cluster names in ``spark.checkpoint.dir``. A written table survives the loss of any
executor and brings file statistics, so the next round's joins are planned on real sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables; a temporary one only in local mode."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="tripleweave-")
        base = _local_dirs[app]
    return f"{base.rstrip('/')}/tripleweave/{app}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, label: str = "state") -> DataFrame:
    """Write ``df`` to the shared folder and return a reader on it."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in a total order, without a one-task window.

    Range-partition and sort, write the rows with (partition, offset), then add up the
    partition sizes: only one row per partition is ever summed in one place.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    placed = cut(placed, "ranked")
    part = F.shiftright(F.col("_pos"), 33)
    sizes = placed.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition of the sort
        .withColumn(name, F.col("_before") + F.col("_pos").bitwiseAND((1 << 33) - 1) + 1)
        .drop("_part", "_before", "_pos")
    )


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: Column | int, salt_on: list[str], salts: int = 32
) -> DataFrame:
    """First ``k`` rows of every group; a hot group is cut down in ``salts`` tasks first."""
    salt = F.pmod(F.xxhash64(*salt_on), F.lit(salts))
    partial = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rn", F.row_number().over(partial))
        .where(F.col("_rn") <= k)
        .withColumn("_rn", F.row_number().over(final))
        .where(F.col("_rn") <= k)
        .drop("_rn", "_salt")
    )


def row_numbers(df: DataFrame, name: str, start: int = 0) -> DataFrame:
    """Consecutive numbers in the present row order, from written partitions and their sizes."""
    placed = cut(df.withColumn("_pos", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col("_pos"), 33)
    sizes = placed.groupBy(part.alias("_part")).count()
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    number = F.col("_before") + F.col("_pos").bitwiseAND((1 << 33) - 1) + start
    return (
        placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row per partition
        .select(number.alias(name), *df.columns)
    )
