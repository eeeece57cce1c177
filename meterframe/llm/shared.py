"""Where intermediate tables go: always a folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fewer keys than this can each hold more than one row in so many.
HOT = 1000


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where that is unset, a local folder on one machine, and an error on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="meterframe-checkpoint-")
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut off from its lineage by a reliable checkpoint, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def scratch_dir(spark: SparkSession) -> str:
    """The folder of all tables that this application writes between steps; ``clear`` removes it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/meterframe-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later plans know its size, and may broadcast it if that is small."""
    return written_at(df)[0]


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """``written``, and the folder, for tables that ``removed`` takes away before the job ends."""
    path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Takes away a table that nothing will read again."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``key``: groupings by it with as many partitions read it without a shuffle."""
    name = f"meterframe_{uuid.uuid4().hex}"
    path = f"{scratch_dir(df.sparkSession)}/{name}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).option("compression", "none").option("parquet.enable.dictionary", "false").saveAsTable(name)
    return df.sparkSession.table(name)


def clear(spark: SparkSession) -> None:
    """Removes what ``written`` and ``bucketed`` have left; for the end of a job, when its results are stored."""
    for table in spark.catalog.listTables(pattern="meterframe_*"):
        spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
    removed(spark, scratch_dir(spark))


def hot_join(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of one row for each key and, in ``count``, how many of the ``total`` rows have it.

    Keys of more than one row in ``HOT`` are broadcast: fewer than ``HOT`` rows, however large the table is. All others
    are few enough in any one task to be joined by a shuffle, in which rows that are done (or have no key) are spread
    by the hash of a column. ``how``: inner or left. ``table`` is read twice; both sides should lie in a checkpoint.
    """
    wide = total / HOT
    held = [c for c in table.columns if c not in (key, count)]
    hot, cold = table.where(F.col(count) > wide), table.where(F.col(count) <= wide)
    if cold.isEmpty():
        return rows.join(F.broadcast(hot.drop(count)), key, how)
    done = rows.join(F.broadcast(hot.select(key, F.struct(*held).alias("_hot"))), key, "left")
    away = F.col("_hot").isNotNull() | F.col(key).isNull()
    done = done.withColumn("_key", F.when(~away, F.col(key))).withColumn("_salt", F.when(away, F.pmod(F.xxhash64(spread), F.lit(HOT)) + 1).otherwise(F.lit(0)))
    rest = cold.select(F.col(key).alias("_key"), F.lit(0).cast("long").alias("_salt"), F.struct(*held).alias("_cold"))
    found = done.join(rest, ["_key", "_salt"], "left").withColumn("_held", F.coalesce("_hot", "_cold"))
    if how == "inner":
        found = found.where("_held is not null")
    return found.select(*rows.columns, *[F.col(f"_held.{c}").alias(c) for c in held])
