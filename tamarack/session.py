"""Session settings and checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the library expects: UTC and adaptive execution."""
    b = SparkSession.builder.appName("tamarack").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    b = b.master(master) if master else b
    b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions)) if shuffle_partitions else b
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


#: Shuffled rows come in many partitions, of which adaptive execution joins small ones until they hold about this much.
PARTITIONS, PARTITION_BYTES = 1500, 4 << 20
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded_tasks(spark: SparkSession) -> SparkSession:
    """spark, set so that a task's share of a shuffle stays about as large when tables grow: there are more tasks instead.

    Sorts and windows hold their task's share, many times its compressed size. Values that the session has already go first
    if they ask for more and smaller partitions. Files of a shuffle go when the action that made them ends, not when the
    driver happens to collect garbage: jobs of many steps, each cut by a checkpoint, then hold one step's files on disk.
    """
    spark.conf.set(FILES_GO, "true")
    number, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    if int(spark.conf.get(number, None) or 0) < PARTITIONS:
        spark.conf.set(number, str(PARTITIONS))
    set_, factor = str(spark.conf.get(size, None) or "64m").strip().lower().rstrip("b"), {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    if float(set_.rstrip("kmg") or 0) * factor.get(set_[-1], 1) > PARTITION_BYTES:
        spark.conf.set(size, str(PARTITION_BYTES))
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for written tables and checkpoints that all executors share: spark.checkpoint.dir. Only a local session may do without."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in that folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
