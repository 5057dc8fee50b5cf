"""Session factory and lineage helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "lodestar", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume (UTC, Arrow, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is this very process (tests) a temporary
    folder is used; on a cluster without the setting this raises rather than write to one machine.
    The shuffle files of what is written are removed at once, since nothing reads them again; the
    checkpoint itself goes when nothing refers to it any more (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="lodestar-checkpoint-")
        sc.setCheckpointDir(folder)
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        return df.select("*").checkpoint(eager=eager)  # a new frame: the setting is read where a frame is made
    finally:
        spark.conf.set(_CLEAN_UP, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Setting that names the number of partitions CPU-bound inputs are spread over, for tables that come as fewer pieces than there are cores.
PARTITIONS = "spark.lodestar.input.partitions"


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """The frame in ``partitions`` partitions (default: the setting ``PARTITIONS``; neither: as it is), whatever its size."""
    n = partitions or int(df.sparkSession.conf.get(PARTITIONS, "0"))
    return df.repartition(n) if n > 0 else df


def read_spread(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for CPU-bound stages, spread if the session's settings say so."""
    return spread(read_table(spark, sf_dir, name))
