"""Spark session and shared-storage helpers.

The library never assumes a machine-local folder: anything it writes (checkpoints,
materialised datasets, metric logs) goes under the shared folder the cluster names in
``spark.checkpoint.dir``.  Only when that setting is absent (tests, a laptop) does it
pick a fresh scratch folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "shotgrid", shuffle_partitions: int | None = None,
                  checkpoint_dir: str | None = None) -> SparkSession:
    """Session with the settings the operators are designed around (AQE, Arrow, UTC).
    ``checkpoint_dir`` names the shared folder where the cluster's settings don't."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        # remove reliable-checkpoint files once their data is no longer referenced
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if checkpoint_dir:
        conf["spark.checkpoint.dir"] = checkpoint_dir
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables.

    Read from ``spark.checkpoint.dir``.  Where it is unset, a local session gets a scratch folder
    and a cluster session is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc_dir = spark.sparkContext.getCheckpointDir()
    base = conf_dir or sc_dir
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shotgrid-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if not sc_dir:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new, unique folder below the shared folder (one per run; never reused)."""
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss).

    The data is persisted (memory, spilling to disk) while the checkpoint is taken:
    otherwise the checkpoint write recomputes the whole plan a second time."""
    shared_dir(df.sparkSession)
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = kept.checkpoint(eager=True)
    kept.unpersist()
    return out


def input_state(df: DataFrame) -> list[str]:
    """Path, size and modification time of every file that ``df`` reads."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    out = []
    for f in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(f)
        status = path.getFileSystem(conf).getFileStatus(path)
        out.append(f"{f}|{status.getLen()}|{status.getModificationTime()}")
    return out


def path_exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)


def is_complete(spark: SparkSession, folder: str) -> bool:
    """Whether a written table is there in full: its writer's last step was ``_SUCCESS``."""
    return path_exists(spark, f"{folder}/_SUCCESS")
