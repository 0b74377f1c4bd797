"""Session defaults and the checkpoint folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "vidspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and skew handling on; `conf` wins over the defaults."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # checkpoints go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # one core per task: the matrix products must not start threads of their own
        "spark.executorEnv.OMP_NUM_THREADS": "1",
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    }
    settings.update(conf)
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a session on one machine may go without: it gets a
    temporary folder, which the executors of a cluster could not read."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError(f"master {sc.master}: set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="vidspark-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, and fixes row placement."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, *, tidy: bool = False) -> DataFrame:
    """Written as Parquet to the shared checkpoint folder and read again: for wide rows, which a
    checkpoint would hold uncompressed. With `tidy` the shuffle files of the write go as soon as it is done;
    else they stay until the driver happens to collect its garbage."""
    spark = df.sparkSession
    checkpoint_root(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            spark.conf.set(TIDY, before) if before is not None else spark.conf.unset(TIDY)
    return spark.read.parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a stored table that nothing will read again."""
    jvm = df.sparkSession._jvm
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        if at.getName().startswith("table-"):
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
