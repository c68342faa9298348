"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "cohortlens",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Session tuned for this engine's plans.

    AQE stays on: it coalesces small shuffle partitions, splits skewed join
    partitions (a hot key may hold a third of the rows) and turns joins whose
    materialised side is below the broadcast threshold into broadcast joins,
    which is the runtime size check every non-literal broadcast relies on.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "16g",
        "spark.scheduler.mode": "FAIR",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by the cluster.

    The cluster names a shared folder in ``spark.checkpoint.dir``; we read it
    and never replace it.  Only a local-mode session (tests, the bench) with
    no folder configured gets a fresh scratch folder of its own.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a cluster run needs a shared folder")
    scratch = tempfile.mkdtemp(prefix="cohortlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()


def materialize(df, name: str, key: list | None = None):
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts lineage (a lost executor re-reads files instead of recomputing the
    plan) and lets iterative work such as tuning loops scan a small table.
    With ``key`` the rows are hash-partitioned on it first, in partitions that
    adaptive execution sizes by their bytes, whatever the layout of the inputs.
    The written table has a known size, so joins with it broadcast it exactly
    when it is below Spark's threshold, on one plan for all sizes.
    """
    import uuid
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if key:
        df = df.repartition(*key)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
