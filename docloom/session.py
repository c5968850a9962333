"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the library assumes; applied by ``get_session`` and checked by
# ``apply_defaults`` on a session someone else built.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "docloom",
                shuffle_partitions: int | None = None,
                extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the library defaults.

    On a cluster ``master`` stays None and the launcher decides; tests and the
    bench pass ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = "8g"  # local mode: the driver JVM is the executor
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_defaults(spark)
    return spark


def apply_defaults(spark: SparkSession) -> None:
    """Set the library's defaults on a session; all of them are run-time settings."""
    for k, v in DEFAULT_CONF.items():
        spark.conf.set(k, v)


def shared_dir(spark: SparkSession, sub: str) -> str:
    """A folder under the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session.  Only when it is unset *and* the
    session runs in local mode (tests, bench) do we create a private folder
    and set it; on a cluster an unset value is an error, because a
    machine-local temp folder is invisible to other executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master or ""
        if not master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="docloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base.rstrip("/") + "/rdd")
    path = base.rstrip("/") + "/" + sub.strip("/")
    if "://" not in path and spark.sparkContext.master.startswith("local"):
        os.makedirs(path, exist_ok=True)  # on a cluster the writers make their folders themselves
    return path


def fresh_dir(spark: SparkSession, sub: str) -> str:
    """A new, unique folder under ``shared_dir`` (one per run)."""
    import uuid
    return shared_dir(spark, f"{sub}/{uuid.uuid4().hex}")


def materialized(df, sub: str):
    """``df`` written as Parquet into a new folder under ``shared_dir`` and
    read back: computed once, its lineage cut, safe from lost executors."""
    import uuid
    path = f"{shared_dir(df.sparkSession, sub)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df):
    """Reliable, eager checkpoint of a (small, reused) derived table into the
    shared checkpoint folder: later uses read it instead of recomputing its
    lineage, and a lost executor never forces a recompute."""
    shared_dir(df.sparkSession, "checkpoints")
    return df.checkpoint(eager=True)
