"""Session construction and shared scratch locations.

Cluster jobs read ``spark.checkpoint.dir`` from the session (the shared
folder the cluster names); only when it is unset — local runs and tests —
do we point it at a fresh folder of our own. On a cluster it must be set.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


#: Explicit option: spread the rows of the input tables over so many partitions (unset: as the scan splits them).
INPUT_PARTITIONS = "spark.lisible.input.partitions"


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "lisible", extra: dict | None = None) -> SparkSession:
    """A session with the engine's defaults; master, shuffle partitions and memory stay as submitted unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # a folder of one machine would not be seen by the others
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="lisible-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str, **options):
    """Write ``df`` once as a table under the shared checkpoint folder and read it back.

    Used when one derived table feeds several jobs of a plan: it is computed
    once, and the lineage is cut at a durable copy (safe under executor loss).
    ``options`` are the writer's (see ``PACKED``).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    stored = df.sparkSession.read.parquet(path)
    stored.stored_at = path
    return stored


#: Writer options of large intermediate tables: zstd, and dictionaries that hold a column's values where they repeat.
PACKED = {"compression": "zstd", "parquet.dictionary.page.size": str(8 << 20)}


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def discard(*tables) -> None:
    """Delete tables made by ``materialize`` that no later plan reads."""
    for t in tables:
        delete(t.sparkSession, t.stored_at)


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession):
    """Jobs that run inside remove their shuffle files when they end; otherwise those stay until the driver collects its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
