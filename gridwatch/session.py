"""Session construction and shared-storage helpers.

Every intermediate table and streaming checkpoint goes under the shared folder
the cluster names in ``spark.checkpoint.dir``, in a folder per application.
When the setting is absent, a temporary folder is picked only where the master
is local (tests, a laptop); on any other master that is an error.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale.  AQE re-plans joins at runtime from real
# shuffle sizes: it turns a sort-merge join into a broadcast join only when the
# measured side is below ``autoBroadcastJoinThreshold`` (the size check), it
# splits skewed partitions (a hot cell or a hot address), and it coalesces the
# many small post-shuffle partitions that tiny test data produces.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    # The size bound for any broadcast the planner chooses: statically from
    # plan statistics, and at runtime (AQE) from the measured shuffle output.
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # Small stages that feed CPU-heavy joins (candidate pairs) must still spread
    # over all cores; at scale stages are far above this size anyway.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "gridwatch", extra: dict | None = None,
                  checkpoint_dir: str | None = None) -> SparkSession:
    """Create (or reuse) a session with the scale settings above.

    ``master`` is left unset on a cluster (spark-submit decides); tests pass
    ``local[*]``.  ``checkpoint_dir`` sets ``spark.checkpoint.dir`` (needed on a
    cluster that does not set it).  ``shuffle_partitions`` should be sized so one post-shuffle
    partition is ~128 MB at the target scale; AQE coalesces when it is too many.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None for a session without one (Spark Connect)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions raise here
        return None


def default_parallelism(spark: SparkSession) -> int:
    sc = _context(spark)
    if sc is not None:
        return sc.defaultParallelism
    return int(spark.conf.get("spark.default.parallelism", "8"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; without one, set a temporary folder on a local master only."""
    sc = _context(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = sc.getCheckpointDir() if sc is not None else None
    if current:
        return os.path.dirname(current.rstrip("/"))
    if not is_local(sc.master if sc is not None else ""):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="gridwatch-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local)
    if sc is not None:
        sc.setCheckpointDir(local)
    return local


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (``local-cluster`` is not)."""
    return master == "local" or master.startswith("local[")


def shared_path(spark: SparkSession, *parts: str, fresh: bool = False) -> str:
    """A path under this application's part of the shared folder; ``fresh`` appends a unique leaf."""
    base = application_path(spark)
    leaf = list(parts)
    if fresh:
        leaf.append(uuid.uuid4().hex[:12])
    return "/".join([base, *leaf])


def application_path(spark: SparkSession) -> str:
    sc = _context(spark)
    name = sc.applicationId if sc is not None else "connect"
    return f"{ensure_checkpoint_dir(spark)}/gridwatch/{name}"


def remove_intermediates(spark: SparkSession) -> bool:
    """Delete everything this application wrote below the shared folder; call when all results are stored."""
    return remove_path(spark, application_path(spark))


def remove_path(spark: SparkSession, path: str) -> bool:
    """Delete a folder through Hadoop's file system interface (any store that Spark reaches)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialised(df, *parts: str):
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = shared_path(spark, *parts, fresh=True)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df, spark: SparkSession | None = None):
    """Materialise ``df`` reliably (survives executor loss) and drop its lineage.

    Uses ``checkpoint()`` into the shared folder, never ``localCheckpoint``.
    """
    ensure_checkpoint_dir(spark or df.sparkSession)
    return df.checkpoint(eager=True)
