"""Session helpers: one place that sets the engine defaults every job relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults that matter for correctness (UTC, ANSI kept on) and for scale (AQE,
# skew-join splitting, partition coalescing). Callers may override any of them.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app: str = "sparkprep",
              shuffle_partitions: int | None = None, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only a local-mode
    session without one gets a private scratch folder (tests)."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="sparkprep-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def input_bytes(spark: SparkSession, path: str) -> int:
    """On-disk size of a table (file listing only, no data read)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def size_shuffle_partitions(spark: SparkSession, paths, target_bytes: int = 256 << 20,
                            expansion: float = 3.0, minimum: int = 8) -> int:
    """Set ``spark.sql.shuffle.partitions`` so each shuffle partition holds about
    ``target_bytes`` of decoded data (Parquet expands ~``expansion`` x in memory).
    AQE then coalesces partitions that turn out small; it cannot split ones that
    are too big, so the initial count is sized from the input (100 TB ->
    ~1.2 M partitions at the defaults)."""
    total = sum(input_bytes(spark, p) for p in paths)
    n = max(minimum, int(total * expansion / target_bytes) + 1)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    return n
