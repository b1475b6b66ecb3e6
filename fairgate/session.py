"""Session helpers: a configured SparkSession for local runs and the
checkpoint directory used to cut lineage.

On a cluster the caller owns the session; the library only reads
``spark.checkpoint.dir`` from it.  A local fallback directory is created
only when the setting is absent *and* the master is local (tests, bench).
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_CHECKPOINT_FALLBACK: dict[int, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "fairgate") -> SparkSession:
    """Session for tests and the benchmark (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory configured for this session.

    Reads ``spark.checkpoint.dir``; when it is unset on a local master a
    scratch directory is created once per context.  On a non-local master an
    unset directory is an error: a machine-local folder is not shared.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir()
    if configured:
        return configured
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at shared storage")
    key = id(sc)
    if key not in _LOCAL_CHECKPOINT_FALLBACK:
        _LOCAL_CHECKPOINT_FALLBACK[key] = tempfile.mkdtemp(prefix="fairgate-ckpt-")
    sc.setCheckpointDir(_LOCAL_CHECKPOINT_FALLBACK[key])
    return _LOCAL_CHECKPOINT_FALLBACK[key]


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes nondeterministic columns (partition ids)
    and cuts lineage; survives executor loss because it lives in shared
    storage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
