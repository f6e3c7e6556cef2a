"""Session helpers: the settings every job here relies on.

Cluster deployments pass their own values (shuffle partitions sized to the
data, ``spark.checkpoint.dir`` on shared storage); these helpers only fill
in what is unset, so a local test session and a cluster session run the
same plans.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime SQL settings the plans rely on (see ``configure``).
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Broadcast only on measured sizes: the static planner estimates text
    # tables after explode/aggregate far too low, AQE sees the real bytes of
    # the finished shuffle stage before it picks a broadcast.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # Texts sent to Python: a batch by rows alone (10,000) grows with the texts' length.
    "spark.sql.execution.arrow.maxBytesPerBatch": "8MB",
}

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "hirelens", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings above to an existing session."""
    for k, v in RUNTIME.items():
        spark.conf.set(k, v)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a purely local session (tests) that names
    none gets a scratch folder, a cluster session must name one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="hirelens-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, and a lost
    executor costs only its running tasks. ``drop_kept`` removes what a session kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/hirelens-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remember(path)
    return spark.read.schema(df.schema).parquet(path)


_kept: list[str] = []


def remember(path: str) -> None:
    """Note an intermediate table for ``drop_kept``."""
    _kept.append(path)


def drop_kept(spark: SparkSession) -> int:
    """Remove the intermediate tables of this session, once the results built on them are written."""
    n = len(_kept)
    while _kept:
        path = spark._jvm.org.apache.hadoop.fs.Path(_kept.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


# What a broadcast may hold, by its measured size.
BROADCAST_ELEMENTS = 2_000_000


def is_small(stored: DataFrame, weight=None, limit: int = BROADCAST_ELEMENTS) -> bool:
    """Whether a stored table has at most ``limit`` elements (rows, or the sum of ``weight``), so that
    what is derived from it may be broadcast. Larger ones are joined by exchange."""
    n = stored.agg(F.sum(weight) if weight is not None else F.count(F.lit(1))).first()[0]
    return (n or 0) <= limit


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    It must be set: a folder made up here would lie on one machine."""
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not d:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d
