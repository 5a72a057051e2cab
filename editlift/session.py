"""Session settings, shared work folders and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A lookup table above this many rows is joined by shuffle, never broadcast.
BROADCAST_MAX_ROWS = 50_000

#: A lookup table up to this many rows may be folded into expressions as literals.
LITERAL_MAX_ROWS = 5_000


#: Rows go to Python workers in batches of about this many bytes; Spark's own bound is 10,000 rows of any size.
BATCH_BYTES = 4 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "editlift") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local master may fall back to a fresh temporary folder; a cluster
    without the setting is refused, since a machine-local folder would be lost
    with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="editlift-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed by operators with Python tasks where the package is not installed on the executors.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="editlift-")) / "editlift.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; nothing is deleted or reused."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch in this session; a bound that the session has is left as it is."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of an iterated frame into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rows_up_to(df: DataFrame, bound: int) -> int:
    """Row count, counted no further than ``bound + 1``."""
    return df.limit(bound + 1).count()


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint behind a size check; beyond it Spark picks a shuffle join."""
    return F.broadcast(df) if rows_up_to(df, max_rows) <= max_rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for an input with fewer splits than cores (one small or gzip file).

    An input with enough splits, as any large table has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
