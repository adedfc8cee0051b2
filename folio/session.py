"""Session helpers: building a session, the shared work folder, materialised tables.

Nothing here reads data.  The work folder is the cluster's ``spark.checkpoint.dir``; a folder
under ``/tmp`` is only chosen when a local session has none (tests, trial runs).
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed defaults for local runs; a cluster session keeps whatever it was started with.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "16g",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[8]", app: str = "folio", **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    defaults = LOCAL_CONF if master.startswith("local") else {}
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    work_root(spark)
    ship_package(spark)
    return spark


def work_root(spark: SparkSession) -> str:
    """The shared folder for materialised tables: ``spark.checkpoint.dir`` of the session.

    When a local session names none, a fresh folder under /tmp is created and registered as
    the checkpoint folder, so ``DataFrame.checkpoint()`` and written tables land in the same
    place.  On a cluster a machine-local folder would be a different one on every executor, so
    a session without the setting is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="folio-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return (sc.getCheckpointDir() or configured).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the application's own part of the work folder."""
    return f"{work_root(spark)}/folio/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def _file_system(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists; a store that cannot be asked is an error, not "absent"."""
    fs, jvm_path = _file_system(spark, path)
    return bool(fs.exists(jvm_path))


def move(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder to a place that does not exist yet."""
    fs, jvm_path = _file_system(spark, source)
    jvm_target = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs.mkdirs(jvm_target.getParent())
    if not fs.rename(jvm_path, jvm_target):
        raise OSError(f"{source} was not moved to {target}")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder and what is in it; nothing if it is missing."""
    fs, jvm_path = _file_system(spark, path)
    fs.delete(jvm_path, True)


def list_folders(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers of the folders ``<prefix><number>`` directly under ``path`` (none if it is missing)."""
    fs, jvm_path = _file_system(spark, path)
    if not fs.exists(jvm_path):
        return []
    names = [str(f.getPath().getName()) for f in fs.listStatus(jvm_path)]
    return [int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit()]


def clean_work(spark: SparkSession) -> None:
    """Removes what this application wrote to the work folder (its indexes and intermediate
    tables).  Call it when no result that reads them is needed any more."""
    fs, jvm_path = _file_system(spark, f"{work_root(spark)}/folio/{spark.sparkContext.applicationId}")
    fs.delete(jvm_path, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet under the shared work folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing model calls or
    tokenisation) and gives the optimiser file statistics for later joins.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.parquet(path)


def at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; reads no more than ``max_rows + 1``."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int, bound_by: DataFrame | None = None) -> DataFrame:
    """``broadcast(df)`` when its row count is proven to be within ``max_rows``, else ``df``.

    Callers pass the bound that keeps the broadcast side within executor memory for the row
    width they know; above it the join stays a shuffle join (AQE may still pick a broadcast
    from runtime sizes).  ``bound_by`` is a cheaper frame with at least as many rows (e.g. the
    input of an inner join on a unique key), counted instead of ``df``.
    """
    return F.broadcast(df) if at_most(bound_by if bound_by is not None else df, max_rows) else df


#: Bytes of input (as Spark's statistics have them) that one task of text work should get.
TASK_BYTES = 16 * 1024 * 1024
UNKNOWN_BYTES = 2**60


def size_in_bytes(df: DataFrame) -> int:
    """Spark's estimate of the bytes of ``df``, for a table read from files the size of the files; 0
    where it has none (its default is then the greatest number)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < UNKNOWN_BYTES else 0


def spread(df: DataFrame, key: str | None = None, min_partitions: int | None = None) -> DataFrame:
    """Hash-repartition ``df`` only when it has fewer partitions than the default parallelism, or
    than its size needs at ``TASK_BYTES`` a task.

    A scan of few large row groups (one per file) gives a single busy task however many
    splits it has; CPU-heavy text work after it would run on one core.  The tasks follow the size
    of the input, so that a larger input makes more of them and not longer ones.
    """
    target = min_partitions or max(df.sparkSession.sparkContext.defaultParallelism, -(-size_in_bytes(df) // TASK_BYTES))
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key) if key else df.repartition(target)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``folio`` importable on the executors (once per application).

    Batch functions given to ``mapInPandas`` / ``applyInPandas`` are pickled by reference to
    their module, so Python workers need the package: it is zipped on the driver and added
    with ``addPyFile``, which distributes it to every executor.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="folio-pkg-")) / "folio.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(pkg.rglob("*.py")):
            z.write(f, f.relative_to(pkg.parent).as_posix())
    sc.addPyFile(str(archive))
    _SHIPPED.add(sc.applicationId)
