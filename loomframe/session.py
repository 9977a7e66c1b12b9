"""Session settings and durable intermediate tables.

Intermediate results that several jobs read are written as Parquet below the
folder that ``spark.checkpoint.dir`` names, which every executor of a cluster
shares.  Such a table survives lost executors and cuts the lineage.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(name: str = "loomframe", cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package, own = Path(__file__).resolve().parent, Path(tempfile.mkdtemp(prefix="loomframe-")).resolve()
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    with zipfile.ZipFile(own / "loomframe.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(own / "loomframe.zip"))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder for durable tables: the cluster's, or a temporary one on a single machine where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="loomframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        found = "file://" + own
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_swept: set[str] = set()


def work_dir(spark: SparkSession) -> str:
    """This application's own folder for durable tables, deleted when the application ends."""
    path = f"{shared_dir(spark)}/loomframe/{spark.sparkContext.applicationId}"
    if path not in _swept:
        _swept.add(path)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        atexit.register(_delete, target, target.getFileSystem(spark._jsc.hadoopConfiguration()))
    return path


def _delete(target, file_system) -> None:
    # at the end of the application its JVM may be gone already
    with contextlib.suppress(Exception):
        file_system.delete(target, True)


def durable(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    for made in _scratch:
        made.append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Durable tables that are written inside are deleted at the end, but for those taken off the list that it gives."""
    made: list[DataFrame] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch.remove(made)
        for df in made:
            release(df)


def release(df: DataFrame) -> None:
    """Delete a durable table that no later job reads."""
    path = getattr(df, "_durable_path", None)
    if path:
        spark = df.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Bytes that a table may have to be broadcast.
BROADCAST_BYTES = 64 << 20


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The table written once, and broadcast if its files take up to ``limit`` bytes; else joins shuffle it."""
    kept = df if hasattr(df, "_durable_path") else durable(df, "maybe-broadcast")
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(kept._durable_path)
    size = target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    return F.broadcast(kept) if size <= limit else kept


def spread(df: DataFrame, *keys: str, times: int = 1) -> DataFrame:
    """Deal rows by key for grouped Python work.

    The explicit number of partitions keeps adaptive execution from merging
    them by their bytes: few rows can be much work.  ``times`` as many partitions
    even out few large groups.
    """
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
