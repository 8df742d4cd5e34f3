"""Sessions, table access and durable intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from batchloom.errors import Refusal


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests, the bench and the command line."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("batchloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python workers can import it from anywhere."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="batchloom-")) / "batchloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for source in sorted(here.rglob("*.py")):
            out.write(source, Path(here.name) / source.relative_to(here))
    context.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables in ``sf_dir``; the first read of an application ships the package."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder, which goes
    with the driver; on a cluster each executor would write to a disk of its
    own, so that is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise Refusal("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="batchloom-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/batchloom-{spark.sparkContext.applicationId}"


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows survives the loss of any executor without
    recomputing what came before, and sees true sizes when joins are planned.
    The table stays until :func:`clear`, as results that read it are lazy.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the tables that :func:`durable` wrote in this application; results not yet read are lost with them."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session, for the jobs that are run inside."""
    old = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)
