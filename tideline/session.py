"""Session helpers: builder, table reader, shipping of this package to executors."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_OWN: dict[str, str] = {}


def build_session(name: str = "tideline", cpus: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, for tables that driver and executors share.

    Where it is unset, one process has a folder of its own (it is removed when Python
    ends), and a cluster one in the warehouse, which its machines share too.
    """
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        if spark.conf.get("spark.sql.warehouse.dir").startswith(("file:", "/")):
            raise ValueError("the warehouse is a folder of one machine: set spark.checkpoint.dir to one that all machines share")
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tideline-{app}"
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="tideline-shared-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return _OWN[app]


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a Parquet table of the shared folder, read back: worked out once for all that read it, and safe from lost executors.

    It is removed when Python ends.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/tideline-{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(rows.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the application may have ended already
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tideline-ship-")
    atexit.register(shutil.rmtree, folder, True)
    target = Path(folder) / "tideline_pkg.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, f"{root.name}/{source.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that reach Python workers, by rows and by bytes: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
