"""Session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "lorekeep", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # lists of keys and ids go into the scan whole
        "spark.sql.parquet.pushdown.inFilterThreshold": "1000",
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session that names none and has no checkpoint folder gets a folder of its own; on a
    cluster, whose executors could not see it, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lorekeep-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives its shuffle files back when it is done, not when the driver's memory is next cleared; the
    session's setting stays."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_scopes = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread stages inside is removed at the end; what shall last is written elsewhere before.  Shuffle files are
    given back as in :func:`shuffles_freed`."""
    outer = getattr(_scopes, "paths", None)
    _scopes.paths = []
    try:
        with shuffles_freed(spark):
            yield
    finally:
        for path in _scopes.paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _scopes.paths = outer


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Used where several later steps need one costly or order-dependent result: the rows are computed
    once, survive the loss of any executor, and the planner knows their real size.  The folder stays unless
    the call lies inside :func:`scratch`.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{label}-{uuid.uuid4().hex}"
    if getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_shipped: set[tuple[str, str]] = set()


def ship_package(spark: SparkSession, package: ModuleType) -> None:
    """Sends a package's source to the Python workers of the application, once.

    Functions of a package are found by name in the workers, which need not have it installed.
    """
    context = spark.sparkContext
    if (context.applicationId, package.__name__) in _shipped:
        return
    root = Path(package.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.__name__}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add((context.applicationId, package.__name__))
