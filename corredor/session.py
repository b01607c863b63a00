"""Session settings and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(app: str = "corredor", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators are tuned for; keyword dots are written as ``__``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join key even when the next step then needs a shuffle of its own
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # stream state lives on disk, not in the executor heap
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        "spark.ui.enabled": "false",
        # checkpoint copies go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder; on a cluster a machine-local
    folder would be lost with its executor, so a missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    fallback = os.path.join(tempfile.gettempdir(), f"corredor-{os.getpid()}")
    os.makedirs(fallback, exist_ok=True)
    return fallback


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder path of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


_WRITTEN: dict[str, list[str]] = {}
_SCOPE = threading.local()


def write_once(df, name: str = "fixed", **options: str):
    """``df`` written to the shared folder and read back: later passes see one layout, whatever executors come or go.

    The copy stays until ``release_scratch``, or inside ``scratch_scope`` until its end.
    """
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.options(**options).parquet(path)
    scope = getattr(_SCOPE, "paths", None)
    (_WRITTEN.setdefault(spark.sparkContext.applicationId, []) if scope is None else scope).append(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_mark(spark: SparkSession) -> int:
    """How many copies this application holds now; give it to ``release_scratch`` to keep them."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release_scratch(spark: SparkSession, keep: int = 0) -> int:
    """Deletes the copies that ``write_once`` has made after the first ``keep``; what reads them must be stored by then."""
    held = _WRITTEN.get(spark.sparkContext.applicationId, [])
    paths, held[keep:] = held[keep:], []
    _delete(spark, paths)
    return len(paths)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    context = spark.sparkContext
    for path in paths:
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def finished_folders(spark: SparkSession, path: str, prefix: str, marker: str | None = None) -> set[str]:
    """What follows ``prefix`` in the names of the folders in ``path``; with ``marker`` only of those that hold this file."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(root):
        return set()
    found = [f.getPath() for f in files.listStatus(root) if f.isDirectory() and f.getPath().getName().startswith(prefix)]
    if marker:
        found = [f for f in found if files.exists(context._jvm.org.apache.hadoop.fs.Path(f, marker))]
    return {f.getName()[len(prefix):] for f in found}


@contextmanager
def scratch_scope(spark: SparkSession):
    """Copies that ``write_once`` makes inside, in this thread, are deleted at the end, also after an error.

    What leaves the scope must be stored and not read them; calls in other threads keep their own copies.
    """
    outer = getattr(_SCOPE, "paths", None)
    _SCOPE.paths = own = []
    try:
        yield
    finally:
        _SCOPE.paths = outer
        _delete(spark, own)


def cut_lineage(df):
    """Reliable checkpoint: the rows are written once and survive executor loss.

    Used where a plan reads the same range-partitioned layout twice; recomputing it could
    sample other range bounds and give other positions.
    """
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
