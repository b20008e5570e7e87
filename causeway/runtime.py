"""What every part of the engine shares: folders all executors see, code shipping, and workers that give memory back."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Bytes of one Arrow batch on its way to or from a Python worker, unless the session names another bound.
ARROW_BYTES = "4m"


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the cluster names in spark.checkpoint.dir.

    Only where none is named and the master is local does a temporary folder stand in; elsewhere a
    machine-local folder would be invisible to the other executors, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = spark.sparkContext.getCheckpointDir()
        base = made.rsplit("/", 1)[0] if made else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="causeway-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there and a lost executor costs a reread."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged_ones: DataFrame | None) -> None:
    """Delete what staged() wrote for these, once everything that reads them has been written itself."""
    for df in staged_ones:
        path = getattr(df, "staged_at", None) if df is not None else None
        if isinstance(path, str):
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(session.sessionState().newHadoopConf()).delete(at, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application, and bound the Arrow batches they are sent."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in ("67108864b", "64m", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    context = spark.sparkContext
    if getattr(context, "_causeway_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="causeway-code-")
    target = os.path.join(folder, "causeway_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(target)
    context._causeway_shipped = True


def give_back() -> None:
    """Return the memory that the allocators of this process hold but don't use."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, a function for mapInArrow, ending with give_back(): an idle worker then holds only what its next task needs too."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
