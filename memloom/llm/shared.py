"""Tables and folders that the driver and all executors can reach."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_registered: list[bool] = []
_folders: dict[int, tuple[str, ...]] = {}  # by the DataFrame that materialize() gave


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which the driver and all executors share.

    Where it is unset, a local session gets a temporary folder of its own. Elsewhere that
    is an error: tables in a machine's own folder would be lost to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='memloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new, empty name in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _registered:
        _registered.append(True)
        atexit.register(_drop_all)
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[id(out)] = (path,)
    weakref.finalize(out, _folders.pop, id(out), None)
    return out


def release_memory() -> None:
    """Hand freed memory back to the machine: workers live on, and what they keep adds to the executor's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """mapInArrow whose tasks release their memory as they end."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return df.mapInArrow(tidy, schema)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """Delete the table that materialize() wrote for df, once nothing reads it any more."""
    paths = _folders.pop(id(df), ())
    for made in [x for x in _made if x[1] in paths]:
        _made.remove(made)
        _delete(*made)


def _drop_all() -> None:
    for made in _made:
        try:
            _delete(*made)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
