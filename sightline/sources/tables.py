"""Tables written to the cluster's shared folder between the steps of a job."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_noted: set[str] = set()
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application in spark.checkpoint.dir. Where that is unset, a temporary one in local mode, and an
    error on a cluster, whose machines would not see each other's files."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="sightline-")
        base = _own[sc.applicationId]
    folder = f"{base.rstrip('/')}/sightline-{sc.applicationId}"
    if folder not in _noted:
        _noted.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def materialised(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and lost executors lose nothing."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.options(**(options or {})).schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*written: DataFrame) -> None:
    """Remove tables that materialised made and that nothing will read any more."""
    for df in written:
        _remove(df.sparkSession, _paths.pop(df))
