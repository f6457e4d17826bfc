"""Session helpers: table access, lineage cuts in the shared folder, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[object, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of an input that comes in fewer splits than there are cores, dealt out to all of them before work that multiplies rows.

    Larger inputs have more splits than cores and are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (local tests) a temporary folder is made and used.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        d = "file://" + tempfile.mkdtemp(prefix="readloom-")
        spark.conf.set("spark.checkpoint.dir", d)
        return d
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that lineage ends there.

    Unlike ``checkpoint()`` the last stage is computed a single time and the columns stay prunable;
    a lost executor costs nothing, since the files lie in the shared folder.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._readloom_path = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files of this session, deleted when the process ends."""
    path = f"{shared_dir(spark)}/readloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`cut` that nothing reads any more (any other frame is left alone)."""
    path = getattr(df, "_readloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _made[:] = [m for m in _made if m[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _cleanup() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the session may have ended before this process
            pass


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_readloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = os.path.join(tempfile.mkdtemp(prefix="readloom-zip-"), "readloom.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(out)
    sc._readloom_shipped = True
