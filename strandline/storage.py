"""Tables that cut lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
STAGES = "strandline-stages"
_FOLDERS: list[str] = []
_KEPT: dict[tuple, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset and Spark is one process (tests), a new one of our own.

    Without the setting a cluster has no folder that all its machines see, which is an error.
    """
    found = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{KEY} must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set(KEY, found)
    return found.rstrip("/")


def fresh_folder(spark: SparkSession) -> str:
    """A new name in the shared folder, for files that a caller writes; ``clear`` removes them."""
    folder = f"{shared_dir(spark)}/strandline-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    return folder


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike a cache, the files survive lost executors, and later plans start from them. ``clear`` removes them.
    Only a single process without the setting (tests) has that folder on its own machine; a cluster gets an error instead.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark)
    df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def _state(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files below a folder's tables, listed by one call a level and not one a file."""
    system = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    found, pattern = hashlib.sha256(), re.sub(r"([\[\]{}*?\\])", r"\\\1", path.rstrip("/"))
    while True:
        pattern += "/*"
        text = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(pattern)))
        found.update(re.sub(r"access_time=\d+; ", "", text).encode())
        if "isDirectory=true" not in text:
            return found.hexdigest()


def kept(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` that ``make`` derives from the tables in ``sf_dir``, saved once for each state of their files."""
    key = spark.sparkContext.applicationId, name, sf_dir, _state(spark, sf_dir)
    if key not in _KEPT:
        _KEPT[key] = saved(make(), name)
    return _KEPT[key]


@cache
def _code() -> str:
    """A digest of this library's own source, so what another version has written isn't taken for this one's."""
    found = hashlib.sha256()
    for file in sorted(Path(__file__).parent.rglob("*.py")):
        found.update(file.read_bytes())
    return found.hexdigest()


def stage(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """As ``kept``, but found again by later processes with the same shared folder: a run of many stages goes on from the last that was written whole.

    The folder's name tells the stage, the state of the files it comes from and the code; ``clear`` leaves it, ``clear_stages`` removes all.
    """
    key = hashlib.sha256("\n".join((name, sf_dir, _state(spark, sf_dir), _code())).encode()).hexdigest()[:32]
    folder = f"{shared_dir(spark)}/{STAGES}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def clear_stages(spark: SparkSession) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{STAGES}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Remove the tables that this process has saved, and say how many; call it once results are written, as these start from them."""
    many = len(_FOLDERS)
    _KEPT.clear()
    while _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return many
