"""What driver and executors share: a folder for intermediate tables and small files, and this package.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and
reading it back, so a lost executor costs a re-read, never a recomputation of
everything before.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()
_WRITTEN: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once per application; they may not have it installed."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="relplan-")) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own where that is unset and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="relplan-")
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, remembered for :func:`clear`."""
    path = f"{shared_dir(spark)}/relplan-{uuid.uuid4().hex[:12]}-{name}"
    _WRITTEN.append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read back, so that no later step computes it again or differently."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete every path handed out so far; call it once results are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        at = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        at.getFileSystem(conf).delete(at, True)


class Folder:
    """Small text files below a root; ``create`` fails if the name exists, which orders concurrent writers."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._jvm = jvm

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.path(name)))

    def names(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.path(folder))))

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if another writer was first."""
        try:
            out = self._fs.create(self._path(self.path(name)), False)
        except Exception as e:
            if "FileAlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(self.path(name)))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()
