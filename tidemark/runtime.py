"""Session plumbing shared by every operator: shared scratch space and code shipping.

Nothing here holds rows. Intermediate tables go to the folder the cluster names in
``spark.checkpoint.dir`` (shared by the driver and all executors), so a lost executor
costs a re-read and never a recomputation from the start.
"""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

#: Removes the shuffle files of a finished write, which nothing reads again.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of rows that go to a Python worker at once: rows may be long texts or blocks.
_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
_LOCAL: dict[str, str] = {}


def ship_by_value() -> None:
    """Pickle this package's functions by value, so executors need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules["tidemark"])


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``df`` has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor see.

    ``spark.checkpoint.dir`` if the session names one. Only a single-process session
    (master ``local``) may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[app]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system API (any store)."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def _conf(spark: SparkSession, **settings: str) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def clean_shuffles(spark: SparkSession) -> contextlib.AbstractContextManager:
    """While it holds, a job's shuffle files go when the job ends, and batches for Python stay small; for jobs whose result is written."""
    return _conf(spark, **{_SHUFFLE_CLEANUP: "true"} | _BATCH)


class Scratch:
    """Intermediate tables of one operator run; all but its results go when it ends.

    >>> with Scratch(spark, "mix") as scratch:
    ...     sized = scratch.table(sized)      # written, lineage cut, dropped at exit
    ...     return scratch.result(answer)     # written, stays for the caller
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.id = f"{name}-{uuid.uuid4().hex}"
        self.root = f"{shared_dir(spark)}/{self.id}"
        self._n = 0
        self._paths: dict[int, str] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        delete(self.spark, f"{self.root}/tmp")

    def _write(self, df: DataFrame, path: str, codec: str) -> DataFrame:
        with clean_shuffles(self.spark):
            df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/tmp/{name}{self._n}"

    def table(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        path = self.path()
        written = self._write(df, path, codec)
        self._paths[id(written)] = path
        return written

    def parted(self, df: DataFrame, by: str) -> str:
        """The path of ``df`` written with a folder for each value of a column."""
        path = self.path()
        with clean_shuffles(self.spark):
            df.write.option("compression", "uncompressed").partitionBy(by).parquet(path)
        return path

    def remove(self, path: str) -> None:
        """A folder of this run that nothing reads any more."""
        delete(self.spark, path)

    def drop(self, *tables: DataFrame) -> None:
        """Tables that nothing reads any more go before the run ends."""
        for t in tables:
            delete(self.spark, self._paths.pop(id(t)))

    def result(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self._n += 1
        return self._write(df, f"{self.root}/out{self._n}", codec)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
