"""What the operators share: inputs, the shared scratch folder, file access from executors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, with its scheme: ``spark.checkpoint.dir``, or one of our own where that is unset and the master is local (tests).

    A path without a scheme is one of the cluster's default file system, as for Spark, and named so: executors open files by it.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that the driver and all executors share")
        found = _OWN_DIR.get(sc.applicationId)
        if not found:
            found = _OWN_DIR[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
    p = sc._jvm.org.apache.hadoop.fs.Path(found)
    found = p.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(p).toString()
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables and folders below the shared folder, each under a name that no other run uses.

    What a result is read from has to stay; what is left of it goes when the driver's JVM ends.
    """

    #: Spark deletes a job's shuffle files when the job has ended: its result is a table by then.
    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, label: str, alike: bool = False):
        """``alike``: tables that grow with the input are joined by shuffles at every size, not broadcast while they happen to be small."""
        self.spark = spark
        self.settings = {self.CLEANUP: "true"} | ({"spark.sql.autoBroadcastJoinThreshold": "-1"} if alike else {})
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        fs, p = self._hadoop("")
        fs.mkdirs(p)
        fs.deleteOnExit(p)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _hadoop(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def keep(self, df: DataFrame, name: str, *by: str) -> DataFrame:
        """Write ``df`` once (in folders ``by`` its last columns) and read it back: lineage is cut and lost executors lose nothing."""
        with contextlib.ExitStack() as inside:
            for k, v in self.settings.items():
                inside.enter_context(setting(self.spark, k, v))
            df.write.mode("overwrite").partitionBy(*by).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            fs, p = self._hadoop(name)
            fs.delete(p, True)


def filesystem(uri: str):
    """(pyarrow file system, path in it) for a folder or file named with its scheme; an absolute path without one is local."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, name: str, parts, attempt: int) -> None:
    """Write byte strings to ``uri/name`` under a name of this attempt, then rename: a retried task replaces its file whole."""
    f, base = filesystem(uri)
    f.create_dir(base, recursive=True)
    temp = f"{base}/.{name}.{attempt}"
    with f.open_output_stream(temp) as out:
        for part in parts:
            out.write(part)
    f.move(temp, f"{base}/{name}")


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for what is run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


#: Bytes of an Arrow batch that a Python worker is given; a row that is longer comes alone.
BATCH_BYTES = 4 << 20


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` in batches bounded by bytes, not rows alone: texts differ widely in length.

    The bound is a setting of the session, read when the plan is made; it is lowered here, never raised.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if df.sparkSession._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(conf.get(key)) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


_HELD: dict[tuple, Any] = {}


def held(owner: str, key=None, make: Callable[[], Any] = lambda: None):
    """What a Python worker keeps from task to task for an operator.  One thing at a time: what another left behind goes first."""
    if (owner, key) not in _HELD:
        _HELD.clear()
        gc.collect()
        import pyarrow as pa

        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        _HELD[owner, key] = make()
    return _HELD[owner, key]


def slices(batches, rows: int = 1024):
    """Arrow batches in parts of so many rows: what is made of a part as Python objects stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def single_thread() -> None:
    """Tokenizer libraries in a Python worker use one thread: cores are Spark's to deal out."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
