"""Helpers shared by the operators: tables, the shared folder, tokens."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words: runs of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine a folder is made;
    on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sqlloom-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


ARROW_BYTES = 4 << 20


def arrow_bounded(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch, which else holds up to 64 MB in the
    JVM and again in its Python worker, for each running task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(-?\d+)b?", str(spark.conf.get(key)))
    if not now or not 0 < int(now[1]) <= ARROW_BYTES:
        spark.conf.set(key, ARROW_BYTES)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor re-reads the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_written", None):
            place = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of queries that are over, which it
    does when the driver's JVM has collected its garbage."""
    spark._jvm.System.gc()


def give_back() -> None:
    """Returns a worker's free memory to the system; workers are used again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def crc_fold(doc_id: str, folds: int) -> Column:
    """crc32(id as text) modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))


def words(text: bytes) -> list[bytes]:
    """``bytes.split`` cuts at exactly the six ASCII white-space bytes."""
    return text.split()


def parts_for(spark: SparkSession, size: int, each: int) -> int:
    """Partitions so that each holds about ``each`` of ``size``, cores at least."""
    return max(1, -(-size // each), min(spark.sparkContext.defaultParallelism, 8))


def safe_name(name: str) -> str:
    return re.sub(r"\W", "_", name)
