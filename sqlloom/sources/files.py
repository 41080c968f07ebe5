"""Files through Hadoop's FileSystem, so that any store Spark reads will do."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; where the
    session names none and runs on one machine, a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="sqlloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        stream = self.fs.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
            stream.hflush()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a file that isn't there yet; False where it is."""
        if not self.fs.createNewFile(self._path(name)):
            return False
        self._write(name, text, True)
        return True

    def replace(self, name: str, text: str) -> None:
        """Puts a whole new file in place of the old one."""
        self._write(f"{name}.new", text, True)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri() if ":" in self.root else self.fs.getUri(), self.conf)
        over = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = over
        context.rename(self.fs.makeQualified(self._path(f"{name}.new")), self.fs.makeQualified(self._path(name)), options)

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []
