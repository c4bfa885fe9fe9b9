"""Tables in the shared folder, by which lineage is cut and streams are fed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows that a task may have to hold in a hash table or sort at once.
PART_ROWS = 500_000
#: Options of a writer of many small files into a shared folder that is a local or mounted one: Hadoop starts a process (chmod)
#: for each file it makes there, and with checksum files four times as many. Other file systems are not concerned.
MANY_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def parts(df: DataFrame) -> int:
    """So many partitions that each has ``PART_ROWS`` rows or so, one for each core at least: dealt into them, a task's
    memory does not grow with the table. Counting a given table reads its footers only."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a session of one JVM (tests) falls back to a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Small files of a shared folder, through the file system that Spark itself uses."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(root)
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.root.getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.root, name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder in order; none where it is missing."""
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> bool:
        """A file that appears whole or not at all; false where one of the name is there already."""
        own, path = self._path(f"_unpublished/{uuid.uuid4().hex}"), self._path(name)
        stream = self.fs.create(own, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(path.getParent())
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        none[0] = options.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.root.toUri(), self.conf)
        try:
            context.rename(own, path, none)
        except Exception:
            if not self.fs.exists(path):
                raise
            self.fs.delete(own, False)
            return False
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
