"""Folders of any file system that Spark reaches: listing, markers, removal."""

from pyspark.sql import SparkSession


class Folders:
    """File-system calls on paths, through the session's own configuration."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Names of the entries of a folder; none without the folder."""
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def remove(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def mark(self, path: str) -> None:
        """An empty file; its name is all that counts."""
        p, fs = self._at(path)
        fs.mkdirs(p.getParent())
        fs.create(p, True).close()
