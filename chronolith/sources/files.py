"""The storage seam: the few file operations that the commit log needs, on any Hadoop file system."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession

from ..status import Status, StoreError


class Files:
    """File operations by path; every call is named, so that a subclass can fail any of them.

    Making a file that must not exist, and renaming to such a name, are single steps: on HDFS by its own create
    and rename, on a local file system by exclusive creation and by a hard link. Object stores without such a
    step do not serve for more than one writer.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def before(self, call: str, path: str) -> None:
        """Runs before every operation; a fault-injecting subclass raises here."""

    def after(self, call: str, path: str) -> None:
        """Runs after every operation that took effect."""

    def _path(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self._conf)

    def _local(self, path: str):
        """The path on the local file system as a java.io.File, or None on any other."""
        p, fs = self._path(path)
        full = fs.makeQualified(p).toUri()
        return self._jvm.java.io.File(full.getPath()) if full.getScheme() == "file" else None

    def make_dir(self, path: str) -> None:
        self.before("make_dir", path)
        p, fs = self._path(path)
        fs.mkdirs(p)
        self.after("make_dir", path)

    def names(self, path: str) -> list[str]:
        p, fs = self._path(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def size(self, path: str) -> int:
        p, fs = self._path(path)
        return fs.getContentSummary(p).getLength()

    def read_text(self, path: str) -> str:
        p, fs = self._path(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> None:
        """Writes a file that must not exist yet."""
        self.before("write_new", path)
        self._write(path, text)
        self.after("write_new", path)

    def _write(self, path: str, text: str) -> None:
        p, fs = self._path(path)
        if (local := self._local(path)) is not None:
            local.getParentFile().mkdirs()
            if not local.createNewFile():
                raise StoreError(Status.IO_ERROR, f"{path} exists")
        try:
            stream = fs.create(p, local is not None)
        except Exception as e:
            raise StoreError(Status.IO_ERROR, f"{path} exists or cannot be made") from e
        stream.write(bytearray(text.encode()))
        stream.close()

    def rename_new(self, source: str, target: str) -> None:
        """Renames, atomically, to a name that must not exist yet."""
        self.before("rename_new", target)
        (s, fs), (t, _) = self._path(source), self._path(target)
        local = self._local(target)
        try:
            if local is not None:
                self._jvm.java.nio.file.Files.createLink(local.toPath(), self._local(source).toPath())
                fs.delete(s, False)
            elif not fs.rename(s, t):
                raise StoreError(Status.IO_ERROR, f"{target} exists or cannot be made")
        except StoreError:
            raise
        except Exception as e:
            raise StoreError(Status.IO_ERROR, f"{target} exists or cannot be made") from e
        self.after("rename_new", target)

    def delete(self, path: str) -> None:
        self.before("delete", path)
        p, fs = self._path(path)
        fs.delete(p, True)
        self.after("delete", path)

    def delete_on_exit(self, path: str) -> None:
        """Deletes the path when the application ends."""
        p, fs = self._path(path)
        fs.deleteOnExit(p)

    def write_frame(self, df, path: str, by: str | None = None, bloom: bool = False) -> None:
        """Writes a frame, in folders of its own for each value of a column if one is named.

        A Bloom filter of the keys takes 64 KiB of a file or more, as its keys need.
        """
        self.before("write_frame", path)
        out = df.write
        if bloom:
            out = out.option("parquet.bloom.filter.enabled#k", "true").option("parquet.bloom.filter.adaptive.enabled", "true")
        (out.partitionBy(by) if by else out).parquet(path)
        self.after("write_frame", path)


def dumps(entry: dict) -> str:
    return json.dumps(entry, sort_keys=True)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder's path below the shared one that spark.checkpoint.dir names; where that is unset, a temporary
    one in local mode, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/store-{uuid.uuid4().hex}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise StoreError(Status.INVALID_ARGUMENT, "set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="chronolith-")
