"""Versioned folders with a commit pointer: readers see a whole version or the one before it, never half a write.

A store is a folder. ``data`` holds a folder a version under a name of its own; ``commits`` holds one small file a commit, named by
its number, whose content names the version. A commit is the rename of a finished file to the next number, which fails where that
number exists, so of two writers one wins and the other is told. It needs a file system whose rename is atomic and
refuses an existing target (HDFS and local disks; not plain object stores).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_DIGITS = 19


class Conflict(RuntimeError):
    """Another writer has committed that number."""


class Snapshots:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._files = self._path(self.root).getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in self._files.listStatus(path)] if self._files.exists(path) else []

    def commits(self) -> list[int]:
        """The numbers of all commits, in order."""
        return sorted(int(n) for n in self._names("commits") if n.isdigit())

    def latest(self) -> int | None:
        return max(self.commits(), default=None)

    def folder(self, number: int | None = None) -> str:
        """The folder of a commit, by default of the latest; LookupError if there is none."""
        number = self.latest() if number is None else number
        path = None if number is None else self._path(f"{self.root}/commits/{number:0{_DIGITS}d}")
        if path is None or not self._files.exists(path):
            raise LookupError(f"no commit {number} in {self.root}")
        stream = self._files.open(path)
        try:
            return f"{self.root}/data/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()

    def stage(self) -> str:
        """A folder for a new version, which nobody reads before it is published."""
        return f"{self.root}/data/{uuid.uuid4().hex}"

    def publish(self, folder: str, after: int | None) -> int:
        """Commits a staged folder as the version that follows ``after`` (None: the first); Conflict if there is one already."""
        number = 0 if after is None else after + 1
        draft = self._path(f"{self.root}/commits/.draft-{uuid.uuid4().hex}")
        stream = self._files.create(draft)
        stream.write(folder.rsplit("/", 1)[1].encode())
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._files.getUri(), self._conf)
        try:
            context.rename(self._files.makeQualified(draft), self._files.makeQualified(self._path(f"{self.root}/commits/{number:0{_DIGITS}d}")), options)
        except Py4JJavaError as refused:
            self._files.delete(draft, False)
            if "FileAlreadyExists" in str(refused.java_exception):
                raise Conflict(f"commit {number} of {self.root} is taken") from None
            raise
        return number

    def read(self, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.folder(number))

    def write(self, rows: DataFrame, after: int | None = None) -> int:
        """A version of these rows. A failure on the way, or a conflict, leaves the store as it was but for a folder that ``vacuum`` removes."""
        folder = self.stage()
        rows.write.parquet(folder)
        return self.publish(folder, after)

    def update(self, change: Callable[[DataFrame | None], DataFrame | None], attempts: int = 3) -> int | None:
        """Writes change(the latest version), and again from the start if another writer was faster; None from ``change`` leaves the store as it is."""
        for attempt in range(attempts):
            latest = self.latest()
            rows = change(None if latest is None else self.read(latest))
            if rows is None:
                return None
            try:
                return self.write(rows, latest)
            except Conflict:
                if attempt + 1 == attempts:
                    raise

    def vacuum(self, keep: int = 2) -> int:
        """Removes all commits but the last ``keep`` and every folder that no commit names; returns how many folders went. Only while nobody writes."""
        numbers = self.commits()
        for number in numbers[: max(0, len(numbers) - keep)]:
            self._files.delete(self._path(f"{self.root}/commits/{number:0{_DIGITS}d}"), False)
        named = {self.folder(n).rsplit("/", 1)[1] for n in self.commits()}
        loose = [n for n in self._names("data") if n not in named]
        for name in loose:
            self._files.delete(self._path(f"{self.root}/data/{name}"), True)
        return len(loose)
