"""A log of versions in a folder: each version is one small file that only one writer can make.

A writer reads version n, prepares n + 1 beside it, and puts its file in place only if none
is there. Of two writers that started from the same version one succeeds, the other gets
``Conflict`` and may start again from what is there now. Readers take the highest version,
which is either there whole or not at all.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer made the version first."""


class Commits:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, jvm = spark, spark.sparkContext._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.folder = self.path(folder)
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.store = self.folder.getFileSystem(self.conf)

    def latest(self) -> int:
        """The highest version, 0 if there is none."""
        if not self.store.exists(self.folder):
            return 0
        names = [f.getPath().getName() for f in self.store.listStatus(self.folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def read(self, version: int) -> dict:
        stream = self.store.open(self.path(self.folder, f"{version:012d}.json"))
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)))
        finally:
            stream.close()

    def put(self, version: int, content: dict) -> int:
        """Make a version from what was prepared; ``Conflict`` if it is there already."""
        self.store.mkdirs(self.folder)
        final, beside = self.path(self.folder, f"{version:012d}.json"), self.path(self.folder, f".{uuid.uuid4().hex}")
        out = self.store.create(beside, False)
        try:
            out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            out.close()
        try:
            if self.store.getUri().getScheme() == "file":
                os.link(beside.toUri().getPath(), final.toUri().getPath())  # fails if it is there, unlike a local rename
            else:
                none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm = self.spark.sparkContext._jvm
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.folder.toUri(), self.conf).rename(beside, final, none)
        except FileExistsError:
            raise Conflict(f"version {version} is there already") from None
        except Exception as e:
            if self.store.exists(final):
                raise Conflict(f"version {version} is there already") from e
            raise
        finally:
            self.store.delete(beside, False)
        return version

    def change(self, how: Callable[[dict], dict], start: dict, attempts: int = 5) -> dict:
        """Read, change and put, again from the newest version after each conflict."""
        for left in range(attempts - 1, -1, -1):
            version = self.latest()
            content = how(self.read(version) if version else start)
            try:
                self.put(version + 1, content)
                return content
            except Conflict:
                if not left:
                    raise
        raise AssertionError
