"""Versions of stored data: a manifest that is published last says which folders make up a version.

Writers put data into folders of their own, which nothing reads until a manifest names them, and publish
the manifest under the next number. A number can be taken once, by a rename that doesn't overwrite, so of
two writers one has to look at the other's version and try again; whatever a writer leaves unfinished is
never read. Readers take one manifest and read what it names, whatever is published meanwhile. Old
versions go by `expire`. Everything goes through Hadoop's file systems, from the driver.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession

#: Attempts at publishing before a writer gives up.
ATTEMPTS = 50


class Snapshots:
    """The versions at a place."""

    def __init__(self, spark: SparkSession, place: str) -> None:
        self.spark, self.place = spark, place.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.place).getFileSystem(self._conf)

    def _path(self, where: str):
        return self._jvm.org.apache.hadoop.fs.Path(where)

    def names(self, folder: str) -> list[str]:
        """Names in a folder below the place; none if it is absent."""
        where = self._path(f"{self.place}/{folder}")
        return sorted(f.getPath().getName() for f in self._files.listStatus(where)) if self._files.exists(where) else []

    def numbers(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.names("manifests") if n.endswith(".json") and not n.startswith(("_", "."))]

    def read(self, number: int) -> dict:
        stream = self._files.open(self._path(self._manifest(number)))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """Number and content of the newest version; (0, {}) without one."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, {})

    def _manifest(self, number: int) -> str:
        return f"{self.place}/manifests/{number:012d}.json"

    def new_folder(self) -> str:
        """A folder for data that no version names yet, relative to the place."""
        return f"data/{uuid.uuid4().hex}"

    def publish(self, number: int, content: dict) -> bool:
        """Make content the version of this number; False if another writer has taken the number."""
        draft = self._path(f"{self.place}/manifests/_{uuid.uuid4().hex}")
        stream = self._files.create(draft, False)
        stream.write(bytearray(json.dumps(content).encode()))
        stream.close()
        target = self._path(self._manifest(number))
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else self._files.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, target, none)  # fails where the target is there
            return True
        except Exception:
            self._files.delete(draft, False)
            if self._files.exists(target):
                return False
            raise

    def expire(self, keep: int = 2, older_than_s: float = 3600) -> list[str]:
        """Delete all but the newest `keep` versions and the folders that these don't name; returns the folders.

        Folders younger than `older_than_s` stay, since a writer may be about to publish them.
        """
        numbers = self.numbers()
        named = set()
        for number in numbers[-keep:] if keep else []:
            named.update(self.read(number).get("folders", []))
        for number in numbers[: len(numbers) - keep]:
            self._files.delete(self._path(self._manifest(number)), False)
        gone, limit = [], (time.time() - older_than_s) * 1000
        for name in self.names("data"):
            where = self._path(f"{self.place}/data/{name}")
            if f"data/{name}" not in named and self._files.getFileStatus(where).getModificationTime() <= limit:
                self._files.delete(where, True)
                gone.append(f"data/{name}")
        return gone
