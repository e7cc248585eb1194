"""Version files: small JSON documents by number in one folder, the greatest of which tells what a store holds.

A document is written beside the others and renamed, so that a reader finds it whole or not at all.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "versions"


class Folder:
    """Files under a path in whatever store Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._of = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._of(f"{self.path}/{name}")

    def numbers(self) -> list[int]:
        """The versions there are, ascending."""
        if not self._fs.exists(self._at(FOLDER)):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(self._at(FOLDER)))
        return sorted(int(n) for n in names if n.isdigit())

    def read(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/{FOLDER}/{number}", wholetext=True).first()[0])

    def latest(self) -> dict | None:
        found = self.numbers()
        return self.read(found[-1]) if found else None

    def commit(self, number: int, document: dict) -> None:
        """Makes a version; one that is there already, by another writer, is an error."""
        new, to = self._at(f"{FOLDER}/.{uuid.uuid4().hex}"), self._at(f"{FOLDER}/{number}")
        out = self._fs.create(new)
        out.write(bytearray(json.dumps(document).encode()))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(new, to):
            self._fs.delete(new, False)
            raise FileExistsError(f"{to} is there already")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
