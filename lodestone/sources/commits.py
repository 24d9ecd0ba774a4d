"""Versions of a set of tables that become visible in one step, of any number of writers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.artifacts import folder


class Conflict(Exception):
    """Another writer has committed the version first."""


class Log:
    """Commits under ``root``: version n is the file ``commits/n.json``, which names the folders of its tables.

    Tables are written to fresh folders, which nobody reads before a commit
    names them; the commit file is written aside and renamed to its number, and
    a rename does not replace a file. So of two writers on the same version one
    gets a ``Conflict``, and a writer that fails leaves no trace in what is read.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def versions(self) -> list[int]:
        at = folder(self.spark, f"{self.root}/commits")
        return sorted(int(n.removesuffix(".json")) for n in at.names() if n.endswith(".json") and not n.startswith((".", "_"))) if at.exists() else []

    def read(self, version: int) -> dict:
        return json.loads(folder(self.spark, f"{self.root}/commits/{version:012d}.json").text())

    def last(self) -> tuple[int, dict]:
        """The last version and what it holds; (0, {}) before the first."""
        found = self.versions()
        return (found[-1], self.read(found[-1])) if found else (0, {})

    def put(self, df: DataFrame, name: str) -> str:
        """Writes a table that a commit may name; the folder's name."""
        to = f"{name}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{to}")
        return to

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    def commit(self, expected: int, content: dict) -> int:
        """Publishes ``content`` as the version after ``expected``, if that is still the last one."""
        aside = folder(self.spark, f"{self.root}/commits/_{uuid.uuid4().hex}")
        aside.write(json.dumps(content, sort_keys=True))
        if not aside.renamed(f"{self.root}/commits/{expected + 1:012d}.json"):
            raise Conflict(f"version {expected + 1} of {self.root} is taken")
        return expected + 1

    def vacuum(self, keep: int = 1) -> list[str]:
        """Deletes folders that none of the last ``keep`` commits names, and older commits; for a time without writers."""
        found = self.versions()
        named = json.dumps([self.read(v) for v in found[-keep:]])
        gone = [n for n in folder(self.spark, self.root).names() if n != "commits" and f'"{n}"' not in named]
        for name in gone:
            folder(self.spark, f"{self.root}/{name}").delete()
        for v in found[:-keep]:
            folder(self.spark, f"{self.root}/commits/{v:012d}.json").delete()
        return gone
