"""Versions of several tables that change as one.

``publish`` writes the tables below a folder of their own that nobody changes afterwards, and
only then one small commit file that names it.  Readers look for the last commit and read
that folder: whatever is published meanwhile, the tables they see are of one version.

    root/versions/<id>/<table>     the tables
    root/commits/<number>          one line, the id
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Snapshot:
    number: int
    path: str

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")


def commits(spark: SparkSession, root: str) -> DataFrame:
    """``number, id`` of all commits; a file that is not written to its end is none."""
    files = spark.read.format("binaryFile").load(f"{root}/commits")
    line = F.col("content").cast("string")
    number = F.element_at(F.split("path", "/"), -1).cast("long")
    return files.where(line.endswith("\n")).select(number.alias("number"), F.btrim(line, F.lit("\n")).alias("id"))


def current(spark: SparkSession, root: str) -> Snapshot | None:
    """The last version published, or None."""
    try:
        last = commits(spark, root).orderBy(F.desc("number")).first()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return Snapshot(last["number"], f"{root}/versions/{last['id']}") if last else None


def publish(spark: SparkSession, root: str, tables: Mapping[str, DataFrame]) -> Snapshot:
    """Write ``tables`` as the next version.

    A commit number is taken by creating its file, which fails if it exists, so of several
    publishers at once each gets a number of its own and the highest is current.
    """
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/versions/{version}/{name}")
    before = current(spark, root)
    number = before.number + 1 if before else 0
    while not _created(spark, f"{root}/commits/{number:012d}", f"{version}\n"):
        number += 1
    return Snapshot(number, f"{root}/versions/{version}")


def _created(spark: SparkSession, path: str, line: str) -> bool:
    """Create a file in whatever store ``path`` names; False if it is there already."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(target):
        return False
    try:
        out = store.create(target, False)
    except Exception:
        if store.exists(target):
            return False
        raise
    try:
        out.write(bytearray(line.encode()))
    finally:
        out.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store ``path`` names; nothing happens if there is none."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_old(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Remove all but the last ``keep`` versions; the numbers removed."""
    rows = commits(spark, root).orderBy("number").collect()
    gone = rows[: max(len(rows) - max(keep, 1), 0)]
    for row in gone:
        for path in (f"{root}/commits/{row['number']:012d}", f"{root}/versions/{row['id']}"):
            remove(spark, path)
    return [row["number"] for row in gone]


class Published:
    """Something built from the current version, built again when another is published.

    ``load`` gets one ``Snapshot`` and reads all it needs from that.
    """

    def __init__(self, spark: SparkSession, root: str, load: Callable[[SparkSession, Snapshot], object]):
        self.spark, self.root, self._load = spark, root, load
        self.version: int | None = None
        self.loads = 0
        self._value: object = None

    def get(self):
        snapshot = current(self.spark, self.root)
        if snapshot is None:
            raise ValueError(f"nothing is published below {self.root}")
        if snapshot.number != self.version:
            self._value = self._load(self.spark, snapshot)
            self.version = snapshot.number
            self.loads += 1
        return self._value
