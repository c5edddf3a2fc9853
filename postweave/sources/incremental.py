"""Runs that recompute only what changed among the input files.

A run compares the manifest of the input with that of the last run that was committed.  The
rows of added and changed files are computed and written; rows of files that went
or changed are left behind, since the new manifest no longer names them.  Manifest
and parts are committed as one (``sources.snapshots``), so a run that dies changes nothing.
With ``folders`` the files of one folder, as one Spark write makes them, stand for one file.

    root/versions, root/commits   manifests: path, version, and the part that holds the rows
    root/parts/<part>             rows of the files that one run computed
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postweave.session import broadcast_if_small
from postweave.sources.manifest import data_version, file_version, manifest
from postweave.sources.snapshots import current, publish

_FILES = "path STRING, version STRING, part STRING"
#: Column that tells the file of a row, in the written parts.
SOURCE = "__source"


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, version, part, change`` for all paths of two manifests ``path, version``.

    ``change`` is added, changed, removed or same; ``part`` comes from ``before``.
    """
    old = before.select("path", F.col("version").alias("__old"), "part")
    both = after.select("path", "version").join(old, "path", "full")
    change = (
        F.when(F.col("__old").isNull(), "added")
        .when(F.col("version").isNull(), "removed")
        .when(F.col("version") != F.col("__old"), "changed")
        .otherwise("same")
    )
    return both.select("path", "version", "part", change.alias("change"))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


class IncrementalRun:
    """Keeps ``transform`` of the files below ``source`` up to date.

    ``transform`` works row by row: what it gives for a row may not depend on rows of other
    files.  It sees the columns of ``schema`` and may drop rows or make several.

    ``folders``: what is compared, counted and computed again is not a file but a folder that
    holds files.  Its version changes with any file of it.
    """

    def __init__(
        self,
        spark: SparkSession,
        source: str,
        schema: str,
        root: str,
        transform: Callable[[DataFrame], DataFrame],
        fmt: str = "parquet",
        glob: str = "*",
        folders: bool = False,
    ):
        self.spark, self.source, self.schema, self.root = spark, source, schema, root
        self.transform, self.fmt, self.glob, self.folders = transform, fmt, glob, folders

    def _committed(self) -> DataFrame:
        last = current(self.spark, self.root)
        return last.table(self.spark, "files") if last else self.spark.createDataFrame([], _FILES)

    def _listed(self) -> DataFrame:
        return manifest(self.spark, self.source, self.glob).where(~F.col("name").rlike("^[_.]"))

    def changes(self, files: DataFrame | None = None) -> DataFrame:
        """What a run would find now: a listing, no file is read."""
        files = self._listed() if files is None else files
        if self.folders:
            now = data_version(files.withColumn("folder", _folder(F.col("path"))), ["folder"])
            now = now.withColumnRenamed("folder", "path")
        else:
            now = files.select("path", file_version(F.col("modificationTime"), F.col("length")).alias("version"))
        return manifest_changes(self._committed(), now)

    def _computed(self, paths: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema).format(self.fmt)
        rows = reader.load(paths) if paths else self.spark.createDataFrame([], self.schema)
        # The file of a row, or its folder, goes along under a private name.
        found = _folder(F.col("_metadata.file_path")) if self.folders else F.col("_metadata.file_path")
        source = found if paths else F.lit(None).cast("string")
        return self.transform(rows.select("*", source.alias(SOURCE)))

    def run(self) -> dict[str, int]:
        """Bring the result up to date; files by kind of change.

        The paths of new and changed files pass through the driver, as those of any scan do.
        """
        # One listing decides, whatever arrives meanwhile.
        files = self._listed()
        found = self.changes(files).collect()
        counts = {kind: sum(r["change"] == kind for r in found) for kind in ("added", "changed", "removed", "same")}
        if not counts["added"] + counts["changed"] + counts["removed"] and current(self.spark, self.root):
            return counts
        part = uuid.uuid4().hex
        new = {r["path"] for r in found if r["change"] in ("added", "changed")}
        unit = _folder(F.col("path")) if self.folders else F.col("path")
        fresh = [r["path"] for r in files.select("path", unit.alias("unit")).collect() if r["unit"] in new]
        if fresh:
            self._computed(fresh).write.parquet(f"{self.root}/parts/{part}")
        kept = [(r["path"], r["version"], part if r["path"] in new else r["part"]) for r in found if r["change"] != "removed"]
        publish(self.spark, self.root, {"files": self.spark.createDataFrame(kept, _FILES)})
        return counts

    def result(self) -> DataFrame:
        """The rows of all files of the last committed run."""
        return self._rows().drop(SOURCE)

    def _rows(self) -> DataFrame:
        files = self._committed().select(F.col("path").alias(SOURCE), "part")
        parts = [r["part"] for r in files.select("part").distinct().collect()]
        kind = self._computed([]).schema
        if not parts:
            return self.spark.createDataFrame([], kind)
        # A part holds few files; rows of a file that has changed since are not asked for.
        rows = self.spark.read.schema(kind).parquet(*[f"{self.root}/parts/{p}" for p in parts])
        held = F.element_at(F.split("_metadata.file_path", "/"), -2)
        wanted, _ = broadcast_if_small(files)
        rows = rows.withColumn("__part", held).join(
            wanted.withColumnRenamed("part", "__part"), [SOURCE, "__part"], "left_semi"
        )
        return rows.drop("__part")

    def compact(self) -> None:
        """Write the current rows as one part, without what was left behind."""
        files = self._committed()
        part = uuid.uuid4().hex
        self._rows().write.parquet(f"{self.root}/parts/{part}")
        publish(self.spark, self.root, {"files": files.withColumn("part", F.lit(part))})
