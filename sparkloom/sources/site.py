"""Trees of files as a sink: a page for each route, whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .listing import files_below, located, with_contents


class _Written(WriterCommitMessage):
    def __init__(self, files: int, size: int) -> None:
        self.files, self.size = files, size


class SiteTree(DataSource):
    """``format("site_tree")``: rows (path, content) as files below the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "site_tree"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options)["path"], overwrite)


class _Writer(DataSourceWriter):
    """Tasks write below a folder beside the tree; only a commit moves it to the tree's place.

    A file is written under a name of its attempt and then renamed, so that an
    attempt that is cut off leaves no part of a page and one that is repeated
    replaces the same page by the same.
    """

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.staging = f"{self.path}.staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> _Written:
        system, staging = located(self.staging)
        made, files, size = set(), 0, 0
        system.create_dir(f"{staging}/unfinished", recursive=True)
        own = f"{staging}/unfinished/{uuid.uuid4().hex}"
        for path, content in rows:
            parts = (path or "").split("/")
            if any(x in ("", ".", "..") for x in parts):
                raise ValueError(f"not a path inside the tree: {path!r}")
            folder = "/".join([f"{staging}/tree", *parts[:-1]])
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(own) as file:
                file.write(bytes(content or b""))
            system.move(own, f"{folder}/{parts[-1]}")
            files, size = files + 1, size + len(content or b"")
        return _Written(files, size)

    def commit(self, messages: list[_Written | None]) -> None:
        system, staging = located(self.staging)
        _, path = located(self.path)
        system.create_dir(f"{staging}/tree", recursive=True)
        there = system.get_file_info(path).type.name != "NotFound"
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(path)
        if there:
            system.move(path, f"{staging}/replaced")
        try:
            system.move(f"{staging}/tree", path)
        except OSError:
            if there:
                system.move(f"{staging}/replaced", path)
            raise
        system.delete_dir(staging)

    def abort(self, messages: list[_Written | None]) -> None:
        system, staging = located(self.staging)
        if system.get_file_info(staging).type.name != "NotFound":
            system.delete_dir(staging)


def page_path(locale: Column, route: Column, name: str = "index.html") -> Column:
    """Where a locale's page of a route lies in the tree: ``locale/segments/index.html``."""
    segments = F.filter(F.split(route, "/"), lambda x: x != "")
    return F.concat_ws("/", F.array(locale), segments, F.array(F.lit(name)))


def write_site(files: DataFrame, folder: str) -> None:
    """Rows (path, content) as files below ``folder``, in place of all that was there.

    The new tree appears at once when all tasks have ended; if one fails for
    good, what was there stays and nothing of the new one does. ``content`` is
    text or bytes, null makes an empty file. Of rows that repeat a path the
    last by ``pos`` counts, where there is such a column; without it they must
    be equal in what they hold. ``folder`` must be where all executors reach it
    by a path or address that Arrow's file systems know, and on a file system
    whose folders can be renamed.
    """
    files.sparkSession.dataSource.register(SiteTree)
    order = ["pos"] if "pos" in files.columns else []
    placed = files.select("path", F.col("content").cast("binary").alias("content"), *order)
    # equal paths meet in one task, in order, and the last one written stays
    placed = placed.repartition("path").sortWithinPartitions("path", *order).select("path", "content")
    placed.write.format("site_tree").option("path", folder).mode("overwrite").save()


def folder_files(spark: SparkSession, folder: str, below: str = "") -> DataFrame:
    """Rows (path, content) of all files below ``folder``, their paths below ``below``: what ``write_site`` copies into a tree."""
    _, top = located(folder)
    start = F.lit(f"{below.strip('/')}/" if below.strip("/") else "")
    path = F.expr(f"substring(path, {len(top.rstrip('/')) + 2})")
    return with_contents(files_below(spark, folder), folder).select(F.concat(start, path).alias("path"), "content")
