"""Files of a tree, found by tasks: the driver hears how many there are, not which."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import shared_folder

_FOUND = "path string, length long, folder boolean"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path on it of a path or address."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def hidden(name: str) -> bool:
    """Whether Spark's readers leave out a file or folder of this name."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))


def files_below(spark: SparkSession, folder: str, without: Callable[[str], bool] = hidden) -> DataFrame:
    """``path``, as its file system knows it, and ``length`` of all files below a folder, or of one file; a written table.

    Folders are listed level by level, each by a task, and what they hold is
    written to the shared folder before the next level. Files and folders whose
    names are ``without`` are left out. A folder that isn't there is an error.
    """
    system, top = located(folder)
    info = system.get_file_info(top)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    out = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = located(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = [x for x in system.get_file_info(fs.FileSelector(path)) if not without(x.base_name)]
                arrays = [pa.array([x.path for x in found], pa.string()), pa.array([x.size if x.is_file else 0 for x in found], pa.int64()), pa.array([not x.is_file for x in found], pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=["path", "length", "folder"])

    level, depth = spark.createDataFrame([(info.path, info.size or 0, not info.is_file)], _FOUND).coalesce(1), 0
    level.write.parquet(f"{out}/level=0")
    while n := (folders := spark.read.schema(_FOUND).parquet(f"{out}/level={depth}").where("folder").select("path")).count():
        depth += 1
        folders.repartition(min(tasks, n), "path").mapInArrow(look, _FOUND).write.parquet(f"{out}/level={depth}")
    return spark.read.option("basePath", out).schema(_FOUND).parquet(f"{out}/level=*").where("NOT folder").select("path", "length")


def as_address(folder: str) -> str:
    """What stands before a path of the folder's file system in the address that Spark's readers give."""
    if "://" not in folder or folder.startswith("file:"):
        return "file:"
    return folder.rstrip("/").removesuffix(located(folder)[1].rstrip("/"))


def with_contents(files: DataFrame, folder: str) -> DataFrame:
    """``files`` of a folder's file system with ``content``, read by as many tasks as the rows are dealt to."""
    tasks = 2 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = located(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_file(path) as file:
                    data = file.read()
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(data)]), pa.array([data], pa.binary())], names=["path", "length", "content"])

    return files.select("path").repartition(tasks, "path").mapInArrow(read, "path string, length long, content binary")
