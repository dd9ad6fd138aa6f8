"""Inventory of the files below a root folder, from listings only."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: top-level folders that a task lists
FOLDERS = 256


@dataclass
class Folders(InputPartition):
    """Paths and names of top-level folders, listed by one task."""

    folders: list[tuple[str, str]]


def opened(root: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:/") else (fs.LocalFileSystem(), root)


class FolderReader(DataSourceReader):
    def __init__(self, root: str, name_pattern: str) -> None:
        self.root, self.name_pattern = root, name_pattern

    def partitions(self) -> Sequence[InputPartition]:
        """The folders right below the root; only this level is listed here."""
        from pyarrow import fs

        store, path = opened(self.root)
        found = store.get_file_info(fs.FileSelector(path))
        wanted = [(f.path, f.base_name) for f in found if f.type == fs.FileType.Directory and re.search(self.name_pattern, f.base_name)]
        return [Folders(wanted[i : i + FOLDERS]) for i in range(0, len(wanted), FOLDERS)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = opened(self.root)
        for path, name in partition.folders:
            yield name, None, None
            for f in store.get_file_info(fs.FileSelector(path, recursive=True)):
                if f.type == fs.FileType.File:
                    yield name, f.path[len(path) :].lstrip("/"), f.size


class FolderListing(DataSource):
    """`name, path, length` of every file below the top-level folders of `root`, empty and hidden ones too, and a row without a path for every folder.

    A task lists up to FOLDERS of them. The root is a path or URI that pyarrow opens (local, hdfs, s3, gs).
    """

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "name STRING, path STRING, length LONG"

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["root"], self.options["names"])


def list_folders(spark: SparkSession, root: str, name_pattern: str) -> DataFrame:
    spark.dataSource.register(FolderListing)
    return spark.read.format("folder_listing").options(root=unquote(root), names=name_pattern).load()


def file_inventory(spark: SparkSession, root: str, name_pattern: str = r"^[A-Za-z0-9._-]+$", marker: str = r"^session_ok$") -> DataFrame:
    """Bytes, number of non-empty files and a marker-file flag per top-level folder, by name; odd names are skipped.

    Contents are never read, only path and length. The marker, which may be empty, is a file right in the folder whose name matches. Names that
    begin with a dot or an underscore, which Spark takes for hidden, count only as markers.
    """
    files = list_folders(spark, root, name_pattern)
    shown = ~F.substring_index("path", "/", -1).rlike("^[._]")
    return files.groupBy("name").agg(
        F.coalesce(F.sum(F.when(shown, F.col("length"))), F.lit(0)).alias("size_bytes"),
        F.count_if(shown & (F.col("length") > 0)).alias("filled_files"),
        F.coalesce(F.bool_or(F.col("path").rlike(marker)), F.lit(False)).alias("marker_present"),
        F.lit(True).alias("present"),
    ).orderBy("name")
