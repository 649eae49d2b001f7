"""The files of a folder as rows: a Spark data source that lists in tasks. Spark's own readers of files list on the driver, which
holds each file's status, and pass over files of no bytes.

A task lists one folder of the first level and all below it, folder by folder, so a task holds the names of one folder at most; the
driver asks for those of the first level alone.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from spanforge.sources.store import open_store

NAME = "spanforge_listing"


class Listing(DataSource):
    """``path`` of each file below the option ``path``, a folder or, with ``folder`` false, a file, and its ``place`` relative to that."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, place string"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"], self.options["folder"] == "true", self.options["recursive"] == "true")


class ListingReader(DataSourceReader):
    def __init__(self, path: str, folder: bool, recursive: bool):
        self.path, self.folder, self.recursive = path, folder, recursive

    def partitions(self) -> list[InputPartition]:
        """The place itself, without folders in it, and each folder in it, relative to it."""
        below = [name for name, info in self._listed("") if info.type.name == "Directory"] if self.folder and self.recursive else []
        return [InputPartition(""), *map(InputPartition, below)]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        if not self.folder:
            yield self.path, ""
            return
        open_folders = [partition.value]
        while open_folders:
            for name, info in self._listed(open_folders.pop()):
                if info.type.name == "Directory" and partition.value:
                    open_folders.append(name)
                elif info.is_file:
                    yield f"{self.path}/{name}", name

    def _listed(self, folder: str) -> Iterator[tuple[str, object]]:
        """What lies in a folder and is not hidden from Spark, by its place relative to the whole."""
        from pyarrow import fs

        store, base = open_store(self.path)
        for info in store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"))):
            name = info.base_name
            if not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")):
                yield f"{folder}/{name}".lstrip("/"), info


def listed(spark: SparkSession, path: str, folder: bool, recursive: bool) -> DataFrame | None:
    """``path`` of each file below a folder, or of a single one, as Spark writes paths, and its ``place`` relative to it; nothing for
    a store that pyarrow does not know."""
    import pyarrow as pa

    try:
        open_store(path)
    except (pa.ArrowException, OSError):
        return None
    spark.dataSource.register(Listing)
    return spark.read.format(NAME).option("path", path).option("folder", str(folder).lower()).option("recursive", str(recursive).lower()).load()
