"""A sink for whole files with a commit: a Spark data source that writes one file a row.

Tasks write below a staging folder of the job, each attempt in a folder of its own. Only when all tasks are done does the
commit move the files of the attempts that Spark counts, one attempt after the other; a job that fails leaves no
output, and a task that runs twice leaves one. Files that are there already under the same names are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from spanforge.sources.store import open_store

NAME = "spanforge_files"
STAGING = ".staging-"


@dataclass
class Written(WriterCommitMessage):
    """Where one attempt of a task has its files, and how many."""

    attempt: str
    files: int


class FilesSink(DataSource):
    """``target`` (a path relative to the option ``path``) and ``content`` of each row become a file; rows whose content is null are passed over."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "target string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FilesWriter(self.options["path"])


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder, self.staging = folder, f"{STAGING}{uuid.uuid4().hex}"
        store, base = open_store(folder)
        store.create_dir(f"{base}/{self.staging}", recursive=True)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyarrow import fs

        store, base = open_store(self.folder)
        attempt = f"{self.staging}/{uuid.uuid4().hex}"
        n = 0
        for target, content in ((r[0], r[1]) for r in rows):
            if content is not None:
                if store.get_file_info(f"{base}/{self.staging}").type == fs.FileType.NotFound:
                    raise RuntimeError("the job was aborted")  # a task that is late must not begin the folder again
                place = f"{base}/{attempt}/{target}"
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(place) as sink:
                    sink.write(bytes(content))
                n += 1
        return Written(attempt, n)

    def commit(self, messages) -> None:
        from pyarrow import fs

        store, base = open_store(self.folder)
        for message in messages:
            if message is not None and message.files:
                # folder by folder: the driver holds the names of one folder of one attempt
                below = [""]
                while below:
                    folder = below.pop()
                    for info in store.get_file_info(fs.FileSelector(f"{base}/{message.attempt}/{folder}".rstrip("/"))):
                        place = f"{folder}/{info.base_name}".lstrip("/")
                        if info.is_file:
                            store.create_dir(f"{base}/{place}".rpartition("/")[0], recursive=True)
                            store.move(info.path, f"{base}/{place}")
                        else:
                            below.append(place)
        self._clear(store, base)

    def abort(self, messages) -> None:
        self._clear(*open_store(self.folder))

    def _clear(self, store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{base}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{base}/{self.staging}")


def write_files(df: DataFrame, folder: str) -> None:
    """Write ``target, content`` rows as files below a folder that all executors see."""
    df.sparkSession.dataSource.register(FilesSink)
    df.select("target", "content").write.format(NAME).mode("append").option("path", folder).save()
