"""File stores by URI, for sinks that write one file a row."""

from __future__ import annotations

#: Schemes as Spark writes them, and those that pyarrow knows the same stores by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasbs": "abfss", "wasb": "abfs"}


def open_store(uri: str):
    """A pyarrow file system and the path within it; a bare path is local."""
    from pyarrow import fs

    scheme, split, rest = uri.partition("://")
    if not split:
        return fs.LocalFileSystem(), uri.removeprefix("file:").rstrip("/")
    store, path = fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return store, path.rstrip("/")
