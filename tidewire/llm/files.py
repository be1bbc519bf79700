"""Files that tasks write and read: any store with a pyarrow file system, named by URI."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from tidewire.session import scratch_path


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain absolute path is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one. Tasks create it, so the driver needs no access."""
    return scratch_path(spark, f"llm-{name}")


def open_file(uri: str):
    """A random-access file."""
    system, path = store(uri)
    return system.open_input_file(path)


class Sink:
    """One file of a task, written piece by piece under a name no other attempt uses.

    A repeated or speculative task writes another file; only files that reach the written list of the successful
    attempt are ever read.
    """

    def __init__(self, folder: str, name: str):
        system, path = store(folder)
        system.create_dir(path, recursive=True)
        stem, dot, ending = name.partition(".")
        name = f"{stem}-{uuid.uuid4().hex}{dot}{ending}"
        self.uri, self.size = f"{folder}/{name}", 0
        self.stream = system.open_output_stream(f"{path}/{name}", compression=None)

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()


def write_file(folder: str, name: str, content: bytes) -> str:
    """A whole file at once; returns its URI."""
    sink = Sink(folder, name)
    sink.write(content)
    sink.close()
    return sink.uri
