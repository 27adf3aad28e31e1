"""A folder of files that is published job by job.

Tasks write their files under names of their own and report them; the driver makes them the
folder's content by one new entry of its log, so readers see all files of the last job that
committed or none of a later one. What a killed task or an aborted job has written is never listed.

    spark.dataSource.register(Published)
    files.write.format("published").mode("overwrite").save(folder)      # name string, content binary
    spark.read.format("published").load(folder)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Files that one task reads.
FILES = 64


@dataclass
class Wrote(WriterCommitMessage):
    files: list[tuple[str, str]]


@dataclass
class Share(InputPartition):
    files: list[tuple[str, str]]


def _log(folder: str):
    from folioqc.sources.files import store_of

    store, root = store_of(folder)
    return store, root


def entries(folder: str) -> list[str]:
    """The log's entries, oldest first."""
    from pyarrow import fs

    store, root = _log(folder)
    found = store.get_file_info(fs.FileSelector(f"{root}/_log", allow_not_found=True))
    return sorted(i.path for i in found if i.path.endswith(".json"))


def current(folder: str) -> list[tuple[str, str]]:
    """(name, file) of what is published now."""
    store, _ = _log(folder)
    listed = entries(folder)
    if not listed:
        return []
    with store.open_input_file(listed[-1]) as file:
        return [tuple(x) for x in json.loads(file.read())["files"]]


class Published(DataSource):
    @classmethod
    def name(cls) -> str:
        return "published"

    def schema(self) -> str:
        return "name string, content binary"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("names"))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], [f.name for f in schema], overwrite)


class Reader(DataSourceReader):
    """Only files whose names are asked for (option names: a JSON list) are planned and opened."""

    def __init__(self, folder: str, names: str | None):
        self.folder, self.names = folder, None if names is None else set(json.loads(names))

    def partitions(self) -> list[Share]:
        files = [f for f in current(self.folder) if self.names is None or f[0] in self.names]
        return [Share(files[k : k + FILES]) for k in range(0, len(files), FILES)] or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        store, _ = _log(self.folder)
        for name, path in partition.files:
            with store.open_input_file(path) as file:
                yield name, file.read()


class Writer(DataSourceWriter):
    def __init__(self, folder: str, columns: list[str], overwrite: bool):
        if {"name", "content"} - set(columns):
            raise ValueError("published files have name and content")
        self.folder, self.at, self.overwrite = folder, [columns.index(c) for c in ("name", "content")], overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Wrote:
        store, root = _log(self.folder)
        folder = f"{root}/_data/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        files = []
        for row in iterator:
            name, content = (row[k] for k in self.at)
            path = f"{folder}/{len(files):06d}"
            with store.open_output_stream(path) as out:
                out.write(bytes(content or b""))
            files.append((name, path))
        return Wrote(files)

    def commit(self, messages: list[Wrote | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        if len({name for name, _ in files}) < len(files):
            self.abort(messages)
            raise ValueError("a name is written twice")
        if not self.overwrite:
            new = {name for name, _ in files}
            files = [f for f in current(self.folder) if f[0] not in new] + files
        store, root = _log(self.folder)
        store.create_dir(f"{root}/_log", recursive=True)
        number = int(listed[-1].rpartition("/")[2].partition("-")[0]) + 1 if (listed := entries(self.folder)) else 0
        hidden = f"{root}/_log/.{self.job}"
        with store.open_output_stream(hidden) as out:
            out.write(json.dumps({"files": files}).encode())
        # The only step that readers can see.
        store.move(hidden, f"{root}/_log/{number:012d}-{self.job}.json")

    def abort(self, messages: list[Wrote | None]) -> None:
        from pyarrow import fs

        store, root = _log(self.folder)
        if store.get_file_info(f"{root}/_data/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_data/{self.job}")
