"""Documents of pages as a source: files are planned, and only the pages that are asked for are read.

    spark.dataSource.register(page_source("deck_text", count_pages, read_page, "text string"))
    spark.read.format("deck_text").option("pages", "0,2-5").load(folder)
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Document(InputPartition):
    path: str


def page_source(format_name: str, count_pages: Callable[[bytes], int], read_page: Callable[[bytes, int], Iterable[tuple]], columns: str, endings: str = ".*") -> type[DataSource]:
    """A data source of path, page_index and the columns that read_page gives a row for.

    A document is a task. Option document (a file's name) leaves others unopened, and option pages
    (as 0,2-5) others unparsed. They are options and not conditions that Spark hands down, as what
    one query has handed to a table stays with it for the next.
    """

    class Pages(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return f"path string, page_index int, {columns}"

        def reader(self, schema: StructType) -> Reader:
            return Reader(self.options["path"], self.options.get("document"), self.options.get("pages"))

    class Reader(DataSourceReader):
        def __init__(self, folder: str, name: str | None, pages: str | None):
            self.folder, self.only = folder, name
            ranges = [tuple(map(int, (p + "-" + p).split("-")[:2])) for p in pages.replace(" ", "").split(",")] if pages else None
            self.wanted = (lambda page: any(lo <= page <= hi for lo, hi in ranges)) if ranges else (lambda page: True)

        def partitions(self) -> list[Document]:
            from pyarrow import fs

            from folioqc.sources.files import store_of

            store, root = store_of(self.folder)
            found = sorted(i.path for i in store.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and re.fullmatch(endings, i.path))
            return [Document(p) for p in found if self.only in (None, p.rpartition('/')[2])]

        def read(self, partition: Document) -> Iterator[tuple]:
            from folioqc.sources.files import store_of

            if partition is None:  # no document was planned
                return
            store, _ = store_of(self.folder)
            with store.open_input_file(partition.path) as file:
                content = file.read()
            for page in filter(self.wanted, range(count_pages(content))):
                for row in read_page(content, page):
                    yield (partition.path, page, *row)

    return Pages
