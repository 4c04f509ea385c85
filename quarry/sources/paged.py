"""A Spark data source of landed pages: spark.read.format("landed_pages") and readStream, page ranges being partitions and page numbers offsets.

    spark.dataSource.register(LandedPages)
    spark.read.format("landed_pages").schema("page long, id string, value double").option("path", folder).load()

Pages are files page_<number>.json, each a list of items, on any store that pyarrow's file systems reach (a local folder that all executors share, hdfs://, s3://, gs://).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = re.compile(r"page_([0-9]+)\.json$")


@dataclass
class PageRange(InputPartition):
    """The pages of one task, by number and file."""

    pages: list


class _Files:
    """The landed files of a folder, listed once for each planning."""

    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.per_task, self.counts = int(options.get("pages_per_task", 50)), options.get("counts", "false").lower() == "true"
        if self.schema.fields[0].name != "page":
            raise ValueError("the first column of landed pages is the page's number, `page long`")

    def system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def pages(self) -> dict[int, str]:
        from pyarrow import fs

        system, folder = self.system()
        found = system.get_file_info(fs.FileSelector(folder, recursive=False, allow_not_found=True))
        return {int(m[1]): f.path for f in found if f.is_file and (m := NAME.search(f.base_name))}

    def items(self, file: str) -> list:
        system, _ = self.system()
        with system.open_input_stream(file) as f:
            found = json.loads(f.read().decode("utf-8"))
        return found if isinstance(found, list) else []

    def ranges(self, pages: list[tuple[int, str]]) -> list[PageRange]:
        return [PageRange(pages[i : i + self.per_task]) for i in range(0, len(pages), self.per_task)]

    def rows(self, partition: PageRange) -> Iterator[tuple]:
        for number, file in partition.pages:
            if self.counts:
                yield number, len(self.items(file))
                continue
            for item in self.items(file):
                item = item if isinstance(item, dict) else {}
                yield (number, *(_value(item.get(f.name), f.dataType) for f in self.schema.fields[1:]))


def _value(x, kind: T.DataType):
    """A JSON value as one of a column's type; what does not fit is null."""
    if x is None:
        return None
    if isinstance(kind, T.StructType):
        return tuple(_value(x.get(f.name), f.dataType) for f in kind.fields) if isinstance(x, dict) else None
    if isinstance(kind, T.ArrayType):
        return [_value(v, kind.elementType) for v in x] if isinstance(x, list) else None
    if isinstance(kind, T.MapType):
        return {k: _value(v, kind.valueType) for k, v in x.items()} if isinstance(x, dict) else None
    if isinstance(kind, T.StringType):
        return x if isinstance(x, str) else json.dumps(x)
    if isinstance(kind, T.BooleanType):
        return x if isinstance(x, bool) else None
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
    return x if isinstance(x, int) and not isinstance(x, bool) else None


class LandedPages(DataSource):
    """Landed pages as rows: the page's number, and the named fields of each item. Options: path; pages_per_task (50); counts (false): one row a page instead, with its number of items."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "page long, id string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(_Files(schema, self.options))

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(_Files(schema, self.options))


class _Reader(DataSourceReader):
    """All pages; tasks are planned from the names of files, which executors read."""

    def __init__(self, files: _Files):
        self.files = files

    def partitions(self) -> list[PageRange]:
        return self.files.ranges(sorted(self.files.pages().items())) or [PageRange([])]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.files.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """New pages in order of their numbers. An offset is the number of the first page that was not read; a page waits until all before it have landed."""

    def __init__(self, files: _Files):
        self.files = files

    def initialOffset(self) -> dict:  # noqa: N802
        pages = self.files.pages()
        return {"page": min(pages, default=1)}

    def latestOffset(self) -> dict:  # noqa: N802
        pages = self.files.pages()
        at = min(pages, default=1)
        while at in pages:
            at += 1
        return {"page": at}

    def partitions(self, start: dict, end: dict) -> list[PageRange]:
        pages = self.files.pages()
        return self.files.ranges([(n, pages[n]) for n in range(start["page"], end["page"]) if n in pages])

    def read(self, partition: PageRange) -> Iterator[tuple]:
        return self.files.rows(partition)


def read_pages(spark: SparkSession, path: str, schema: str, per_page: int = 100, pages_per_task: int = 50) -> DataFrame:
    """The rows of landed pages. The first page that is not full is the last: what lies behind it stems from an earlier run and is left out, as in landing.read_pages()."""
    spark.dataSource.register(LandedPages)
    pages = spark.read.format("landed_pages").option("path", path).option("pages_per_task", pages_per_task)
    short = pages.option("counts", "true").schema("page long, n_items long").load().filter(F.col("n_items") < per_page).agg(F.min("page").alias("last"))
    rows = pages.option("counts", "false").schema(schema).load()
    return rows.crossJoin(F.broadcast(short)).filter(F.col("last").isNull() | (F.col("page") <= F.col("last"))).drop("last")
