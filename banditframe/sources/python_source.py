"""User-made sources through Spark's Python data source interface, and user-made sinks through its text writer."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class LinesSource(DataSource):
    """Rows of a JSON list given as the option `rows`, dealt over `parts` tasks. A template for sources of one's own."""

    @classmethod
    def name(cls) -> str:
        return "banditframe_rows"

    def schema(self) -> str:
        return self.options.get("schema", "value string")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.rows, self.parts = json.loads(options.get("rows", "[]")), int(options.get("parts", 2))

    def partitions(self):
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition):
        for row in self.rows[partition.value :: self.parts]:
            yield tuple(row) if isinstance(row, list) else (row,)


def write_made(df: DataFrame, path: str, make: Callable[[Iterator[pd.DataFrame]], Iterator[str]], gzip: bool = False) -> None:
    """Writes the lines that make gives for the frames of each task, by Spark's own text writer: to any file system that Spark knows,
    once for each task that ends well, whatever tasks fail."""

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = iter(make(frames))
        while part := list(islice(made, 10_000)):
            yield pd.DataFrame({"value": part})

    df.mapInPandas(lines, "value string").write.mode("append").option("compression", "gzip" if gzip else "none").text(path)
