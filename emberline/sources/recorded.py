"""A Python data source over recorded JSON lines, with one partition a file: spark.read.format("recorded").load(dir)."""

from __future__ import annotations

import json
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class RecordedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[FilePartition]:
        names = sorted(os.listdir(self.path)) if os.path.isdir(self.path) else [""]
        return [FilePartition(os.path.join(self.path, n) if n else self.path) for n in names if not n.startswith((".", "_"))]

    def read(self, partition: FilePartition):
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    row = json.loads(line)
                    yield row.get("provider"), row.get("query"), json.dumps(row.get("body"), ensure_ascii=False)


class RecordedSource(DataSource):
    """Shared folders only: every executor opens the files by the path given."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return "provider string, query string, body string"

    def reader(self, schema) -> RecordedReader:
        return RecordedReader(self.options)
