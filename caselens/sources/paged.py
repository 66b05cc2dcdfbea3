"""A paged record service as a Spark data source: one partition per page."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PagedSource(DataSource):
    """``spark.read.format("paged").option("root", folder)``: pages ``page-<n>.json`` of ``{"meta": {"total": n}, "data": [...]}``.

    ``updated_since`` keeps the records changed later; every record comes as its id and JSON text.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, updated_at string, record string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options)


class _Page(InputPartition):
    def __init__(self, n: int):
        self.n = n


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.since = options["root"], options.get("updated_since", "")

    def partitions(self) -> list[_Page]:
        with open(f"{self.root}/page-1.json", encoding="utf-8") as f:
            first = json.load(f)
        size = max(1, len(first["data"]))
        return [_Page(n + 1) for n in range(max(1, -(-first["meta"]["total"] // size)))]

    def read(self, partition: _Page) -> Iterator[tuple]:
        with open(f"{self.root}/page-{partition.n}.json", encoding="utf-8") as f:
            for r in json.load(f)["data"]:
                at = str(r.get("updated_at") or "")
                if at >= self.since:
                    yield str(r["id"]), at, json.dumps(r, ensure_ascii=False)
