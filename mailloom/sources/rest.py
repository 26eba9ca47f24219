"""A paged REST source: one input partition per page, batch and resumable stream."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

PAGE, TIMEOUT = 1000, 30


class Page(InputPartition):
    def __init__(self, offset: int, limit: int) -> None:
        self.offset, self.limit = offset, limit


def _get(url: str, timeout: float) -> object:
    with urlopen(url, timeout=timeout) as answer:  # raises on an HTTP error
        return json.loads(answer.read())


class _Pages:
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names = schema.names
        self.base = options["url"].rstrip("/")
        self.page = int(options.get("page", PAGE))
        self.timeout = float(options.get("timeout", TIMEOUT))
        self.total_field = options.get("total", "total_emails")

    def total(self) -> int:
        return int(_get(f"{self.base}/stats", self.timeout)[self.total_field])

    def pages(self, start: int, end: int) -> list[Page]:
        return [Page(o, min(self.page, end - o)) for o in range(start, end, self.page)]

    def read(self, partition: Page) -> Iterator[tuple]:
        """Records as text fields and lists, cast by the engine afterwards; a record that is no object raises."""
        for r in _get(f"{self.base}/emails?offset={partition.offset}&limit={partition.limit}", self.timeout):
            if not isinstance(r, dict):
                raise ValueError(f"no record: {str(r)[:80]}")
            yield tuple(r.get("from") if n == "sender" and n not in r else r.get(n) for n in self.names)


class _Reader(_Pages, DataSourceReader):
    def partitions(self) -> list[Page]:
        return self.pages(0, self.total()) or [Page(0, 0)]


class _Stream(_Pages, DataSourceStreamReader):
    """Offsets are record counts; the checkpoint keeps what was read, so finished pages are never read again."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"offset": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"offset": self.total()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.pages(start["offset"], end["offset"])

    def commit(self, end: dict) -> None:
        pass


class PagedRest(DataSource):
    """spark.read.format("pagedrest").option("url", ...): /stats tells the total, /emails?offset=&limit= the records."""

    @classmethod
    def name(cls) -> str:
        return "pagedrest"

    def schema(self) -> str:
        return "id long, message_id string, date string, sender string, subject string, body string, x_folder string, x_origin string"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, self.options)

    def streamReader(self, schema: StructType) -> _Stream:  # noqa: N802
        return _Stream(schema, self.options)
