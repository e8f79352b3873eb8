"""A data source for lists that come in pages with an opaque token of the next page.

``fetch(token) -> (items, next token or None)`` is named by "module:function",
so that workers can import it.  Pages follow one another, so a list is one
partition; several lists (option lists, comma-separated) are read side by side.
"""

from __future__ import annotations

import importlib

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGES_AT_MOST = 1_000_000
#: What a host provider lists.
HOSTS = "id string, ip string, role string"


class _List(InputPartition):
    def __init__(self, name: str):
        self.name = name


class PagedReader(DataSourceReader):
    def __init__(self, options, schema):
        self.fetch, self.lists, self.fields = options["fetch"], options.get("lists", "all").split(","), schema.names

    def partitions(self):
        return [_List(x) for x in self.lists]

    def read(self, partition):
        module, name = self.fetch.split(":")
        fetch, token = getattr(importlib.import_module(module), name), None
        for _ in range(PAGES_AT_MOST):
            items, token = fetch(partition.name, token)
            for item in items:
                yield tuple(item.get(f) for f in self.fields)
            if token is None:
                return
        raise RuntimeError("the list doesn't end")


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").schema(...).option("fetch", "module:function").load()"""

    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        """That of the option of this name, such as HOSTS, else id and name."""
        return self.options.get("schema", "id string, name string")

    def reader(self, schema):
        return PagedReader(self.options, schema)
