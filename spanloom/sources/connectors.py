"""Connectors as Python data sources: one partition for each connector, errors as rows.

A connector gives documents for its configuration.  ``register`` makes the format
``connectors`` known to a session:

    spark.read.format("connectors").option("configs", json).option("max_documents", 100).load()

``configs`` is a JSON list of {"id", "type", "config"}.  A connector that fails, or that no
one has registered, gives one row with ``error``; the others go on.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "connector_id string, nth long, name string, content string, source_origin string, error string"


def webhook(config: dict) -> Iterator[tuple[str, str]]:
    """(name, content) of the documents in the configuration; values that are no text become JSON."""
    for i, doc in enumerate(config.get("documents", [])):
        content = doc.get("content")
        text = content if isinstance(content, str) else "" if content is None else json.dumps(content, separators=(",", ":"), ensure_ascii=False)
        if text.strip():
            yield doc.get("name") or f"webhook-{i}", text


#: Messages of a channel, and channels, that a chat connector reads.
MOST_CHANNELS, MOST_MESSAGES = 20, 200


def chat(config: dict) -> Iterator[tuple[str, str]]:
    """(name, content) of channels: the texts of their messages, a line each.

    ``config["channels"]`` maps a channel's name to its messages; a caller with access to
    a chat service fetches them.
    """
    for name, messages in islice(config.get("channels", {}).items(), MOST_CHANNELS):
        text = "\n".join(m["text"] for m in messages[:MOST_MESSAGES] if m.get("text", "").strip())
        if text:
            yield name, text


class Registry:
    """Connector types by name."""

    def __init__(self):
        self.types: dict[str, Callable[[dict], Iterator[tuple[str, str]]]] = {}

    def add(self, name: str, fetch: Callable[[dict], Iterator[tuple[str, str]]]) -> None:
        if name in self.types:
            raise ValueError(f"connector type {name} is registered already")
        self.types[name] = fetch

    def get(self, name: str) -> Callable[[dict], Iterator[tuple[str, str]]]:
        if name not in self.types:
            raise KeyError(f"no connector type {name}; there are {', '.join(sorted(self.types))}")
        return self.types[name]


registry = Registry()
registry.add("webhook", webhook)
registry.add("chat", chat)


class _One(InputPartition):
    def __init__(self, ident: str, kind: str, config: dict):
        super().__init__(ident)
        self.ident, self.kind, self.config = ident, kind, config


class _Reader(DataSourceReader):
    def __init__(self, options, types):
        self.configs = json.loads(options.get("configs", "[]"))
        self.most = int(options.get("max_documents", 1_000))
        self.types = types

    def partitions(self):
        return [_One(str(c.get("id", i)), c.get("type", ""), c.get("config", {})) for i, c in enumerate(self.configs)] or [_One("", "", {})]

    def read(self, partition):
        if not partition.ident and not self.configs:
            return
        done = 0
        try:
            if partition.kind not in self.types:
                raise KeyError(f"no connector type {partition.kind}")
            for name, content in islice(self.types[partition.kind](partition.config), self.most):
                yield partition.ident, done, name, content, "connector", None
                done += 1
        except Exception as e:  # a connector may fail in any way, and must not take the others with it
            yield partition.ident, done, None, None, "connector", f"{type(e).__name__}: {e}"


class Connectors(DataSource):
    @classmethod
    def name(cls):
        return "connectors"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options, dict(registry.types))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Connectors)
