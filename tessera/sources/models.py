"""Model servers as data sources.

``model_listing`` reads listings of models in batch, ``token_stream`` the lines of running generations as a
stream. Both take their addresses (http, https or file) from the option ``urls``, one a line; an address is a
partition, so listings of many servers are read side by side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, InputPartition

from tessera.functions import json_ops

LISTING = "model_identifier string, parameter_size string, reported array<string>, families array<string>, info string"
TOKENS = "url string, line long, token string, done boolean, error string"


class Address(InputPartition):
    def __init__(self, url: str, start: int = 0, end: int = 0):
        self.url, self.start, self.end = url, start, end


def _urls(options: dict) -> list[str]:
    found = [u.strip() for u in options.get("urls", "").splitlines()]
    return [u for u in found if u]


def _lines(url: str) -> list[str]:
    """Finished lines of what stands at the address now (the last one may still be written)."""
    with urlopen(url, timeout=120) as answer:
        return answer.read().decode("utf-8", "replace").split("\n")[:-1]


class ModelListing(DataSource):
    """Models of servers: each line of an address is an object with an array ``models``."""

    @classmethod
    def name(cls) -> str:
        return "model_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> ListingReader:
        return (FilteringReader if self.options.get("pushdown") == "true" else ListingReader)(_urls(self.options))


class ListingReader(DataSourceReader):
    def __init__(self, urls: list[str]):
        self.urls = urls
        self.wanted: str | None = None

    def partitions(self) -> list[Address]:
        return [Address(u) for u in self.urls]

    def read(self, partition: Address | None) -> Iterator[tuple]:
        for line in _lines(partition.url) if partition else []:  # Spark reads once where there is no partition
            if not line.strip():
                continue
            try:
                models = json.loads(line)["models"]
            except (ValueError, KeyError, TypeError) as e:
                raise ValueError(f"malformed listing at {partition.url}: {e}") from e
            for m in models:
                if self.wanted is not None and m["name"] != self.wanted:
                    continue
                details = m.get("details") or {}
                families = [*([details["family"]] if details.get("family") else []), *(details.get("families") or [])]
                yield m["name"], details.get("parameter_size"), m.get("capabilities"), families, json.dumps(m.get("model_info") or {})


class FilteringReader(ListingReader):
    """For sessions in which Spark pushes conditions down to Python sources (it refuses such readers in others)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """A wanted model is picked before its details are read; other conditions are left to Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("model_identifier",) and self.wanted in (None, f.value):
                self.wanted = f.value
            else:
                yield f


class TokenStream(DataSource):
    """Lines of generations: ``response`` and ``done``; a malformed line is a row with an error, blank ones are skipped."""

    @classmethod
    def name(cls) -> str:
        return "token_stream"

    def schema(self) -> str:
        return TOKENS

    def streamReader(self, schema) -> TokenReader:
        return TokenReader(_urls(self.options))


class TokenReader(DataSourceStreamReader):
    """Offsets are the lines read of each address (as many as generations are open), so a restart goes on in mid-document."""

    def __init__(self, urls: list[str]):
        self.urls = urls

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.urls, 0)

    def latestOffset(self) -> dict:
        return {u: len(_lines(u)) for u in self.urls}

    def partitions(self, start: dict, end: dict) -> list[Address]:
        return [Address(u, start.get(u, 0), n) for u, n in end.items() if n > start.get(u, 0)]

    def read(self, partition: Address) -> Iterator[tuple]:
        for k, line in enumerate(_lines(partition.url)[partition.start : partition.end], partition.start):
            if not line.strip():
                continue
            try:
                held = json.loads(line)
                token, done = held.get("response", ""), bool(held.get("done", False))
                if not isinstance(token, str):
                    raise ValueError("response is no text")
                row = (token, done, None)
            except (ValueError, AttributeError) as e:
                row = (None, None, f"malformed line: {type(e).__name__}")
            yield partition.url, k, *row


def discovered(spark: SparkSession, urls: list[str]) -> DataFrame:
    """Models of the servers with their capabilities and context length."""
    spark.dataSource.register(ModelListing)
    listed = spark.read.format("model_listing").option("urls", "\n".join(urls)).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")).load()
    return listed.select("model_identifier", json_ops.capabilities(F.col("reported"), F.col("families")).alias("capabilities"), json_ops.context_length(F.col("info")).alias("context_length"), "parameter_size")


def tokens(spark: SparkSession, urls: list[str]) -> DataFrame:
    """A stream of the tokens of generations."""
    spark.dataSource.register(TokenStream)
    return spark.readStream.format("token_stream").option("urls", "\n".join(urls)).load()
