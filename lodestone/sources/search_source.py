"""An external search system as a data source of Spark: ``spark.read.format("lodestone_search")``.

Options: ``client``, a function of a query and a number of results as ``module:name``, which
every executor can import; ``queries``, a JSON list of ``[qid, query]`` (a stated set, at most ``MOST_QUERIES``);
``top_k``; ``partitions``. Each partition asks for its share of the queries. Filters on ``qid`` and
upper bounds on ``rank`` are pushed into the reader: queries that cannot match are not asked, and
no more results than can match are asked for. ``register`` turns on the setting that this needs. A query that fails is a row with
its message.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "qid long, rank int, text string, score double, source_uri string, metadata string, error string"
MOST_QUERIES = 100_000


class Share(InputPartition):
    def __init__(self, asked: list):
        super().__init__(len(asked))
        self.asked = asked


class SearchReader(DataSourceReader):
    def __init__(self, options: dict):
        self.client = options["client"]
        self.asked = [(int(qid), query) for qid, query in json.loads(options["queries"])]
        if len(self.asked) > MOST_QUERIES:
            raise ValueError(f"more than {MOST_QUERIES} queries")
        self.top_k, self.n = int(options.get("top_k", "5")), int(options.get("partitions", "4"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what narrows the queries or the results asked for; the rest stays with Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("qid",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.asked = [a for a in self.asked if a[0] in wanted]
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("rank",):
                self.top_k = max(0, min(self.top_k, f.value - isinstance(f, LessThan)))
                yield f  # rows that tell of failures have no rank
            else:
                yield f

    def partitions(self) -> list[Share]:
        n = max(1, min(self.n, len(self.asked)))
        return [Share(self.asked[k::n]) for k in range(n)]

    def read(self, partition: Share) -> Iterator[tuple]:
        module, _, name = self.client.partition(":")
        ask = getattr(importlib.import_module(module), name)
        for qid, query in partition.asked:
            try:
                found = ask(query, self.top_k)[: self.top_k]
            except (OSError, ValueError, KeyError) as e:
                yield (qid, None, None, None, None, None, str(e))
                continue
            for rank, hit in enumerate(found, 1):
                known = {k: hit[k] for k in hit if k not in ("text", "score", "source_uri")}
                yield (qid, rank, hit.get("text", ""), float(hit.get("score", 0.0)), hit.get("source_uri"), json.dumps(known, sort_keys=True), None)


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lodestone_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SearchSource)
