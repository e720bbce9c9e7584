"""How queries are registered, and the small catalog tables that they share with their oracles."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir), with oracle SQL where SQL can express it."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Fixture:
    """A small table given as rows: a DataFrame for Spark, a common table expression for the oracle."""

    def __init__(self, name: str, schema: str, rows: list[tuple]):
        self.name, self.schema, self.rows = name, schema, rows
        self.columns = [c.strip().split(" ")[0] for c in self._split(schema)]
        self.kinds = [c.strip().split(" ", 1)[1] for c in self._split(schema)]

    @staticmethod
    def _split(schema: str) -> list[str]:
        out, depth, held = [], 0, ""
        for c in schema:
            depth += (c == "<") - (c == ">")
            if c == "," and not depth:
                out.append(held)
                held = ""
            else:
                held += c
        return [*out, held]

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        """The rows as a table; ``sf_dir`` tells fixtures that are spread over given rows where these are."""
        return spark.createDataFrame(self.typed(), self.schema)

    def typed(self) -> list[tuple]:
        """The rows with times as such."""
        stamps = [k for k, kind in enumerate(self.kinds) if kind == "timestamp"]
        return [tuple(datetime.fromisoformat(v) if k in stamps and v else v for k, v in enumerate(r)) for r in self.rows]

    def _literal(self, v, kind: str) -> str:
        duck = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]"}[kind]
        if v is None:
            return f"CAST(NULL AS {duck})"
        if kind == "array<string>":
            return f"CAST([{', '.join(self._literal(x, 'string') for x in v)}] AS VARCHAR[])"
        if kind in ("string", "timestamp"):
            return f"CAST('{str(v).replace(chr(39), chr(39) * 2)}' AS {duck})"
        return f"CAST({v} AS {duck})"

    def over(self, table: str, key: str, every: bool = False, **mix: str | tuple[str, str]) -> Fixture:
        """This table for each row of a given one, or its row number ``key`` modulo its size."""
        return Spread(self, table, key, every, mix)

    def cte(self) -> str:
        rows = ",\n".join("(" + ", ".join(self._literal(v, k) for v, k in zip(r, self.kinds, strict=True)) + ")" for r in self.rows)
        return f"{self.name}({', '.join(self.columns)}) AS (VALUES {rows})"


class Spread(Fixture):
    """A small table spread over a given one, so that it grows with it.

    ``mix`` says what a column becomes: SQL that both engines read, of the fixture's own value
    ``{v}`` and the given row's columns; a pair where they differ. Columns that aren't named stay as they are.
    """

    def __init__(self, base: Fixture, table: str, key: str, every: bool, mix: dict[str, str | tuple[str, str]]):
        self.base, self.table, self.key, self.every, self.mix = base, table, key, every, mix
        self.name, self.columns, self.kinds = base.name, base.columns, base.kinds
        assert mix.keys() <= set(base.columns), mix.keys()

    def _selected(self, engine: int) -> list[tuple[str, str]]:
        """SQL and name of each column, for Spark (0) or DuckDB (1)."""
        out = []
        for c in self.columns:
            sql = self.mix.get(c, "{v}")
            out.append(((sql if isinstance(sql, str) else sql[engine]).format(v=f"_{c}"), c))
        return out

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        own = spark.createDataFrame([(n, *r) for n, r in enumerate(self.base.typed())], f"_n long, {self.base.schema}")
        numbered = own.toDF("_n", *[f"_{c}" for c in self.columns])
        given = load(spark, sf_dir, self.table)
        few = F.broadcast(numbered)  # rows that are fixed here
        met = given.crossJoin(few) if self.every else given.join(few, F.expr(f"{self.key} % {len(self.base.rows)} = _n"))
        return met.select(*[F.expr(sql).alias(c) for sql, c in self._selected(0)])

    def cte(self) -> str:
        rows = ",\n".join("(" + ", ".join([str(n), *(self._literal(v, k) for v, k in zip(r, self.kinds, strict=True))]) + ")" for n, r in enumerate(self.base.rows))
        names = ", ".join(["_n", *(f"_{c}" for c in self.columns)])
        chosen = ", ".join(f"{sql} AS {c}" for sql, c in self._selected(1))
        on = "" if self.every else f" WHERE {self.key} % {len(self.base.rows)} = _n"
        return f"{self.name} AS (SELECT {chosen} FROM {self.table}, (VALUES {rows}) own({names}){on})"


def tagged(key: str) -> str:
    """SQL of a name that is told apart by the given row's key."""
    return f"{{v}} || '~' || CAST({key} AS STRING)"


def all_tagged(key: str) -> tuple[str, str]:
    """The same for each name of a list, in Spark's SQL and DuckDB's."""
    return f"transform({{v}}, x -> x || '~' || CAST({key} AS STRING))", f"list_transform({{v}}, lambda x: x || '~' || CAST({key} AS STRING))"


SOURCES = Fixture(
    "sources",
    "slug string, name string, family string, status string, visibility string, access_visibility string, allowed_groups array<string>, description string, tags array<string>, owner_team string, active_index string, health string, w_allowed boolean, w_scope string, w_modes array<string>, w_groups array<string>",
    [
        ("guidelines", "Clinical guidelines", "clinical_document", "published", "public", None, [], "Care of adults", ["care", "PTSD"], "med", "i1", "ok", True, None, ["append"], []),
        ("bulletins", "Service bulletins", "document", "curated", "restricted", None, ["mechanics"], "Engines and Airframes", ["aircraft"], "ops", "i2", "degraded", True, "bulletins.write", ["append", "upsert"], ["mechanics"]),
        ("articles", "Open articles", "document", "draft", "public", None, [], None, [], "lib", "i3", "ok", False, None, [], []),
        ("engine-code", "Engine code", "code", "published", "public", "restricted", ["devs"], "Sources of the engine", ["code"], "dev", None, None, True, "", ["upsert"], ["devs", "ops"]),
        ("old-notes", "Old notes", "document", "retired", "restricted", "bogus", [], "notes", ["Care"], "med", "i4", "failed", None, None, None, None),
        ("wiki", "Wiki", "document", "curated", "public", "public", None, "A wiki", [], "lib", "i9", "ok", True, None, ["annotate"], None),
    ],
)
INDEXES = Fixture(
    "indexes",
    "id string, slug string, location string, document_count int, recipe_id string, health string, built timestamp",
    [
        ("i1", "guidelines", "idx_guidelines_v1", 52, "r2", "ok", "2024-03-01 00:00:00"),
        ("i2", "bulletins", "idx_bulletins_v1", 263, "r3", "degraded", "2024-02-01 00:00:00"),
        ("i3", "articles", "idx_articles_v1", 10, "r4", "ok", "2024-01-05 00:00:00"),
        ("i4", "old-notes", "idx_old_notes_v1", 7, "r9", "failed", "2023-01-01 00:00:00"),
        ("i5", "guidelines", "idx_guidelines_v1", 50, "r1", "ok", "2024-01-01 00:00:00"),
        ("i6", "bulletins", "idx_bulletins_v1", 260, "r3", "ok", "2024-02-01 00:00:00"),
    ],
)
RECIPES = Fixture(
    "recipes",
    "id string, slug string, version int, model string, url string, content string",
    [
        ("r1", "guidelines", 1, "small", "http://a", '{"size":512}'),
        ("r2", "guidelines", 2, "large", "http://b", '{"size":1024}'),
        ("r3", "bulletins", 1, "small", None, '{"size":256}'),
        ("r4", "articles", 1, None, None, "{}"),
        ("r5", "wiki", 1, "other", "http://c", '{"size":64}'),
    ],
)
INCOMING = Fixture("incoming", "slug string, content string", [("guidelines", '{"size":512}'), ("guidelines", '{"size":2048}'), ("engine-code", "{}"), ("bulletins", '{"size":256}')])
ENDPOINTS = Fixture("endpoints", "model_name string, url string, status string", [("small", "http://s", "healthy"), ("large", "http://l", "unhealthy"), ("spare", "http://x", "unknown")])
NEW_ENDPOINTS = Fixture("new_endpoints", "model_name string, url string, status string", [("small", "http://s2", "unknown"), ("tiny", "http://t", "unknown")])
PROMPTS = Fixture("prompts", "slug string, pos int, text string", [("guidelines", 1, "What helps?"), ("guidelines", 0, "Who is at risk?"), ("bulletins", 0, "Which bolts?"), ("wiki", 0, "Why?")])
RUNS = Fixture(
    "runs",
    "run_id long, slug string, started timestamp, completed timestamp, status string, recall_at_5 double",
    [
        (1, "guidelines", "2024-01-01 00:00:00", "2024-01-01 00:01:30", "completed", 0.5),
        (2, "guidelines", "2024-01-03 00:00:00", "2024-01-03 00:00:10", "completed", 0.75),
        (3, "guidelines", None, None, "queued", None),
        (4, "bulletins", "2024-01-02 00:00:00", None, "running", 0.75),
        (5, "guidelines", "2024-01-02 00:00:00", "2024-01-02 00:00:00.5", "failed", 0.75),
    ],
)
IDENTITIES = Fixture(
    "identities",
    "sub string, kind string, groups array<string>, scopes array<string>",
    [
        ("ann", "user", ["admin"], ["sources.write"]),
        ("bob", "user", ["mechanics", "lib"], ["bulletins.write", "sources.write"]),
        ("bot", "agent", ["devs"], ["sources.write"]),
        ("job", "service", [], []),
        ("app", "client", ["ops", "admin"], ["sources.write", "bulletins.write"]),
    ],
)
ENTITIES = Fixture(
    "entities",
    "name string, pos int, aliases array<string>, doc_titles array<string>",
    [
        ("PTSD", 0, ["stress"], ["doc-0", "doc-1", "doc-7"]),
        ("SUD", 1, ["of and"], ["doc-2", "doc-1"]),
        ("MDD", 2, [], ["doc-3", "doc-4"]),
        ("PHQ-9", 3, ["the"], ["doc-5"]),
        ("ptsd", 4, ["later"], ["doc-6"]),
    ],
)
EDGES = Fixture(
    "edges", "source_entity string, target_entity string, directionality string, pos int", [("PTSD", "SUD", "bidirectional", 0), ("PTSD", "MDD", "bidirectional", 1), ("PHQ-9", "MDD", "directed", 2), ("SUD", "unknown", "directed", 3)]
)


_OF = tagged("s_suppkey")


def _catalog(base: Fixture, *keys: str, **mix: str) -> Fixture:
    """A table of the catalog of each supplier; ``keys`` are names within it."""
    return base.over("supplier", "s_suppkey", every=True, **{k: _OF for k in keys}, **mix)


SOURCES = _catalog(SOURCES, "slug", "active_index", name="{v} || ' of ' || s_name", health="CASE WHEN s_acctbal < 0 AND {v} = 'ok' THEN 'failed' ELSE {v} END", description="{v}")
INDEXES = _catalog(INDEXES, "id", "slug", "location", "recipe_id", document_count="{v} + CAST(s_suppkey AS INT)", health="CASE WHEN s_acctbal > 9000 AND {v} = 'ok' THEN 'degraded' ELSE {v} END")
RECIPES = _catalog(RECIPES, "id", "slug", "model", url="{v} || '/' || CAST(s_suppkey AS STRING)")
INCOMING = _catalog(INCOMING, "slug")
ENDPOINTS = _catalog(ENDPOINTS, "model_name", url="{v} || '/' || CAST(s_suppkey AS STRING)", status="CASE WHEN s_acctbal < 0 AND {v} = 'healthy' THEN 'unhealthy' ELSE {v} END")
NEW_ENDPOINTS = _catalog(NEW_ENDPOINTS, "model_name", url="{v} || '/' || CAST(s_suppkey AS STRING)")
PROMPTS = _catalog(PROMPTS, "slug", text="{v} || ' Asks ' || s_name")
RUNS = _catalog(RUNS, "slug", run_id="{v} + 10 * CAST(s_suppkey AS BIGINT)")
IDENTITIES = _catalog(IDENTITIES, "sub")
#: The same graphs of entities, one for each customer; those above stand beside the documents.
MANY_ENTITIES = ENTITIES.over("customer", "c_custkey", every=True, name=tagged("c_custkey"), aliases=all_tagged("c_custkey"), doc_titles=all_tagged("c_custkey"))
MANY_EDGES = EDGES.over("customer", "c_custkey", every=True, source_entity=tagged("c_custkey"), target_entity=tagged("c_custkey"))


def with_fixtures(sql: str, *fixtures: Fixture, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(f.cte() for f in fixtures) + "\n" + sql
