"""Registration of queries, and small inline tables that Spark and SQL share."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function (spark, sf_dir) under its name, with SQL for the same rows if SQL can express it."""

    def register(f: Query) -> Query:
        if f.__name__ in QUERIES:
            raise ValueError(f"query {f.__name__} exists")
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The file that a document is a page of: 10,000 documents of a source at most, so that what is ordered or joined within a
#: file is bounded, whatever a source has.
FILE = "source || '/' || (doc_id // 10000)"


def file_of() -> Column:
    return F.concat("source", F.lit("/"), F.expr("doc_id DIV 10000").cast("string"))


def _type(t: str) -> str:
    return f"{_type(t[6:-1])}[]" if t.startswith("array<") else _TYPES[t]


def _literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, int | float):
        return repr(v)
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(_literal, v)) + "]"
    if isinstance(v, datetime.datetime):
        return f"TIMESTAMP '{v}'"
    return "'" + str(v).replace("'", "''") + "'"


@dataclass(frozen=True)
class Inline:
    """A named table of literal rows: a DataFrame, and a common table expression of the same rows."""

    name: str
    schema: str
    rows: Sequence[tuple]

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.split()) for c in self.schema.split(", ")]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def cte(self) -> str:
        names = ", ".join(f'"{c}"' for c, _ in self.columns)
        casts = ", ".join(f'CAST("{c}" AS {_type(t)}) AS "{c}"' for c, t in self.columns)
        rows = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {rows}) AS t({names}))"


@dataclass(frozen=True)
class Derived:
    """A named table made of a given one by expressions that Spark and SQL read alike; `times` makes rows i = 0, 1, ... of each,
    `by_line` a row for each line t (number k) of a document's text. A list is an expression of its members with ~ between."""

    name: str
    source: str
    schema: str
    exprs: Sequence[str]
    where: str = "true"
    times: int = 0
    by_line: bool = False

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(c.split()) for c in self.schema.split(", ")]

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, self.source)
        if self.times:
            rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(self.times - 1))))
        if self.by_line:
            rows = rows.select("*", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("k", "t"))
        listed = lambda e, t: f"split({e}, '~')" if t.startswith("array") else e
        return rows.filter(self.where).selectExpr(*[f"CAST({listed(e, t)} AS {t}) AS {c}" for e, (c, t) in zip(self.exprs, self.columns, strict=True)])

    @property
    def cte(self) -> str:
        listed = lambda e, t: f"string_split({e}, '~')" if t.startswith("array") else e
        made = ", ".join(f'CAST({listed(e, t)} AS {_type(t)}) AS "{c}"' for e, (c, t) in zip(self.exprs, self.columns, strict=True))
        parts = "string_split(coalesce(text, ''), chr(10))"
        source = f"(SELECT *, unnest({parts}) AS t, generate_subscripts({parts}, 1) - 1 AS k FROM {self.source})" if self.by_line else self.source
        return f"{self.name} AS (SELECT {made} FROM {source}{f', range({self.times}) r(i)' if self.times else ''} WHERE {self.where})"
