"""Operators as declarative plans, and the queries that apply them."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import surrogates
from weftline.plans.dialect import render
from weftline.sources.tables import table

FLAGSHIP = "w02_rank_actions"
MODULES = [*(f"operators.{m}" for m in ("scalars", "rollups", "joins", "linking", "matches", "packets", "fulltext", "sequences", "claimspecs", "windows", "detectors", "imperative")), "sources.files", "sources.mailbox", "streaming.incremental", "streaming.dormancy"]
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


@dataclass(frozen=True)
class Operator:
    """A plan over named inputs. Calling it with a DataFrame for each input builds the result; nothing runs."""

    name: str
    text: str
    inputs: tuple[str, ...]
    defaults: tuple[tuple[str, str], ...]

    def sql(self, spark: bool, **params: str) -> str:
        return render(_filled(self.text, dict(self.defaults) | params), spark)

    def __call__(self, spark: SparkSession, params: dict[str, str] | None = None, **frames: DataFrame) -> DataFrame:
        text = self.sql(True, **(params or {})).replace("{", "{{").replace("}", "}}")
        for name in self.inputs:
            text = re.sub(rf"\b(from|join) +{name}\b", r"\1 {%s}" % name, text)
        return spark.sql(text, **{n: frames[n] for n in self.inputs})


#: Rows of a dealt input that a task gets.
DEALT_ROWS = 500_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by its keys, in parts of some DEALT_ROWS rows: joins and groups by these keys hold as much in a task however large the table is."""
    n = -(-df.count() // DEALT_ROWS)
    return df.repartition(max(n, df.sparkSession.sparkContext.defaultParallelism), *keys) if n > 1 else df


def frames(spark: SparkSession, sf_dir: str, names, deal: dict[str, tuple[str, ...]] | None = None) -> dict[str, DataFrame]:
    """The views and tables by name; `deal` has the keys by which a view, or a table that views read, is dealt to tasks."""
    deal = deal or {}

    def given(name: str, df: DataFrame) -> DataFrame:
        return dealt(df, *deal[name]) if name in deal else df

    out = {}
    for n in names:
        if n in surrogates.VIEWS:
            text = render(surrogates.VIEWS[n], True)
            own = [t for t in surrogates.TABLES if re.search(rf"from {t}\b", text)]
            for t in own:
                text = re.sub(rf"from {t}\b", "from {%s}" % t, text)
            out[n] = given(n, spark.sql(text, **{t: given(t, table(spark, sf_dir, t)) for t in own}))
        else:
            out[n] = given(n, table(spark, sf_dir, n))
    return out


def oracle(text: str) -> str:
    """The statement for DuckDB, with the views it reads in front."""
    views = ", ".join(f"{v} as ({render(surrogates.VIEWS[v], False)})" for v in surrogates.used(text) if v in surrogates.VIEWS)
    body = render(text, False).strip()
    if not views:
        return body
    for start in ("with recursive ", "with "):
        if body.startswith(start):
            return f"{start}{views}, {body[len(start):]}"
    return f"with {views} {body}"


def _filled(text: str, params: dict[str, str]) -> str:
    for k, v in params.items():
        text = re.sub(rf":{k}\b", str(v), text)
    return text


TIMES = {"now": surrogates.NOW, "now_events": surrogates.NOW_EVENTS}


def operator(name: str, text: str, deal: dict[str, tuple[str, ...]] | None = None, **defaults: str) -> Operator:
    """Define an operator and register the query that applies it to the views it names; `deal` is for `frames`."""
    inputs = tuple(surrogates.used(text))
    op = Operator(name, text, inputs, tuple((TIMES | defaults).items()))
    _QUERIES[name] = lambda spark, sf_dir: op(spark, **frames(spark, sf_dir, inputs, deal))
    _SQL[name] = oracle(_filled(text, TIMES | defaults))
    return op


def query(name: str, sql: str | None = None):
    """Register a query that isn't a single plan, with its SQL over the views if there is one."""

    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = oracle(_filled(sql, TIMES))
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"weftline.{m}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
