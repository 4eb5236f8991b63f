"""Registry of the queries over the reference operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkspan.plans.views import Tables, sql

FLAGSHIP = "document_structure_profile"
MODULES = ["scalar", "relational", "markup", "ordered", "rules", "repairs", "stores"]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_MODULES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function of ``Tables`` as a query; integers come out as long, as SQL counts do."""

    def register(build: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = build(Tables(spark, sf_dir))
            return found.withColumns({c: F.col(f"`{c}`").cast("long") for c, kind in found.dtypes if kind in ("int", "smallint", "tinyint")})

        _QUERIES[build.__name__] = run
        _MODULES[build.__name__] = build.__module__.rpartition(".")[2]
        if oracle:
            _ORACLES[build.__name__] = sql(oracle)
        return build

    return register


def _load() -> None:
    for module in MODULES:
        import_module(f"inkspan.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def query_module(name: str) -> str:
    """Module of this package that registers a query."""
    _load()
    return _MODULES[name]
