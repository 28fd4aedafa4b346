"""Registration of queries with their SQL over stand-in tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxara.plans.tables import duck, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, **base: str):
    """Registers ``f(**tables)`` under its name; the tables are stand-ins by name, {t} in the SQL likewise."""

    def wrap(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(**{k: table(spark, sf_dir, t) for k, t in base.items()})
        if sql is not None:
            text = sql
            for k, t in base.items():
                text = text.replace("{" + k + "}", duck(t))
            SQL[f.__name__] = text
        return f

    return wrap


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) + F.lit(0.0) for c in columns})


def p_t(t: str, df: str) -> str:
    """SQL for the two-sided p of Student's t with an integer number of degrees: the finite series."""
    angle = f"atan(abs({t}) / sqrt(({df})::DOUBLE))"
    even = f"sin({angle}) * list_sum(list_transform(range(0, ({df}) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + 2 * k * ln(cos({angle})))))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * coalesce(list_sum(list_transform(range(0, (({df}) - 1) // 2), lambda k: exp(0.5 * ln(pi()) + lgamma(k + 1) - lgamma(k + 1.5) - ln(2) + (2 * k + 1) * ln(cos({angle}))))), 0))"
    return f"(1 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


def p_z(z: str) -> str:
    """SQL for the two-sided p of a moderate normal score: the power series of erf."""
    x = f"(abs({z}) / sqrt(2))"
    return f"(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 120), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp((2 * k + 1) * ln(greatest({x}, 1e-12)) - lgamma(k + 1)) / (2 * k + 1))))"
