"""Cohort filters and model formulas as plans: small strings become Columns on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens that mean a missing value.
MISSING = (".", "", " ", "NA", "na", "N/A", "n/a", "#N/A", "NULL", "NaN", "NAN", "Nan", "nan")


#: The signs of comparisons; two characters stand before the one they begin with.
_SIGNS = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}


def cohort_filter(df: DataFrame, expression: str) -> Column:
    """``c=v1,v2`` (one of; also ``==``), ``c!v1,v2`` (none of; also ``!=``), and comparisons.

    Comparisons are ``c<u``, ``c>l``, ``c<=u``, ``c>=l``, or a chain about the
    column such as ``l<c<=u`` and ``u>c>l``.
    """
    kinds = dict(df.dtypes)
    value = lambda column, text: F.lit(text.strip()).cast(kinds[column])
    parts = [p.strip() for p in re.split("(<=|>=|<|>|!=|==|=|!)", expression)]
    names = [p for p in parts[::2] if p in kinds]
    if len(parts) not in (3, 5) or not names:
        raise ValueError(f"not a filter on a column of the table: {expression}")
    if parts[1] in ("=", "==", "!", "!=") and len(parts) == 3:
        inside = F.col(f"`{parts[0]}`").isin([value(parts[0], v) for v in parts[2].split(",")])
        return ~inside if parts[1][0] == "!" else inside
    name = parts[2] if len(parts) == 5 else parts[0] if parts[0] in kinds else parts[2]
    side = lambda text: F.col(f"`{name}`") if text == name else value(name, text)
    kept = F.lit(True)
    for left, sign, right in zip(parts[:-2:2], parts[1::2], parts[2::2], strict=True):
        kept = kept & _SIGNS[sign](side(left), side(right))
    return kept


def missing_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.when(~F.trim(c).isin([m.strip() for m in MISSING]), F.col(c)) for c in columns})


def terms(formula: str) -> list[str]:
    """Terms of an additive formula, ``a * b`` standing for a, b and a:b."""
    out: list[str] = []
    for part in (p.strip() for p in formula.split("+")):
        names = [n.strip() for n in part.split("*")]
        for t in [*names, ":".join(names)] if len(names) > 1 else names:
            if t and t not in out:
                out.append(t)
    return out


def design(cohort: DataFrame, formula: str, reference: dict[str, str] | None = None, centre: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """The cohort with numeric design columns, rows with a missing value left out, and the columns' names.

    A string column becomes one indicator per sorted level but the reference
    (the first by default), named ``c[T.level]``. Columns to ``centre`` lose
    their mean over the rows that stay, before products are made.
    """
    kinds = dict(cohort.dtypes)
    needed = sorted({n for t in terms(formula) for n in t.split(":")})
    held = cohort.dropna(subset=needed)
    columns: dict[str, list[tuple[str, Column]]] = {}
    for n in needed:
        if kinds[n] == "string":
            levels = sorted(r[0] for r in held.select(n).distinct().collect())  # levels of a factor, few
            base = (reference or {}).get(n, levels[0] if levels else "")
            columns[n] = [(f"{n}[T.{v}]", (F.col(n) == v).cast("double")) for v in levels if v != base]
        else:
            mean = held.agg(F.avg(n)).first()[0] if n in centre else None
            columns[n] = [(n, F.col(n).cast("double") - (mean or 0.0))]
    made: dict[str, Column] = {}
    for t in terms(formula):
        product: list[tuple[str, Column]] = [("", F.lit(1.0))]
        for n in t.split(":"):
            product = [(f"{a}:{b}".lstrip(":"), x * y) for a, x in product for b, y in columns[n]]
        made |= dict(product)
    return held.withColumns(made), list(made)
