"""Extension points: named metrics that a group is evaluated by, and named text filters that run in order.

A metric is an aggregate column, a filter a column of text to a column of text, so whatever is
registered stays in the plan; a pandas aggregate can be registered like any other column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylake.functions import text as T

METRICS: dict[str, Callable[[], Column]] = {}
FILTERS: dict[str, Callable[[Column], Column]] = {}


def register_metric(name: str, metric: Callable[[], Column]) -> None:
    """Put a metric under its name, in place of an older one."""
    METRICS[name] = metric


def register_filter(name: str, change: Callable[[Column], Column]) -> None:
    FILTERS[name] = change


def resolve(selection: str | None, default: list[str], known: dict | None = None) -> list[str]:
    """Names of a comma-separated selection: the default for none, every one for ``all``; an unknown name is an error."""
    known = METRICS if known is None else known
    if selection is None:
        return list(default)
    if selection.strip().lower() == "all":
        return sorted(known)
    names = [s.strip() for s in selection.split(",") if s.strip()]
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown: {unknown}; there are {sorted(known)}")
    return names


def evaluate(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """(by, names): each group's metrics, in one grouping."""
    return rows.groupBy(*by).agg(*[METRICS[n]().alias(n) for n in names])


def apply_filters(rows: DataFrame, text: str, names: list[str]) -> DataFrame:
    """``rows`` with ``text`` filtered in order, and filter_tokens: (name, before, after) token estimates of each step."""
    out, told = F.col(text), []
    for name in names:
        new = FILTERS[name](out)
        told.append(F.struct(F.lit(name).alias("name"), T.token_estimate(out).alias("before"), T.token_estimate(new).alias("after")))
        out = new
    return rows.withColumns({text: out, "filter_tokens": F.array(*told)})


register_metric("n", lambda: F.count(F.lit(1)))
register_metric("mean", lambda: F.round(F.avg("value"), 6))
register_metric("share_high", lambda: F.round(F.avg((F.col("value") > 50).cast("int")), 6))
register_filter("spaces", T.squeeze_spaces)
register_filter("thinking", T.strip_thinking)
register_filter("caps", T.collapse_spaced_caps)
