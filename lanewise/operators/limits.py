"""Per-scenario thresholds: literals by default, a column where the scenarios table overrides them."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.schema import Limits

NAMES = tuple(f.name for f in fields(Limits))


def overrides(scenarios: DataFrame | None) -> list[str]:
    return [] if scenarios is None else [n for n in NAMES if n in scenarios.columns]


def attach(df: DataFrame, scenarios: DataFrame | None, extra: tuple[str, ...] = (), limits: Limits | None = None):
    """Join `extra` scenario columns and any overriding thresholds; returns (df, {name: Column}).

    Nothing is joined when neither is asked for, which keeps the common case free of a shuffle.
    """
    limits = limits or Limits()
    over = overrides(scenarios)
    if scenarios is not None and (extra or over):
        df = df.join(scenarios.select("scenario_id", *extra, *over), "scenario_id")
    cols: dict[str, Column] = {}
    for n in NAMES:
        base = F.lit(getattr(limits, n))
        cols[n] = F.coalesce(F.col(n).cast("double"), base) if n in over else base
    return df, cols
