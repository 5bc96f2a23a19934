"""Small helpers for column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once although body uses it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def in_steps(df: DataFrame, out: str, *steps: Callable[[Callable[[str], Column]], dict[str, Column]]) -> DataFrame:
    """df with columns made step by step: a step gets a function from names to the columns of earlier steps, and returns new ones.

    A frame's columns are computed once each and in generated code, unlike those of let. The last step makes the one column `out`; the others go.
    """
    made: list[str] = []
    at = lambda name: F.col(f"`{out}.{name}`")
    for step in steps[:-1]:
        new = {f"{out}.{name}": c for name, c in step(at).items()}
        made += [n for n in new if n not in made]
        df = df.withColumns(new)
    (last,) = steps[-1](at).values()
    return df.withColumn(out, last).drop(*made)
