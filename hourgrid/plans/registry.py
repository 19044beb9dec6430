"""Registered queries: a Spark callable, and the SQL that must give the same rows."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rounding is moved off the ties (x.xx5), which the two engines break differently when the last bit differs.
OFF_TIE = 0.0013

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """``rounded`` columns are rounded and ``text`` columns (dates) shown as text on both sides alike."""
    name: str
    run: Run
    sql: str | None = None
    rounded: str = ""
    text: str = ""
    digits: int = 6

    @property
    def nudge(self) -> float:
        return OFF_TIE * 10.0 ** -self.digits

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.run(spark, sf_dir)
        shown = {c: F.round(F.col(c) + self.nudge, self.digits) + F.lit(0.0) for c in self.rounded.split()}
        shown.update({c: F.col(c).cast("string") for c in self.text.split()})
        return out.withColumns(shown) if shown else out

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        shown = [f"round({c} + {self.nudge!r}, {self.digits}) + 0.0 AS {c}" for c in self.rounded.split()]
        shown += [f"CAST({c} AS VARCHAR) AS {c}" for c in self.text.split()]
        replaced = f" REPLACE ({', '.join(shown)})" if shown else ""
        return f"SELECT *{replaced} FROM ({self.sql}) AS answer"


def collect(*groups: list[Query]) -> dict[str, Query]:
    out: dict[str, Query] = {}
    for group in groups:
        for query in group:
            if query.name in out:
                raise ValueError(f"query {query.name} is registered twice")
            out[query.name] = query
    return out
