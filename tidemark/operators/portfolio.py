"""Effort of a portfolio's jobs from given inputs, and facts that others add."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days below which a job is of a tier.
LOW, MEDIUM = 15, 40


def effort(role_days: DataFrame, uplifts: DataFrame, risks: DataFrame) -> DataFrame:
    """(job, base_days, uplift_pct, risk_days, adjusted_days, tier).

    role_days: job, dimension, role, days; uplifts: job, uplift_pct; risks: job, impact_days. Adjusted are the base days
    raised by all uplifts together, and the risks' days.
    """
    total = lambda df, c, out: df.groupBy("job").agg(F.sum(F.col(c).cast("decimal(18,4)")).cast("double").alias(out))
    rows = total(role_days, "days", "base").join(total(uplifts, "uplift_pct", "up"), "job", "left").join(total(risks, "impact_days", "risk"), "job", "left").na.fill(0.0, ["up", "risk"])
    base = F.round("base", 2)
    rows = rows.withColumn("adjusted", F.round(base * (1 + F.col("up") / 100) + F.col("risk"), 2))
    tier = F.when(F.col("adjusted") < LOW, "low").when(F.col("adjusted") < MEDIUM, "medium").otherwise("high")
    return rows.select("job", base.alias("base_days"), F.col("up").alias("uplift_pct"), F.col("risk").alias("risk_days"), F.col("adjusted").alias("adjusted_days"), tier.alias("tier"))


Facts = Callable[[DataFrame], DataFrame]
_PARSERS: dict[str, Facts] = {}


def register_parser(name: str, parse: Facts) -> None:
    """Adds a reader of unknown assets: texts (path, text) to facts (type, fqn, snippet, confidence, source_ref)."""
    if name in _PARSERS:
        raise ValueError(f"there is a parser {name}")
    _PARSERS[name] = parse


def unknown_facts(texts: DataFrame) -> DataFrame | None:
    """The facts of all registered readers, in the order of their names; an error in one of them is raised."""
    found = None
    for name in sorted(_PARSERS):
        facts = _PARSERS[name](texts).withColumn("parser", F.lit(name))
        found = facts if found is None else found.unionByName(facts)
    return found
