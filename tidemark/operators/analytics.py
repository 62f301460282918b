"""Analytics of an estate's graph: nodes (fqn, kind), edges (src, dst, kind, unresolved), views and procedures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import closure, cycle_members, degrees, numbered, orphans, reversed_edges

#: Yearly cost of an orphan by kind, weight of a complexity, and layers of a drawing by kind.
ORPHAN_COST = {"TABLE": 900, "VIEW": 300, "PROCEDURE": 500}
WEIGHT = {"high": 3, "medium": 2, "low": 1}
LAYER = {"TABLE": 1.0, "VIEW": 1.0, "PROCEDURE": 1.0, "ETL_JOB": 2.0, "ROUTINE": 2.5, "SCHEDULE": 3.0, "DASHBOARD": 4.0}


def _mapped(values: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def dashboard_tables(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dashboard, upstream_table): the tables that a dashboard shows, directly or by way of views alone."""
    shown = edges.filter("kind in ('DASHBOARD_RENDERS', 'VIEW_DEPENDS')")
    roots = nodes.filter("kind = 'DASHBOARD'").select(F.col("fqn").alias("root"))
    up = closure(reversed_edges(shown), roots)
    return up.join(nodes.filter("kind = 'TABLE'").select(F.col("fqn").alias("node")), "node").select(F.col("root").alias("dashboard"), F.col("node").alias("upstream_table"))


def view_depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(view, depth): 1 where no source is a view, 3 where a source view has a view for a source itself, else 2."""
    views = nodes.filter("kind = 'VIEW'").select(F.col("fqn").alias("view"))
    layered = edges.filter("kind = 'VIEW_DEPENDS'").join(views.select(F.col("view").alias("src")), "src", "left_semi").join(views.select(F.col("view").alias("dst")), "dst", "left_semi").select("src", "dst").distinct()
    deep = layered.join(layered.select(F.col("dst").alias("src")).distinct().withColumn("deeper", F.lit(1)), "src", "left")
    least = deep.groupBy(F.col("dst").alias("view")).agg(F.when(F.max("deeper") == 1, 3).otherwise(2).alias("depth"))
    return views.join(least, "view", "left").select("view", F.coalesce("depth", F.lit(1)).cast("int").alias("depth"))


def complexity_ranking(procedures: DataFrame) -> DataFrame:
    """(fqn, complexity, score): ten times the weight of the complexity and one for each table read or written."""
    n = F.size("reads") + F.size("writes")
    weight = _mapped(WEIGHT, F.col("complexity"), 0)
    return procedures.orderBy(F.desc(weight), F.desc(n), "fqn").select("fqn", "complexity", (weight * 10 + n).cast("int").alias("score"))


def quadrant(nodes: DataFrame, edges: DataFrame, views: DataFrame, tables_of: DataFrame) -> DataFrame:
    """(fqn, value, risk, fan_in, dashboards) of tables and views that anything feeds.

    Value is the edges in and twice the dashboards that show it; risk is 2 for an unresolved view, 1 for one that joins
    or aggregates, else 0. views: (fqn, complexity, unresolved); tables_of: dashboard_tables().
    """
    fan = degrees(edges).filter("fan_in > 0").select(F.col("node").alias("fqn"), "fan_in")
    shown = tables_of.groupBy(F.col("upstream_table").alias("fqn")).agg(F.countDistinct("dashboard").alias("dashboards"))
    risk = F.when(F.col("unresolved"), 2).when(F.col("complexity").isin("join", "aggregate"), 1).otherwise(0)
    rows = nodes.filter("kind in ('TABLE', 'VIEW')").join(fan, "fqn").join(shown, "fqn", "left").join(views.select("fqn", "complexity", "unresolved"), "fqn", "left")
    dashboards = F.coalesce("dashboards", F.lit(0)).cast("long")
    return rows.select("fqn", (F.col("fan_in") + 2 * dashboards).alias("value"), risk.alias("risk"), "fan_in", dashboards.alias("dashboards"))


def health(nodes: DataFrame, edges: DataFrame, procedures: DataFrame) -> DataFrame:
    """One row: counts, coverage_pct, health (0 to 100) and its label, readiness, and the orphans' yearly cost.

    Health is 100 less 8 for each unresolved edge, 15 for each cycle, half the share of orphans among all nodes and 0.7 of
    that of highly complex procedures among procedures. Readiness is the resolved share times coverage times the share
    outside cycles, in percent. Orphans are tables, views and procedures at no end of any edge.
    """
    linked = nodes.select("fqn").distinct().join(edges.select(F.col("src").alias("fqn")).union(edges.select("dst")).distinct(), "fqn", "left_semi").agg(F.count("*").alias("linked"))
    alone = orphans(nodes.filter(F.col("kind").isin(*ORPHAN_COST)).select(F.col("fqn").alias("node"), "kind"), edges)
    one = nodes.agg(F.count("*").alias("total"))
    one = one.crossJoin(alone.agg(F.count("*").alias("orphans"), F.coalesce(F.sum(_mapped(ORPHAN_COST, F.col("kind"), 0)), F.lit(0)).alias("orphan_cost")))
    one = one.crossJoin(edges.agg(F.count_if("unresolved").alias("unresolved"))).crossJoin(linked)
    one = one.crossJoin(cycle_members(edges).agg(F.countDistinct("component").alias("circular")))
    one = one.crossJoin(procedures.agg(F.count("*").alias("procs"), F.count_if(F.col("complexity") == "high").alias("high")))
    share = lambda a, b: F.coalesce(F.col(a) * 1.0 / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    coverage = F.round(share("linked", "total") * 100, 1)
    score = 100 - (F.col("unresolved") * 8 + F.col("circular") * 15 + share("orphans", "total") * 100 * 0.5 + share("high", "procs") * 100 * 0.7)
    one = one.withColumns({"coverage_pct": coverage, "health": F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(score))).cast("int")})
    ready = (1 - share("unresolved", "total")) * (F.col("coverage_pct") / 100) * (1 - share("circular", "total")) * 100
    label = F.when(F.col("health") >= 80, "Healthy").when(F.col("health") >= 60, "Moderate Risk").otherwise("At Risk")
    return one.select("total", "orphans", "unresolved", "circular", "coverage_pct", "health", label.alias("label"), F.round(ready, 1).alias("readiness"), F.col("orphan_cost").cast("long").alias("orphan_cost"))


def criticality(dashboards: DataFrame, known: DataFrame) -> DataFrame:
    """(dashboard, criticality, last_run): as `known` (dashboard, criticality) says, else `ops`; ops runs weekly."""
    level = F.coalesce("criticality", F.lit("ops"))
    return dashboards.select("dashboard").distinct().join(known, "dashboard", "left").select("dashboard", level.alias("criticality"), F.when(level == "ops", "weekly").otherwise("daily 06:00").alias("last_run"))


def layout(nodes: DataFrame, sources: list[str] | None = None, across: int = 6, dx: int = 220, dy: int = 85) -> DataFrame:
    """(fqn, kind, x, y): places in a grid, by layer, then by name; tables of `sources` (schemas) come before others."""
    of_source = (F.col("kind") == "TABLE") & F.substring_index("fqn", ".", 1).isin(sources or [])
    layered = nodes.withColumn("layer", F.when(of_source, 0.0).otherwise(_mapped(LAYER, F.col("kind"), 1.0)))
    at = F.col("at")
    return numbered(layered, ["layer", "fqn"], "at").select("fqn", "kind", (at % across * dx).alias("x"), (F.floor(at / across) * dy).alias("y"))


def drawn_edges(edges: DataFrame, unverified: float = 0.3) -> DataFrame:
    """The edges that a drawing shows: none to dynamic statements, none that is declared and not found in its artifact."""
    return edges.filter((F.col("kind") != "UNRESOLVED") & (F.col("confidence") != unverified))


def knowledge_counts(counts: dict[str, DataFrame]) -> DataFrame:
    """(name, items): rows of each table."""
    out = None
    for name, df in counts.items():
        one = df.agg(F.count("*").alias("items")).select(F.lit(name).alias("name"), "items")
        out = one if out is None else out.unionByName(one)
    return out
