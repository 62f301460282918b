"""What a migration has left open: the worklist, likely targets, proposals, overrides, and the first scope to move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import cut
from .names import nearest, ranged

#: Near names: least ratio, and how many count.
CUTOFF, NEAR = 0.75, 3
#: A scope has so many objects at most by value, and is filled up to so many.
SCOPE, LEAST = 18, 10


def leaf(fqn: Column) -> Column:
    return F.upper(F.substring_index(fqn, ".", -1))


def worklist(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """(fqn, kind, reason, referenced_by): dangling refs (fqn, reason, referenced_by) and unresolved objects (fqn, kind,
    unresolved), once for each name and kind; the smallest reason, then referrer, stays."""
    missing = refs.select("fqn", F.lit("missing_object").alias("kind"), "reason", "referenced_by")
    dynamic = objects.filter("unresolved").select("fqn", F.concat(F.lit("unresolved_"), "kind").alias("kind"), F.lit("dynamic statements hide references").alias("reason"), F.concat("kind", F.lit(" definition")).alias("referenced_by"))
    least = missing.unionByName(dynamic).groupBy("fqn", "kind").agg(F.min(F.struct("reason", "referenced_by")).alias("x"))
    return least.select("fqn", "kind", "x.reason", "x.referenced_by")


def exact_candidates(items: DataFrame, known: DataFrame) -> DataFrame:
    """(fqn, candidate): known objects (column fqn) with the same leaf name and another full name."""
    k = known.select(F.col("fqn").alias("candidate"), leaf(F.col("fqn")).alias("leaf")).distinct()
    i = items.select("fqn", leaf(F.col("fqn")).alias("leaf")).distinct()
    return i.join(k, "leaf").filter(F.upper("candidate") != F.upper("fqn")).select("fqn", "candidate")


#: Ratios at which near names are looked for, the highest first: who has NEAR names there needs no lower one.
STEPS = (0.94, 0.85, CUTOFF)


def near_candidates(items: DataFrame, known: DataFrame) -> DataFrame:
    """(fqn, candidate, ratio): of known objects with other names the NEAR leaf names that are most alike.

    A leaf name stands for its smallest full name; ties go to the larger leaf name. Names are first looked for at a high
    ratio, where few are compared, and at a lower one only for those that have less than NEAR.
    """
    i = items.select("fqn", leaf(F.col("fqn")).alias("a")).filter("a <> ''").distinct()
    k = known.filter("fqn is not null").groupBy(leaf(F.col("fqn")).alias("b"), F.upper("fqn").alias("upper")).agg(F.min("fqn").alias("candidate")).filter("b <> ''")
    # One of a leaf name's objects may be the item itself, so the two smallest will do, and one leaf name over NEAR.
    k = cut(k.withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy("candidate"))).filter("n <= 2").drop("n"))
    right, out = ranged(k.select("b").distinct()), None
    for least in STEPS:
        pairs = nearest(i.select("a").distinct(), right, least, NEAR + 1)
        found = cut(i.join(pairs, "a").join(k, "b").filter(F.col("upper") != F.upper("fqn")).groupBy("fqn", "b", "ratio").agg(F.min("candidate").alias("candidate")))
        done = found.groupBy("fqn").agg(F.count("*").alias("n")).filter(F.col("n") >= NEAR).select("fqn")
        rows = found if least == STEPS[-1] else found.join(done, "fqn", "left_semi")
        out = rows if out is None else out.unionByName(rows)
        i = i.join(done, "fqn", "left_anti")
    rank = F.row_number().over(Window.partitionBy("fqn").orderBy(F.desc("ratio"), F.desc("b")))
    return out.withColumn("rank", rank).filter(F.col("rank") <= NEAR).select("fqn", "candidate", "ratio")


def candidates(items: DataFrame, known: DataFrame) -> DataFrame:
    """(fqn, candidate, rank): at most three likely targets; equal leaf names by name, then near ones by likeness."""
    exact = exact_candidates(items, known).withColumn("ratio", F.lit(2.0))
    best = exact.unionByName(near_candidates(items, known)).groupBy("fqn", "candidate").agg(F.max("ratio").alias("ratio"))
    rank = F.row_number().over(Window.partitionBy("fqn").orderBy(F.desc("ratio"), "candidate"))
    return best.withColumn("rank", rank).filter("rank <= 3").select("fqn", "candidate", "rank")


def proposals(items: DataFrame, targets: DataFrame, external: tuple[str, ...]) -> DataFrame:
    """(fqn, kind, action, target, confidence) of a worklist; targets (fqn, candidate, rank); external: source schemas."""
    first = targets.filter("rank = 1").select("fqn", F.col("candidate").alias("target"))
    schema, name, has = F.when(F.instr("fqn", ".") > 0, F.upper(F.substring_index("fqn", ".", 1))).otherwise(""), leaf(F.col("fqn")), F.col("target").isNotNull()
    rules = [
        (F.col("kind").startswith("unresolved_"), "capture_runtime_sql", 0.7),
        (schema.isin(*external), "confirm_external", 0.6),
        ((schema == "DW_AUDIT") | name.contains("AUDIT"), "confirm_external", 0.65),
        (schema == "BI", "correct_reference", 0.55),
        (has, "map_alias", 0.7),
        (F.lit(True), "define_ddl", 0.6),
    ]
    action = F.coalesce(*[F.when(test, F.struct(F.lit(a).alias("action"), F.lit(c).alias("confidence"))) for test, a, c in rules])
    done = items.join(first, "fqn", "left").withColumn("x", action)
    return done.select("fqn", "kind", "x.action", F.when(F.col("x.action").isin("correct_reference", "map_alias"), F.col("target")).alias("target"), "x.confidence")


def apply_aliases(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges (src, dst, kind, confidence) with names replaced (alias, target, seq: the last one counts), one for each
    pair and kind, of the highest confidence. An alias is followed once; an edge that comes to lead to itself goes."""
    last = aliases.groupBy("alias").agg(F.max_by("target", "seq").alias("target"))
    at = lambda end: last.select(F.col("alias").alias(end), F.col("target").alias(f"{end}_to"))
    moved = edges.join(at("src"), "src", "left").join(at("dst"), "dst", "left")
    ends = moved.select(F.coalesce("src_to", "src").alias("src"), F.coalesce("dst_to", "dst").alias("dst"), "kind", "confidence", (F.col("src") == F.col("dst")).alias("was_loop"))
    return ends.filter("was_loop or src <> dst").groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"))


#: The kind of edge from a source that a human named to an object, by the object's kind.
RUNTIME_EDGE = {"PROCEDURE": "SP_READS", "ROUTINE": "ETL_READS"}


def apply_overrides(nodes: DataFrame, edges: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and stale overrides after human decisions (subject, kind, target, sources, seq).

    kind `alias`: references to the subject are to the target. `stub`: the subject becomes a TABLE, if it is no node.
    `runtime_sources`: edges from those of the sources that are nodes, at confidence 1.0. All of them resolve the edges
    of their subject. Of several overrides of a subject and kind that of the largest seq counts. Stale ones, with a
    reason, have a subject that nothing refers to (alias, stub) or that is no node (runtime_sources), or an alias's
    target that is no node.
    """
    last = overrides.groupBy("subject", "kind").agg(F.max_by(F.struct("target", "sources"), "seq").alias("o")).select("subject", "kind", "o.*")
    known, ends = nodes.select("fqn"), edges.select(F.col("src").alias("fqn")).union(edges.select("dst")).distinct()
    flag = lambda df, col, name: df.select(F.col("fqn").alias(col)).distinct().withColumn(name, F.lit(True))
    marked = last.join(flag(known, "subject", "is_node"), "subject", "left").join(flag(ends, "subject", "is_end"), "subject", "left").join(flag(known, "target", "has_target"), "target", "left")
    lost = F.when((F.col("kind") == "runtime_sources") & F.col("is_node").isNull(), "subject is no object").when((F.col("kind") != "runtime_sources") & F.col("is_end").isNull(), "nothing refers to the subject").when((F.col("kind") == "alias") & F.col("has_target").isNull(), "target is no object")
    marked = marked.withColumn("reason", lost)
    good, stale = marked.filter("reason is null"), marked.filter("reason is not null").select("subject", "kind", "reason")
    stubs = good.filter("kind = 'stub' and is_node is null").select(F.col("subject").alias("fqn"), F.lit("TABLE").alias("kind"))
    alias = good.filter("kind = 'alias'").select(F.col("subject").alias("name"), F.col("target").alias("to"))
    done = good.select(F.col("subject").alias("name")).union(alias.select("to")).distinct().withColumn("fixed", F.lit(True))
    for end in ("src", "dst"):
        edges = edges.join(alias, edges[end] == alias["name"], "left").withColumn(end, F.coalesce("to", end)).drop("name", "to")
    flagged = edges.join(done, edges["src"] == done["name"], "left").withColumn("f", F.col("fixed")).drop("name", "fixed").join(done, edges["dst"] == done["name"], "left")
    kept = flagged.select("src", "dst", "kind", "confidence", (F.col("unresolved") & F.col("f").isNull() & F.col("fixed").isNull()).alias("unresolved"))
    named = good.filter("kind = 'runtime_sources'").select(F.col("subject").alias("fqn"), F.explode("sources").alias("src")).join(nodes, "fqn").withColumn("k", F.lit("VIEW_DEPENDS"))
    for kind, edge in RUNTIME_EDGE.items():
        named = named.withColumn("k", F.when(F.col("kind") == kind, edge).otherwise(F.col("k")))
    added = named.join(known.select(F.col("fqn").alias("src")), "src", "left_semi").select("src", F.col("fqn").alias("dst"), F.col("k").alias("kind"), F.lit(1.0).alias("confidence"), F.lit(False).alias("unresolved"))
    best = kept.unionByName(added).groupBy("src", "dst", "kind").agg(F.max("confidence").alias("confidence"), F.min("unresolved").alias("unresolved"))
    return nodes.unionByName(stubs), best, stale


def wedge(quadrant: DataFrame, names: DataFrame, feeds: DataFrame) -> DataFrame:
    """(fqn, role): the first scope to move. quadrant: fqn, value, risk; names: fqn of all objects; feeds: fqn, touches.

    The SCOPE most valuable objects (role `chosen`) of risk 1 at most, of 2 if fewer than LEAST are, else of any;
    then, by name, others until there are LEAST (`filled`); then the jobs and schedules that touch them (`feeding`).
    """
    n = quadrant.agg(F.count_if(F.col("risk") <= 1).alias("one"), F.count_if(F.col("risk") <= 2).alias("two"))
    within = F.when(F.col("one") >= LEAST, F.col("risk") <= 1).when(F.col("two") >= LEAST, F.col("risk") <= 2).otherwise(F.lit(True))
    chosen = quadrant.join(F.broadcast(n), how="cross").filter(within).orderBy(F.desc("value"), "fqn").limit(SCOPE).select("fqn")
    others = names.select("fqn").distinct().join(chosen, "fqn", "left_anti").orderBy("fqn").limit(LEAST)
    ranked = chosen.select("fqn", F.lit("chosen").alias("role")).unionByName(others.select("fqn", F.lit("filled").alias("role")))
    place = F.row_number().over(Window.orderBy("role", "fqn"))  # at most SCOPE + LEAST rows
    scope = ranked.withColumn("place", place).filter((F.col("role") == "chosen") | (F.col("place") <= LEAST)).select("fqn", "role")
    touching = feeds.join(scope.select(F.col("fqn").alias("touches")), "touches", "left_semi").select("fqn").distinct().join(scope, "fqn", "left_anti")
    return scope.unionByName(touching.withColumn("role", F.lit("feeding")))


def wedge_cost(scope: DataFrame, unresolved: DataFrame, complex_: DataFrame) -> DataFrame:
    """One row: objects, unresolved edges (src, dst) at them, complex procedures (fqn) among them, score, days, risk."""
    ids = scope.select("fqn").distinct()
    keyed = unresolved.withColumn("edge", F.monotonically_increasing_id())
    ends = keyed.select("edge", F.col("src").alias("fqn")).unionByName(keyed.select("edge", F.col("dst").alias("fqn")))
    u = ends.join(ids, "fqn", "left_semi").agg(F.countDistinct("edge").alias("unresolved"))
    row = ids.agg(F.count("*").alias("objects")).crossJoin(u).crossJoin(complex_.select("fqn").distinct().join(ids, "fqn", "left_semi").agg(F.count("*").alias("complex")))
    risk = F.when((F.col("unresolved") >= 2) | (F.col("complex") >= 2), "high").when(F.col("unresolved") >= 1, "medium").otherwise("low")
    return row.withColumns({"score": F.col("objects") * F.lit(1.5) + F.col("complex") * 5 + F.col("unresolved") * 8, "days": F.round(F.col("objects") * F.lit(1.2) + F.col("unresolved") * 3 + F.col("complex") * 2, 1), "risk": risk})
