"""Human decisions about names, applied in their order: each one sees what those before it have made of the estate.

A name's way through the renames is told once, as spans of time, and edges, column rows and calls are joined to it; no
decision goes through the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import cut
from .graph import numbered
from .remediation import RUNTIME_EDGE

KINDS = ("alias", "stub", "runtime_sources")
#: What an edge of no known kind becomes by the kind of its consumer, else by that of its producer.
BY_CONSUMER = {"VIEW": "VIEW_DEPENDS", "PROCEDURE": "SP_READS", "ETL_JOB": "ETL_READS", "SCHEDULE": "SCHEDULE_DEPENDS", "DASHBOARD": "DASHBOARD_RENDERS"}
BY_PRODUCER = {"PROCEDURE": "SP_WRITES", "ETL_JOB": "ETL_WRITES"}


@dataclass(frozen=True)
class Replayed:
    """nodes (fqn, kind) and edges (src, dst, kind, confidence, unresolved) as decided; notes: a row a decision (seq, kind,
    subject, target, applied, reason); names (name, final): what the names that moved are called at the end; settled (fqn):
    names that are no open question any more."""

    nodes: DataFrame
    edges: DataFrame
    notes: DataFrame
    names: DataFrame
    settled: DataFrame

    def rename(self, rows: DataFrame, *columns: str) -> DataFrame:
        """Rows (column lineage, calls, reads) whose columns hold names, or arrays of names, by their final names."""
        for c in columns:
            if rows.schema[c].dataType.typeName() == "array":
                keyed = rows.withColumn("_row", F.struct(*rows.columns)).withColumn("_id", F.monotonically_increasing_id())
                keyed = cut(keyed.select("_id", "_row"))
                each = keyed.select("_id", F.posexplode(f"_row.{c}").alias("_at", "name")).join(self.names, "name", "left").groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("final", "name").alias("n")))).alias("_all"))
                made = F.when(F.col("_all").isNull(), F.col(f"_row.{c}")).otherwise(F.col("_all.n"))
                rows = keyed.join(each, "_id", "left").select(*[made.alias(c) if d == c else F.col(f"_row.{d}") for d in rows.columns])
            else:
                order = rows.columns
                final = self.names.select(F.col("name").alias("_name"), F.col("final").alias("_final"))
                rows = rows.join(final, rows[c] == F.col("_name"), "left").withColumn(c, F.coalesce("_final", c)).select(*order)
        return rows


def _next(rows: DataFrame, marks: DataFrame, column: str, inclusive: bool) -> DataFrame:
    """rows (name, since, ...) with the least `at` of the marks (name, at) of that name at or after since, as `column`."""
    events = rows.withColumn("_mark", F.lit(None).cast("long")).unionByName(marks.select("name", F.col("at").alias("since"), F.col("at").alias("_mark")), allowMissingColumns=True)
    first = F.col("_mark").isNull() if inclusive else F.col("_mark").isNotNull()
    window = Window.partitionBy("name").orderBy(F.desc("since"), first).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn(column, F.min("_mark").over(window)).filter("_mark is null").drop("_mark")


def _spans(origins: DataFrame, moves: DataFrame) -> DataFrame:
    """(origin, born, name, since, until): what a name of a time is called, span by span; the last has no until.

    Rounds follow one rename of every name each, as many as the longest way of a name has.
    """
    leaving = moves.select(F.col("from").alias("name"), "at")
    step = cut(_next(moves.select(F.col("to").alias("name"), F.col("at").alias("since")), leaving, "until", False).select(F.col("since").alias("_at"), F.col("name").alias("_to"), F.col("until").alias("_until")))
    start = origins.select("origin", "born", F.col("origin").alias("name"), F.col("born").alias("since"))
    frontier = cut(_next(start, leaving, "until", False).select("origin", "born", "name", "since", "until"))
    found, rounds = frontier, 0
    while not frontier.filter("until is not null").isEmpty():
        rounds += 1
        frontier = cut(frontier.join(step, F.col("until") == F.col("_at")).select("origin", "born", F.col("_to").alias("name"), F.col("_at").alias("since"), F.col("_until").alias("until")))
        found = found.unionByName(frontier)
        if rounds % 16 == 0:
            found = cut(found)
    return cut(found)


def _at_end(edges: DataFrame, rows: DataFrame, end: str) -> DataFrame:
    """Edges with what rows (origin, born, ...) say of the name at one of their ends, its columns led by that end's name.
    A null end stays, with nulls."""
    told = rows.select(*[F.col(c).alias(f"{end}_{c}") for c in rows.columns])
    return edges.join(told, (edges[end] == told[f"{end}_origin"]) & (edges["born"] == told[f"{end}_born"]), "left").drop(f"{end}_origin", f"{end}_born")


def _first(kinds: dict[str, str], kind: Column) -> Column:
    return reduce(lambda out, k: out.when(kind == k, kinds[k]), list(kinds)[1:], F.when(kind == next(iter(kinds)), next(iter(kinds.values()))))


def replay(nodes: DataFrame, edges: DataFrame, overrides: DataFrame) -> Replayed:
    """The estate after all overrides (subject, kind, target, sources, seq), one after the other.

    `alias`: what refers to the subject refers to the target, which must be a node by then. `stub`: the target, the
    subject where there is none, becomes a TABLE if it is no node yet; references to the subject go there.
    `runtime_sources`: edges from those sources that are nodes by then, at confidence 1.0, unless there is such an edge.
    All of them resolve the unresolved edges at the name in question, which then count as certain and, if their kind is
    UNRESOLVED, take the one that fits the nodes at their ends. A later override may move a name on, or back; equal
    seq go by kind, subject and target. Overrides without a subject, of another kind, or whose target is no node, change
    nothing and say why. Of edges that come to be one, resolved ones count before unresolved ones, then the confidence.
    Null ends of edges stay; repeated rows count once; a name that several nodes have is of the least kind.
    """
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    plain = overrides.select("seq", "kind", "subject", "target", F.array_distinct(F.filter(sources, lambda s: s.isNotNull() & (s != ""))).alias("sources"))
    o = numbered(plain, ["seq", "kind", "subject", "target", "sources"], "at").withColumn("at", F.col("at").cast("long") + 1)
    given = F.nullif(F.coalesce("subject", F.lit("")), F.lit(""))
    o = cut(o.withColumn("to", F.coalesce(F.nullif("target", F.lit("")), given)))
    known = F.col("kind").isin(*KINDS) & given.isNotNull()
    stubs = o.filter(known & (F.col("kind") == "stub")).groupBy(F.col("to").alias("fqn")).agg(F.min("at").alias("made"))
    own = nodes.filter("fqn is not null").groupBy("fqn").agg(F.min("kind").alias("node_kind")).withColumn("made", F.lit(0).cast("long"))
    all_nodes = cut(own.unionByName(stubs.join(own, "fqn", "left_anti").withColumn("node_kind", F.lit("TABLE")), allowMissingColumns=True).select("fqn", "node_kind", "made"))
    to_node = all_nodes.select(F.col("fqn").alias("to"), "made")
    lost = F.when(given.isNull(), "no subject").when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), F.concat(F.lit("unknown kind "), F.coalesce("kind", F.lit("null"))))
    lost = F.coalesce(lost, F.when((F.col("kind") == "alias") & (F.col("made").isNull() | (F.col("made") >= F.col("at"))), F.concat(F.lit("no object "), "to")))
    o = cut(o.join(to_node, "to", "left").withColumn("reason", lost).drop("made"))
    good = o.filter("reason is null")
    moves = cut(good.filter("kind = 'alias' or kind = 'stub' and to <> subject").select("at", F.col("subject").alias("from"), "to"))
    cleared = cut(good.filter("kind <> 'alias'").select(F.when(F.col("kind") == "stub", F.col("to")).otherwise(F.col("subject")).alias("name"), "at"))

    runtime = good.filter("kind = 'runtime_sources'").select("at", F.col("subject").alias("dst"), F.explode("sources").alias("src"))
    runtime = runtime.join(all_nodes.select(F.col("fqn").alias("src"), "made"), "src").filter("made < at").drop("made")
    runtime = runtime.join(all_nodes.select(F.col("fqn").alias("dst"), "node_kind", "made"), "dst", "left")
    said = F.coalesce(_first(RUNTIME_EDGE, F.when(F.col("made") < F.col("at"), F.col("node_kind"))), F.lit("VIEW_DEPENDS"))
    added = runtime.select("src", "dst", said.alias("kind"), F.lit(1.0).alias("confidence"), F.lit(False).alias("unresolved"), F.col("at").alias("born"))
    every = cut(edges.select("src", "dst", "kind", "confidence", F.coalesce("unresolved", F.lit(False)).alias("unresolved")).distinct().withColumn("born", F.lit(0).cast("long")).unionByName(added))

    ends = every.select(F.col("src").alias("origin"), "born").union(every.select("dst", "born"))
    origins = ends.union(moves.select("from", F.lit(0).cast("long"))).filter("origin is not null").distinct()
    spans = _spans(origins, moves)
    # When a name is first touched: as it moves, or as a decision about it, or about what it is then called, comes.
    touched = _next(spans, cleared, "clear", True).withColumn("clear", F.when(F.col("until").isNull() | (F.col("clear") < F.col("until")), F.col("clear")))
    names = touched.groupBy("origin", "born").agg(F.max_by("name", "since").alias("final"), F.least(F.min("until"), F.min("clear")).alias("touched"))
    # An end that is null is a name of its own that nothing touches.
    names = cut(names.unionByName(every.select(F.lit(None).cast("string").alias("origin"), "born").distinct().select("origin", "born", F.lit(None).cast("string").alias("final"), F.lit(None).cast("long").alias("touched"))))

    def at_end(rows: DataFrame, end: str) -> DataFrame:
        told = names.select(F.col("origin").alias(f"{end}_o"), F.col("born").alias(f"{end}_b"), F.col("final").alias(f"{end}_final"), F.col("touched").alias(f"{end}_touched"))
        return rows.join(told, rows[end].eqNullSafe(told[f"{end}_o"]) & (rows["born"] == told[f"{end}_b"])).drop(f"{end}_o", f"{end}_b")

    placed = at_end(at_end(every, "src"), "dst").withColumn("settled", F.when(F.col("unresolved"), F.least("src_touched", "dst_touched"))).drop("src_touched", "dst_touched")
    vague = cut(placed.filter("kind = 'UNRESOLVED' and settled is not null"))
    shown = vague
    for end in ("src", "dst"):
        then = _at_end(shown, spans, end)
        then = then.filter(F.col(f"{end}_since").isNull() | (F.col("settled") >= F.col(f"{end}_since")) & (F.col(f"{end}_until").isNull() | (F.col("settled") < F.col(f"{end}_until")))).drop(f"{end}_since", f"{end}_until")
        as_node = all_nodes.select(F.col("fqn").alias(f"{end}_name"), F.col("node_kind").alias(f"{end}_kind"), F.col("made").alias(f"{end}_made"))
        shown = then.join(as_node, f"{end}_name", "left").withColumn(f"{end}_kind", F.when(F.col(f"{end}_made") <= F.col("settled"), F.col(f"{end}_kind"))).drop(f"{end}_name", f"{end}_made")
    fits = F.coalesce(_first(BY_CONSUMER, F.col("dst_kind")), _first(BY_PRODUCER, F.col("src_kind")), F.lit("VIEW_DEPENDS"))
    # Of one edge given as resolved and as unresolved only the latter has a time.
    fitted = shown.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("born").alias("_born"), fits.alias("fits")).distinct()
    kinded = placed.join(fitted, F.col("src").eqNullSafe(F.col("_src")) & F.col("dst").eqNullSafe(F.col("_dst")) & (F.col("born") == F.col("_born")), "left").drop("_src", "_dst", "_born")
    kinded = cut(kinded.withColumn("later", F.when(F.col("settled").isNotNull() & (F.col("kind") == "UNRESOLVED"), F.col("fits")).otherwise(F.col("kind"))).drop("fits"))

    # Edges that a decision names again: there was one of that kind between those names just then.
    wanted = kinded.filter("born > 0").select(F.col("src").alias("src_name"), F.col("dst").alias("dst_name"), F.col("kind").alias("wanted"), F.col("born").alias("then"))
    was = kinded.filter("src is not null and dst is not null").select("src", "dst", "kind", "later", "settled", "born")
    was = _at_end(_at_end(was, spans, "src"), spans, "dst").join(wanted, ["src_name", "dst_name"])
    inside = lambda end: (F.col("then") >= F.col(f"{end}_since")) & (F.col(f"{end}_until").isNull() | (F.col("then") < F.col(f"{end}_until")))
    held = F.when(F.col("settled") < F.col("then"), F.col("later")).otherwise(F.col("kind"))
    there = was.filter((F.col("born") < F.col("then")) & inside("src") & inside("dst") & (held == F.col("wanted"))).select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), F.col("wanted").alias("kind"), F.col("then").alias("born")).distinct()
    kept = kinded.filter("born = 0").unionByName(kinded.filter("born > 0").join(there, ["src", "dst", "kind", "born"], "left_anti").select(*kinded.columns))

    done = F.col("settled").isNotNull()
    final = kept.select(F.col("src_final").alias("src"), F.col("dst_final").alias("dst"), F.col("later").alias("kind"), F.when(done, 1.0).otherwise(F.col("confidence")).alias("confidence"), (F.col("unresolved") & ~done).alias("unresolved"))
    best = final.groupBy("src", "dst", "kind").agg(F.max(F.struct((~F.col("unresolved")).alias("sure"), "confidence")).alias("b")).select("src", "dst", "kind", "b.confidence", (~F.col("b.sure")).alias("unresolved"))
    renamed = names.filter("born = 0 and origin <> final").select(F.col("origin").alias("name"), "final")
    after = nodes.unionByName(all_nodes.filter("made > 0").select("fqn", F.col("node_kind").alias("kind")), allowMissingColumns=True)
    notes = o.select("seq", "kind", "subject", F.when(F.coalesce(F.col("kind") != "runtime_sources", F.lit(True)), F.col("to")).alias("target"), F.col("reason").isNull().alias("applied"), "reason")
    settled = moves.select(F.col("from").alias("fqn")).union(cleared.select("name")).distinct()
    return Replayed(after, best, notes, cut(renamed), settled)
