"""Graph operators over an edge table (src, dst, and what else it has): reach, cycles, levels, paths and degrees.

Iterative ones move a frontier outward with joins, keep only what is new, and cut their lineage in each round. They end
when nothing is new: no depth is cut off, unless a limit is what the caller asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import cut, drop


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def closure(edges: DataFrame, roots: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """(root, node, hops): all nodes reached from each root, at their least distance; a root itself only on a cycle.

    roots: one column `root`; all sources where it isn't given. max_hops: only nodes so near. Edges without an end take
    no part.
    """
    steps = cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    start = steps.select(F.col("src").alias("root")).distinct() if roots is None else roots.select("root").distinct()
    frontier = cut(start.join(steps, start["root"] == steps["src"]).select("root", F.col("dst").alias("node"), F.lit(1).alias("hops")))
    reached, hops = frontier, 1
    while not frontier.isEmpty() and (max_hops is None or hops < max_hops):
        hops += 1
        ahead = frontier.join(steps, frontier["node"] == steps["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(ahead.join(reached, ["root", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        reached = reached.unionByName(frontier)
        if hops % 16 == 0:  # so that a long chain's plan stays small
            reached = cut(reached)
    return reached


def blast_radius(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(root, reached, depth): how many nodes depend on each root, and how far the farthest is."""
    return closure(edges, roots).filter("node <> root").groupBy("root").agg(F.count("*").alias("reached"), F.max("hops").cast("long").alias("depth"))


def _gathered(edges: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What each node (own: node, weight, itself) has below it, from nodes without successors upward, and edges that remain.

    Rows are (node, weight, below, shared, sketch): below sums the weights on all ways down, so that a node counts twice
    where two ways lead to it; shared says that one may. sketch joins the sketches `itself` of a node and of those below.
    Edges on or before a cycle remain.
    """
    ways = edges.groupBy(F.col("dst").alias("node")).agg((F.count("*") > 1).alias("many"))
    own = cut(own.join(ways, "node", "left").withColumn("many", F.coalesce("many", F.lit(False))))
    fresh = cut(own.join(edges.select(F.col("src").alias("node")), "node", "left_anti").select("node", "weight", "many", F.lit(0).cast("long").alias("below"), F.lit(False).alias("shared"), F.col("itself").alias("sketch")))
    left = cut(edges.select("src", "dst", F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("twice"), F.lit(None).cast("binary").alias("s")))
    found, rounds = fresh, 0
    while not fresh.isEmpty() and not left.isEmpty():
        rounds += 1
        told = fresh.select(F.col("node").alias("dst"), (F.col("below") + F.col("weight")).alias("_n"), (F.col("shared") | F.col("many")).alias("_twice"), F.col("sketch").alias("_s"))
        known = cut(left.join(told, "dst", "left").select("src", "dst", F.coalesce("n", "_n").alias("n"), F.coalesce("twice", "_twice").alias("twice"), F.coalesce("s", "_s").alias("s")))
        ready = known.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("all"), F.count("n").alias("known"), F.sum("n").alias("below"), F.bool_or("twice").alias("shared"), F.hll_union_agg("s").alias("s")).filter("known = all").join(own, "node")
        fresh = cut(ready.select("node", "weight", "many", "below", "shared", F.hll_union("s", "itself").alias("sketch")))
        rest = cut(known.join(fresh.select(F.col("node").alias("src")), "src", "left_anti"))
        drop(left, known)
        left, found = rest, found.unionByName(fresh)
        if rounds % 16 == 0:
            found = cut(found)
    return found, left


def reach_sizes(edges: DataFrame, lg_k: int | None = None) -> DataFrame:
    """(root, reached): how many other nodes each node with successors reaches, without telling which.

    Sizes go up from the nodes without successors, a row a node, strong components as one node: where no two ways lead to
    a node they add up, and only nodes with such ones below them are told by closure(). With lg_k (4 to 21) these are
    estimates instead, from HLL sketches of 2^lg_k cells with a relative standard error of about 1 / sqrt(2^lg_k), and
    no pairs arise. Edges without an end take no part.
    """
    steps = cut(edges.select("src", "dst").filter("src is not null and dst is not null and src <> dst").distinct())
    nodes = steps.select(F.col("src").alias("node")).union(steps.select("dst")).distinct()
    ids = F.hll_sketch_agg("node", lg_k) if lg_k else F.lit(None).cast("binary")
    members = nodes.withColumn("at", F.col("node"))
    sized = lambda m: m.groupBy("at").agg(F.count("*").alias("weight"), ids.alias("itself")).withColumnRenamed("at", "node")
    found, left = _gathered(steps, sized(members))
    if not left.isEmpty():
        within = cut(cycle_members(left.select("src", "dst")))
        members = cut(nodes.join(within, "node", "left").select("node", F.coalesce("component", "node").alias("at")))
        for end in ("src", "dst"):
            steps = steps.join(members.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("at", end)
        steps = cut(steps.filter("src <> dst").distinct())
        found, _ = _gathered(steps, sized(members))
    if lg_k:
        sizes = found.select("node", "weight", F.when(F.col("shared"), F.greatest(F.hll_sketch_estimate("sketch") - F.col("weight"), F.lit(1))).otherwise(F.col("below")).alias("below"))
    else:
        found = cut(found)
        shared = found.filter("shared").select(F.col("node").alias("root"))
        told = closure(steps, shared).join(found.select("node", F.col("weight").alias("w")), "node").groupBy(F.col("root").alias("node")).agg(F.sum("w").alias("told")) if not shared.isEmpty() else shared.select(F.col("root").alias("node"), F.lit(0).cast("long").alias("told"))
        sizes = found.join(told, "node", "left").select("node", "weight", F.coalesce("told", "below").alias("below"))
    return members.join(sizes.withColumnRenamed("node", "at"), "at").select(F.col("node").alias("root"), (F.col("below") + F.col("weight") - 1).cast("long").alias("reached")).filter("reached > 0")


def blast_parents(edges: DataFrame, root: str) -> DataFrame:
    """(node, hops, via): what a change of root reaches; via is the smallest node that reaches it in the least hops."""
    steps = edges.select("src", "dst").distinct()
    found = closure(edges, edges.sparkSession.createDataFrame([(root,)], "root string")).filter(F.col("node") != root)
    near = found.select(F.col("node").alias("src"), F.col("hops").alias("before")).unionByName(edges.sparkSession.createDataFrame([(root, 0)], "src string, before int"))
    via = steps.join(near, "src").join(found.select(F.col("node").alias("dst"), "hops"), "dst").filter(F.col("before") + 1 == F.col("hops"))
    return via.groupBy(F.col("dst").alias("node"), "hops").agg(F.min("src").alias("via"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out): edges, counted as often as they occur."""
    ends = edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").cast("long").alias("fan_in"), F.sum("o").cast("long").alias("fan_out"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (column `node`) at no end of any edge."""
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti").join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have both a way in and a way out: what is left when all others are peeled off."""
    n = edges.count()
    while n:
        kept = cut(edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        drop(edges)
        edges, before, n = kept, n, kept.count()
        if n == before:
            break
    return edges


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after each node has taken the least label among those that reach it."""
    while True:
        came = edges.join(labels, edges["src"] == labels["node"]).groupBy("dst").agg(F.min("label").alias("came"))
        following = cut(labels.join(came, labels["node"] == came["dst"], "left").select("node", F.least("label", "came").alias("label"), (F.coalesce("came", "label") < F.col("label")).alias("moved")))
        moved = not following.filter("moved").isEmpty()
        drop(labels)
        if not moved:
            return following.drop("moved")
        labels = cut(following.drop("moved"))
        drop(following)


def cycle_members(edges: DataFrame) -> DataFrame:
    """(node, component): nodes on cycles, self-loops too, with the smallest node of their strong component.

    Acyclic nodes are peeled off first. Then each node takes the least label that reaches it; of the nodes with a label
    those that reach its owner are one component, which goes, and so on with the rest.
    """
    spark = edges.sparkSession
    steps = edges.select("src", "dst").filter("src is not null and dst is not null").distinct()
    kind = steps.schema["src"].dataType.simpleString()
    left, found = _trimmed(cut(steps)), spark.createDataFrame([], f"node {kind}, component {kind}")
    while not left.isEmpty():
        labels = _spread(cut(left.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))), left)
        inside = left.join(labels.select(F.col("node").alias("src"), F.col("label").alias("l")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("m")), "dst").filter("l = m").select("src", "dst", "l")
        back = inside.select(F.col("l").alias("owner"), F.col("dst").alias("src"), F.col("src").alias("dst"))
        owners = back.filter("src = owner").select("owner", F.col("dst").alias("node")).distinct()
        frontier = cut(owners)
        taken = frontier
        while not frontier.isEmpty():
            ahead = frontier.join(back, (frontier["node"] == back["src"]) & (frontier["owner"] == back["owner"])).select(frontier["owner"], F.col("dst").alias("node")).distinct()
            frontier = cut(ahead.join(taken, ["owner", "node"], "left_anti"))
            taken = taken.unionByName(frontier)
        taken = cut(taken.distinct())
        found = found.unionByName(taken.select("node", F.col("owner").alias("component")))
        # Owners that nothing reaches back are on no cycle; they go as well, or the loop wouldn't end.
        gone = taken.select("node").union(labels.filter("node = label").select("node")).distinct()
        left = _trimmed(cut(left.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")))
    smallest = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(smallest, "component").select("node", F.col("least").alias("component"))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, members): strongly connected components of two and more nodes or a self-loop, by smallest member."""
    return cycle_members(edges).groupBy("component").agg(F.count("*").alias("members"))


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): the longest way to a node from any without predecessors; null for nodes on or behind a cycle.

    Nodes wait with the number of their predecessors that have no level yet. Each round takes off what the last layer's
    edges lead to, and writes the nodes that still wait and those that come free as one table; edges are read only.
    """
    steps = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    waits = steps.select(F.col("src").alias("node"), F.lit(0).cast("long").alias("n")).union(steps.select("dst", F.lit(1).cast("long")))
    state, level = cut(waits.groupBy("node").agg(F.sum("n").alias("n"))), 0
    layer, waiting = state.filter("n = 0").select("node"), state.filter("n > 0")
    done = layer.withColumn("level", F.lit(0).cast("long"))
    while not layer.isEmpty():
        level += 1
        taken = steps.join(layer.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("taken"))
        state = cut(waiting.join(taken, "node", "left").select("node", (F.col("n") - F.coalesce("taken", F.lit(0))).alias("n")))
        layer, waiting = state.filter("n = 0").select("node"), state.filter("n > 0")
        done = done.unionByName(layer.withColumn("level", F.lit(level).cast("long")))
        if level % 16 == 0:
            done = cut(done)
    return done.unionByName(waiting.select("node", F.lit(None).cast("long").alias("level")))


def topological_order(edges: DataFrame, ordinals: DataFrame) -> DataFrame:
    """(node, position): by level, then by the column `ordinal` of ordinals (node, ordinal), then by node.

    Nodes on or behind a cycle come last, in their ordinals' order; nodes without edges are of level 0.
    """
    placed = ordinals.join(levels(edges), "node", "left")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("linked", F.lit(True))
    late = placed.join(ends, "node", "left").withColumn("late", F.when(F.col("level").isNotNull() | F.col("linked").isNull(), F.coalesce("level", F.lit(0))).otherwise(F.lit(2**62)))
    return numbered(late, ["late", "ordinal", "node"], "position").select("node", "position")


def simple_paths(edges: DataFrame) -> DataFrame:
    """(path, hops): all simple paths from nodes without predecessors to nodes without successors, `>`-joined.

    hops counts nodes. All paths are told, of whatever length; there may be very many of them.
    """
    steps = cut(edges.select("src", "dst").distinct())
    sources = steps.select("src").distinct().join(steps.select(F.col("dst").alias("src")), "src", "left_anti")
    sinks = cut(steps.select("dst").distinct().join(steps.select(F.col("src").alias("dst")), "dst", "left_anti"))
    paths = cut(sources.select(F.array("src").alias("nodes"), F.col("src").alias("last")))
    found = None
    while not paths.isEmpty():
        paths = cut(paths.join(steps, paths["last"] == steps["src"]).filter(~F.array_contains("nodes", F.col("dst"))).select(F.concat("nodes", F.array("dst")).alias("nodes"), F.col("dst").alias("last")))
        ended = paths.join(sinks, paths["last"] == sinks["dst"], "left_semi").select(F.array_join("nodes", ">").alias("path"), F.size("nodes").cast("long").alias("hops"))
        found = ended if found is None else found.unionByName(ended)
    return found if found is not None else paths.select(F.array_join("nodes", ">").alias("path"), F.size("nodes").cast("long").alias("hops"))


def coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, linked ones, and their share in percent."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().withColumn("linked", F.lit(1))
    joined = nodes.distinct().join(ends, "node", "left")
    return joined.agg(F.count("*").alias("nodes"), F.count("linked").alias("linked")).withColumn("pct", F.round(100 * F.col("linked") / F.nullif("nodes", F.lit(0)), 4))


def index_percentiles(values: DataFrame, column: str) -> DataFrame:
    """One row: p50, p90, max and mean, a percentile being the value at index floor(p * n) of the sorted ones.

    Values are counted first, and distinct ones numbered over range partitions.
    """
    counted = cut(values.groupBy(F.col(column).cast("long").alias("v")).agg(F.count("*").alias("c")).repartitionByRange("v"))
    # A running sum within each partition, and the sums of the partitions before it: one row for each partition.
    part = counted.withColumn("part", F.spark_partition_id())
    upto = part.withColumn("upto", F.sum("c").over(Window.partitionBy("part").orderBy("v")))
    before = part.groupBy("part").agg(F.sum("c").alias("size"), F.min("v").alias("least")).withColumn("before", F.coalesce(F.sum("size").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = upto.join(before.select("part", "before"), "part").withColumn("upto", F.col("upto") + F.col("before")).crossJoin(counted.agg(F.sum("c").alias("n")))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col("v")))
    return rows.agg(at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("v").alias("largest"), F.round(F.sum(F.col("v") * F.col("c")) / F.max("n"), 4).alias("mean"))


def numbered(rows: DataFrame, order: list[str], out: str) -> DataFrame:
    """Adds each row's place, from 0, in the order over all rows; sorted over range partitions, with none in one task."""
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), part == F.col("_part")).withColumn(out, F.col("_before") + row).drop("_at", "_part", "_before")
