"""Comparing two tables, two versions of metadata, and two sides of a reconciliation."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scratch import cut


@dataclass(frozen=True)
class Tolerances:
    """What counts as equal. Columns are compared by their type, never by their name."""

    numeric_epsilon: float = 0.01
    temporal_seconds: int = 1
    case_insensitive: bool = True
    null_equals_empty: bool = False
    masked: tuple[str, ...] = ()


def compared_columns(a: DataFrame, b: DataFrame, masked: tuple[str, ...] = (), table: str = "") -> list[str]:
    """Columns of both sides that aren't masked, by leaf name or as table.column."""
    hidden = {m.lower() for m in masked if "." not in m} | {m.lower().rpartition(".")[2] for m in masked if m.lower().startswith(f"{table.lower()}.")}
    theirs = {c.lower() for c in b.columns}
    return [c for c in a.columns if c.lower() in theirs and c.lower() not in hidden]


def _comparable(c: str, kind: T.DataType, t: Tolerances) -> Column:
    if isinstance(kind, T.StringType):
        x = F.col(c)
        x = F.lower(x) if t.case_insensitive else x
        return F.coalesce(x, F.lit("")) if t.null_equals_empty else x
    return F.col(c)


def epsilon_missing(a: DataFrame, b: DataFrame, keys: list[str], t: Tolerances = Tolerances()) -> DataFrame:
    """Rows of a for which b has no row with equal keys and all other columns within tolerance; nulls equal nulls.

    The keys make it an equi-join; numeric and temporal columns are its residual.
    """
    kinds = {f.name: f.dataType for f in a.schema.fields}
    left = a.select(*[_comparable(c, kinds[c], t).alias(f"l_{c}") if c in keys else F.col(c).alias(f"l_{c}") for c in a.columns])
    right = b.select(*[_comparable(c, kinds[c], t).alias(f"r_{c}") if c in keys else F.col(c).alias(f"r_{c}") for c in a.columns])
    on = [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys]
    for c in compared_columns(a, b, t.masked):
        if c in keys:
            continue
        x, y = F.col(f"l_{c}"), F.col(f"r_{c}")
        if isinstance(kinds[c], T.NumericType):
            on.append((F.abs(x - y) <= t.numeric_epsilon) | (x.isNull() & y.isNull()))
        elif isinstance(kinds[c], (T.TimestampType, T.TimestampNTZType)):
            seconds = lambda z: F.unix_micros(z.cast("timestamp")) / 1_000_000
            on.append((F.abs(seconds(x) - seconds(y)) <= t.temporal_seconds) | (x.isNull() & y.isNull()))
        else:
            on.append(_comparable(f"l_{c}", kinds[c], t).eqNullSafe(_comparable(f"r_{c}", kinds[c], t)))
    return left.join(right, on, "left_anti").select(*[F.col(f"l_{c}").alias(c) for c in a.columns])


def near_missing(a: DataFrame, b: DataFrame, t: Tolerances = Tolerances()) -> DataFrame:
    """Rows of a for which b has no row with all columns within tolerance, without any key; nulls equal nulls.

    Columns are those that both have and no mask hides; with none of them nothing is missing if b has rows. Numeric and
    temporal ones with a tolerance put rows into cells, and only near cells are compared, by a join on equal cells. With
    one such column a cell is its least and largest value alone, so that no pairs arise however many rows share a cell;
    with more, rows of neighbouring cells of the first two columns are compared, each distinct row of b once. NaN and
    infinite values are near nothing.
    """
    kinds = {f.name: f.dataType for f in a.schema.fields}
    theirs = {c.lower(): c for c in b.columns}
    names = compared_columns(a, b, t.masked)
    temporal = lambda c: isinstance(kinds[c], (T.TimestampType, T.TimestampNTZType))
    width = {c: float(t.temporal_seconds if temporal(c) else t.numeric_epsilon) for c in names if temporal(c) or isinstance(kinds[c], T.NumericType)}
    loose = [c for c in names if width.get(c, 0.0) > 0]
    exact = [c for c in names if c not in loose]
    number = lambda x, c: F.unix_micros(x.cast("timestamp")) / 1_000_000 if temporal(c) else x
    keep = {c: f"l{i}" for i, c in enumerate(a.columns)}
    left = a.select(*[F.col(c).alias(keep[c]) for c in a.columns], *[_comparable(c, kinds[c], t).alias(f"x{i}") for i, c in enumerate(exact)], *[number(F.col(c), c).alias(f"v{i}") for i, c in enumerate(loose)])
    right = b.select(*[F.col(theirs[c.lower()]).cast(kinds[c]).alias(c) for c in names]).select(*[_comparable(c, kinds[c], t).alias(f"y{i}") for i, c in enumerate(exact)], *[number(F.col(c), c).alias(f"w{i}") for i, c in enumerate(loose)]).distinct()
    finite = lambda x: x.isNull() | (F.abs(x.cast("double")) < float("inf"))
    for i in range(len(loose)):
        right = right.filter(finite(F.col(f"w{i}")))
    on = [F.col(f"x{i}").eqNullSafe(F.col(f"y{i}")) for i in range(len(exact))]
    probed = loose[:2]
    # One column: cells half as wide as the tolerance, so that all of a cell is near to all of it. Else pairs are compared.
    part, span = (2, 3) if len(loose) == 1 else (1, 2)
    cell = lambda x, c: F.rint(x.cast("double") * part / width[c])
    near = lambda x, y, c: F.abs(x - y) <= width[c]
    if len(loose) == 1:
        right = right.groupBy(*[f"y{i}" for i in range(len(exact))], cell(F.col("w0"), loose[0]).alias("d0")).agg(F.min("w0").alias("low"), F.max("w0").alias("high"))
    else:
        right = right.withColumns({f"d{i}": cell(F.col(f"w{i}"), c) for i, c in enumerate(probed)}) if probed else right
    for i, c in enumerate(probed):
        left = left.withColumn(f"c{i}", cell(F.col(f"v{i}"), c))
        around = F.array(*[F.col(f"d{i}") + float(s) for s in range(-span, span + 1)])
        right = right.withColumn(f"d{i}", F.explode(F.array_distinct(around)))  # a null has one cell, its own
        on.append(F.col(f"c{i}").eqNullSafe(F.col(f"d{i}")))
    if len(loose) == 1:
        on.append(F.col("v0").isNull() | near(F.col("v0"), F.col("low"), loose[0]) | near(F.col("v0"), F.col("high"), loose[0]))
    else:
        on += [near(F.col(f"v{i}"), F.col(f"w{i}"), c) | (F.col(f"v{i}").isNull() & F.col(f"w{i}").isNull()) for i, c in enumerate(loose)]
    if not names:
        left, right, on = left.withColumn("c0", F.lit(1)), right.select(F.lit(1).alias("d0")).distinct(), [F.col("c0") == F.col("d0")]
    return left.join(right, on, "left_anti").select(*[F.col(keep[c]).alias(c) for c in a.columns])


def _ranged(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows sorted over range partitions, with the partition as `_part`; distinct ones spread whatever their keys."""
    return cut(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))


def _running(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """rows with the sum of value up to each, within its keys, in the order; no key's rows go to one task."""
    placed = _ranged(rows, keys, order)
    here = F.sum(value).over(Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    parts = placed.groupBy("_part", *keys).agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_{k}") for k in keys], before.alias("_before"))
    same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]]
    return placed.withColumn("_here", here).join(offsets, same).withColumn(out, F.col("_here") + F.col("_before")).drop("_part", "_p", "_here", "_before", *[f"_{k}" for k in keys])


def unmatched_once(a: DataFrame, b: DataFrame, t: Tolerances = Tolerances()) -> DataFrame:
    """Distinct rows of a, as compared, with the number `missing` of them that find no near row of b of their own.

    Each row of b serves one row of a, and as many as possible are served: from the least value up, each takes the least
    free one that is near. Columns are those that both have and no mask hides; all must be equal (nulls too) but one
    numeric or temporal one with a tolerance, whose value, null for null, may be less or more by it: limits are values
    minus and plus the tolerance, exact for decimals. More than one such column is a ValueError: no order of rows tells
    their matching. NaN and infinite values are near nothing.

    How many of b's rows, in order, are used after a value is min(max(used, those too small) + rows, those not too
    large). Such steps make one such step together, so that each range of values is first summed up to one step, then
    gone through from where the ones before it end; neither a key nor a value is a task of its own.
    """
    kinds = {f.name: f.dataType for f in a.schema.fields}
    theirs = {c.lower(): c for c in b.columns}
    names = compared_columns(a, b, t.masked)
    temporal = lambda c: isinstance(kinds[c], (T.TimestampType, T.TimestampNTZType))
    width = {c: t.temporal_seconds if temporal(c) else t.numeric_epsilon for c in names if temporal(c) or isinstance(kinds[c], T.NumericType)}
    loose = [c for c in names if width.get(c, 0) > 0]
    if len(loose) > 1:
        raise ValueError(f"more than one column has a tolerance: {', '.join(loose)}")
    exact = [c for c in names if c not in loose]
    keys = [f"k{i}" for i in range(len(exact))]

    def side(df: DataFrame, column, n: str) -> DataFrame:
        held = df.select(*[column(c).alias(c) for c in names]) if names else df.select(F.lit(1).alias("one"))
        made = held.select(*[_comparable(c, kinds[c], t).alias(k) for c, k in zip(exact, keys)], (F.col(loose[0]) if loose else F.lit(None).cast("double")).alias("v"))
        return made.groupBy(*keys, "v").agg(F.count("*").alias(n))

    mine, other = side(a, F.col, "n"), side(b, lambda c: F.col(theirs[c.lower()]).cast(kinds[c]), "m")
    told = lambda df: df.select(*[F.col(k).alias(c) for c, k in zip(exact, keys)], *[F.col("v").alias(c) for c in loose], F.col("missing").cast("long").alias("missing")).filter("missing > 0")
    finite = F.lit(True) if not loose or not isinstance(kinds[loose[0]], (T.DoubleType, T.FloatType)) else F.abs("v") < float("inf")
    # Equal values alone: rows without a number to be near to, and with none that is finite.
    same = [mine[k].eqNullSafe(other[k]) for k in [*keys, "v"]]
    nulls = mine.join(other, same, "left").filter(mine["v"].isNull()).select(*[mine[k] for k in [*keys, "v"]], F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0)).alias("missing"))
    if not loose:
        return told(nulls)
    odd = mine.filter(~finite).withColumn("missing", F.col("n"))
    c = loose[0]
    if temporal(c):
        moved = lambda sign: F.timestamp_micros(F.unix_micros(F.col("v").cast("timestamp")) + F.lit(int(sign * width[c] * 1_000_000)))
        value = F.col("v").cast("timestamp")
    elif isinstance(kinds[c], T.DecimalType):
        wide = f"decimal(38,{max(kinds[c].scale, 18 - min(kinds[c].precision - kinds[c].scale, 18))})"
        moved = lambda sign: (F.col("v").cast(wide) + F.lit(sign * Decimal(str(width[c]))).cast(wide)).cast(wide)
        value = F.col("v").cast(wide)
    else:
        moved = lambda sign: F.col("v").cast("double") + F.lit(float(sign * width[c]))
        value = F.col("v").cast("double")
    mine = cut(mine.filter(F.col("v").isNotNull() & finite))
    limit = lambda sign, turn: mine.select(*keys, "v", moved(sign).alias("at"), F.lit(turn).alias("turn"), F.lit(0).cast("long").alias("m"))
    free = other.filter(F.col("v").isNotNull() & finite).select(*keys, F.lit(None).cast(kinds[c]).alias("v"), value.alias("at"), F.lit(1).alias("turn"), "m")
    counted = _running(limit(-1, 0).unionByName(limit(1, 2)).unionByName(free), keys, ["at", "turn", "v"], "m", "upto").filter("turn <> 1")
    bounds = counted.groupBy(*keys, "v").agg(F.max(F.when(F.col("turn") == 0, F.col("upto"))).alias("low"), F.max(F.when(F.col("turn") == 2, F.col("upto"))).alias("high"))
    on = [mine[k].eqNullSafe(bounds[k]) for k in [*keys, "v"]]
    steps = _ranged(mine.join(bounds, on).select(*[mine[k] for k in [*keys, "v"]], "n", "low", "high"), keys, ["v"])
    # Of each range and key one step: low, n and high of min(max(used, low) + n, high).
    steps = steps.withColumn("key", F.struct(*keys) if keys else F.lit(1)).withColumn("key", F.to_json(F.struct("key"), {"ignoreNullFields": "false"}))

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for key, own in rows.sort_values("v").groupby("key", sort=False):
            low, n, high = 0, 0, 2**62
            for x, c, y in zip(own["low"], own["n"], own["high"]):
                # min(max(min(max(u, low) + n, high), x) + c, y): the lower limit rises where x binds, within the upper one.
                high = min(max(high, x) + c, y)
                low, n = max(low, x - n), n + c
            out.append((int(rows["_part"].iloc[0]), key, low, n, high))
        return pd.DataFrame(out, columns=["_part", "key", "low", "n", "high"])

    narrow = steps.select("_part", "key", F.col("v"), "n", "low", "high")
    parts = cut(narrow.groupBy("_part").applyInPandas(whole, "_part int, key string, low long, n long, high long"))
    used = lambda u, s: F.least(F.greatest(u, s["low"]) + s["n"], s["high"])
    before = F.array_sort(F.collect_list(F.struct("_part", "low", "n", "high")).over(Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    starts = parts.select(F.col("_part").alias("_p"), F.col("key").alias("_k"), F.aggregate(before, F.lit(0).cast("long"), used).alias("used"))
    begun = steps.join(starts, (F.col("_part") == F.col("_p")) & (F.col("key") == F.col("_k"))).drop("_p", "_k")

    def through(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("v")
        missing, at = [], {}
        for key, n, x, y, start in zip(rows["key"], rows["n"], rows["low"], rows["high"], rows["used"]):
            begin = max(at.get(key, start), x)
            at[key] = min(begin + n, y)
            missing.append(n - (at[key] - begin))
        return rows[[*keys, "v"]].assign(missing=missing)

    schema = T.StructType([*[begun.schema[k] for k in keys], T.StructField("v", kinds[c]), T.StructField("missing", T.LongType())])
    found = begun.select("_part", "key", *keys, "v", "n", "low", "high", "used").groupBy("_part").applyInPandas(through, schema)
    return told(found.unionByName(nulls).unionByName(odd.select(*keys, "v", "missing")))


def except_both(a: DataFrame, b: DataFrame, t: Tolerances = Tolerances(), decimals: int = 2) -> DataFrame:
    """One row: distinct rows only in a, only in b, and the larger of the two; texts and doubles made comparable."""
    columns = compared_columns(a, b, t.masked)
    kinds = {f.name: f.dataType for f in a.schema.fields}
    made = lambda df: df.select(*[F.round(F.col(c), decimals).alias(c) if isinstance(kinds[c], (T.DoubleType, T.FloatType)) else _comparable(c, kinds[c], t).alias(c) for c in columns])
    x, y = made(a), made(b)
    counts = x.subtract(y).agg(F.count("*").alias("only_source")).crossJoin(y.subtract(x).agg(F.count("*").alias("only_target")))
    return counts.withColumn("mismatched", F.greatest("only_source", "only_target"))


def rollup(table: str, a: DataFrame, b: DataFrame, keys: list[str], t: Tolerances = Tolerances()) -> DataFrame:
    """One row: rows of both sides, mismatches, their share in percent, and whether the table passed.

    Mismatched are rows of either side without a counterpart, the larger number. No rows at all never pass.
    """
    n = a.agg(F.count("*").alias("source_rows")).crossJoin(b.agg(F.count("*").alias("target_rows")))
    missing = epsilon_missing(a, b, keys, t).agg(F.count("*").alias("m")).crossJoin(epsilon_missing(b, a, keys, t).agg(F.count("*").alias("x")))
    worst = F.greatest("m", "x", F.abs(F.col("source_rows") - F.col("target_rows")))
    done = n.crossJoin(missing).select(F.lit(table).alias("table_name"), "source_rows", "target_rows", worst.alias("mismatched"))
    pct = F.round(100 * F.col("mismatched") / F.nullif(F.greatest("source_rows", "target_rows"), F.lit(0)), 4)
    status = F.when((F.col("source_rows") == 0) & (F.col("target_rows") == 0), "no_data").when(F.col("mismatched") == 0, "passed").otherwise("failed")
    return done.withColumns({"pct": pct, "status": status})


def summary(tables: DataFrame, sampled: int | None = None) -> DataFrame:
    """One row over those of rollup(): rows, mismatches, pct, passed, and bound_95.

    bound_95 is 3 / n, the upper bound of the share of mismatches at 95 % where n rows showed none; null else. n is the
    number sampled, if rows were. Without rows, or with a table that has none, nothing passes.
    """
    one = tables.agg(F.coalesce(F.sum("source_rows"), F.lit(0)).alias("rows_compared"), F.coalesce(F.sum("mismatched"), F.lit(0)).alias("mismatched_rows"), F.count_if(F.col("status") == "no_data").alias("empty"))
    n = F.col("rows_compared") if sampled is None else F.lit(sampled)
    clean = (F.col("mismatched_rows") == 0) & (F.col("rows_compared") > 0)
    pct = F.coalesce(F.round(100 * F.col("mismatched_rows") / F.nullif("rows_compared", F.lit(0)), 4), F.lit(0.0))
    return one.select("rows_compared", "mismatched_rows", pct.alias("pct"), (clean & (F.col("empty") == 0)).alias("passed"), F.when(clean, F.round(3 / n, 6)).alias("bound_95"))


def read_csv(spark, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text; a diff decides how to compare them."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def header_mismatches(csv: DataFrame, declared: list[str]) -> dict[str, list[str]]:
    """Columns that a file lacks and that it has beyond those declared, in any case; reads no row."""
    have, want = {c.strip().upper(): c for c in csv.columns}, {c.strip().upper(): c for c in declared}
    return {"missing": [c for k, c in want.items() if k not in have], "extra": [c for k, c in have.items() if k not in want]}


def except_one_way(a: DataFrame, b: DataFrame, t: Tolerances = Tolerances()) -> DataFrame:
    """One row: distinct rows of a, in the columns that both have, that b lacks; texts count with their case."""
    columns = compared_columns(a, b, t.masked)
    return a.select(*columns).subtract(b.select(*columns)).agg(F.count("*").alias("only_source"))


def hash_sample(df: DataFrame, key: str, sixteenths: int) -> DataFrame:
    """The rows whose key's md5 begins with one of the first so many hexadecimal digits: the same rows on any engine."""
    return df.filter(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 1) < F.lit(format(sixteenths, "x"))) if sixteenths < 16 else df


def drift(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, change): added, removed or changed; equal ones have no row."""
    a, b = before.select(F.col(key).alias("k"), F.col(value).alias("v"), F.lit(True).alias("in_a")), after.select(F.col(key).alias("k"), F.col(value).alias("w"), F.lit(True).alias("in_b"))
    joined = a.join(b, "k", "full")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("v").eqNullSafe(F.col("w")), "changed")
    return joined.select(F.col("k").alias(key), change.alias("change")).filter("change is not null")


#: Least similarity of two columns' names that counts as the same column.
SAME_NAME = 0.85


def continuity(source: DataFrame, target: DataFrame, key: str, value: str, canonical: DataFrame | None = None) -> DataFrame:
    """(key, status, confidence): whether each target column still comes from where it came from. A target is required.

    Sources match where their canonical ids (canonical: fqn, canonical_id) or, without these, their names in lower case
    are equal, or where their leaf names are alike to SAME_NAME; confidence is that similarity. Else they are mismatched,
    missing from the target, or extra in it. Of several sources of a column the largest name counts.
    """
    side = lambda df, v, has: df.groupBy(F.col(key).alias("k")).agg(F.max(value).alias(v)).withColumn(has, F.lit(True))
    joined = side(source, "v", "in_a").join(side(target, "w", "in_b"), "k", "full")
    same = F.lower("v").eqNullSafe(F.lower("w"))
    if canonical is not None:
        for c, out in (("v", "cv"), ("w", "cw")):
            ids = canonical.groupBy(F.lower("fqn").alias("_fqn")).agg(F.min("canonical_id").alias(out))
            joined = joined.join(ids, F.lower(c) == F.col("_fqn"), "left").drop("_fqn")
        same = F.coalesce("cv", F.lower("v")).eqNullSafe(F.coalesce("cw", F.lower("w")))
    leaf = lambda c: F.lower(F.substring_index(c, ".", -1))
    both = joined.filter("in_a and in_b").withColumn("same", same)
    near = both.withColumn("near", F.when(F.col("same"), 1.0).otherwise(F.coalesce(similarity(leaf("v"), leaf("w")), F.lit(0.0))))
    met = near.select("k", F.when(F.col("near") >= SAME_NAME, "matched").otherwise("mismatched").alias("status"), F.round("near", 2).alias("confidence"))
    lone = joined.filter("in_a is null or in_b is null").select("k", F.when(F.col("in_b").isNull(), "missing").otherwise("extra").alias("status"), F.lit(0.0).alias("confidence"))
    return met.unionByName(lone).withColumnRenamed("k", key)


def fingerprint(objects: DataFrame, edges: DataFrame, logic: DataFrame, attributes: DataFrame) -> DataFrame:
    """(section, key, value): objects (fqn), edges (src, dst, kind), logic and attributes (key, value), white space collapsed.

    Several values of a key are one, sorted and joined by ` || `.
    """
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    rows = objects.select(F.lit("object").alias("section"), F.col("fqn").alias("key"), F.lit("").alias("value"))
    rows = rows.unionByName(edges.select(F.lit("edge").alias("section"), F.concat("src", F.lit("->"), "dst", F.lit(":"), "kind").alias("key"), F.lit("").alias("value")))
    for name, df in (("logic", logic), ("attribute", attributes)):
        rows = rows.unionByName(df.select(F.lit(name).alias("section"), "key", plain(F.col("value")).alias("value")).filter("value <> ''"))
    return rows.groupBy("section", "key").agg(F.array_join(F.array_sort(F.collect_set("value")), " || ").alias("value"))


def fingerprint_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """(section, key, change, old, new): what was added, removed or changed between two fingerprints."""
    a, b = before.select("section", "key", F.col("value").alias("old"), F.lit(True).alias("in_a")), after.select("section", "key", F.col("value").alias("new"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return a.join(b, ["section", "key"], "full").select("section", "key", change.alias("change"), "old", "new").filter("change is not null")


def bump_version(current: str | None, changed: bool) -> str:
    """The version after a run: minor + 1 where anything changed, else patch + 1; none, 0.0.0 and odd ones count as 1.0.0."""
    parts = (current or "").split(".")
    major, minor, patch = map(int, parts) if len(parts) == 3 and all(p.isdigit() for p in parts) and current != "0.0.0" else (1, 0, 0)
    return f"{major}.{minor + 1}.0" if changed else f"{major}.{minor}.{patch + 1}"


def similarity(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two names (0 to 1), as Python's difflib gives it; null if either is null."""
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)], dtype="float64")

    return of(a, b)
