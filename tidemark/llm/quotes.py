"""Quotation linking, in DataFrame functions only: quote levels, quoted passages joined to the messages they come from,
and reply-ordered conversations without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, part, saved

#: What marks a quoted line: `>` once for each level, white space allowed around them. Possessive, for Java's regular
#: expressions recurse once for each repeat of a group else.
PREFIX = r"^(?:[ \t]*+>)++[ \t]?"


def _lines(text: Column) -> Column:
    """(level, body) of each line; a null text has one empty line."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "\n")
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, PREFIX, 0), "[^>]", "")).alias("level"), F.regexp_replace(x, PREFIX, "").alias("body")))


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f\u000b]+", " "))


def own_text(lines: Column) -> Column:
    """The lines that quote nothing, without blank lines at either end."""
    own = F.array_join(F.transform(F.filter(lines, lambda x: x["level"] == 0), lambda x: x["body"]), "\n")
    return F.rtrim(F.regexp_replace(own, r"^(?:[ \t]*+\n)++", ""), F.lit(" \t\n\r\f\u000b"))


def _passages(rows: DataFrame) -> DataFrame:
    """Adds level and passage, a row for each run of `lines` of one level; blank lines part runs and belong to none.

    A run begins and ends where the level of the line before or after differs. Levels and edges are columns of their
    own, so that no lambda computes them again for each line.
    """
    n = F.size("lines")
    level_of = lambda x: F.when(F.trim(F.regexp_replace(x["body"], r"\s", " ")) == "", F.lit(-1)).otherwise(x["level"])
    at = lambda i: F.element_at("levels", i)
    begins = F.filter(F.sequence(F.lit(1), n), lambda i: (at(i) >= 0) & ((i == 1) | (at(i) != at(F.greatest(i - 1, F.lit(1))))))
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (at(i) >= 0) & ((i == n) | (at(i) != at(F.least(i + 1, n)))))
    edged = rows.withColumn("levels", F.transform("lines", level_of)).withColumns({"begins": begins, "ends": ends})
    body = lambda r: normalised(F.array_join(F.transform(part(F.col("lines"), r["begins"], r["ends"]), lambda x: x["body"]), "\n"))
    runs = F.transform(F.arrays_zip("begins", "ends"), lambda r: F.struct(at(r["begins"]).alias("level"), body(r).alias("passage")))
    return edged.select(*[c for c in rows.columns if c != "lines"], F.explode(runs).alias("run")).select(*[c for c in rows.columns if c != "lines"], "run.level", "run.passage")


def numbered(rows: DataFrame, order: list[str], out: str, name: str, save=None) -> DataFrame:
    """Adds each row's place, from 0, in the order over all rows, with no group in one task.

    Rows are sorted over range partitions, which also part a large group, and numbered by partition and row; counts of
    the partitions give what comes before each. save: where the sorted rows go, to stay by default.
    """
    placed = (save or (lambda df, as_: saved(df, as_)[0]))(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_tm_at", F.monotonically_increasing_id()), name)
    part, row = F.shiftright("_tm_at", 33), F.col("_tm_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_tm_part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_tm_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_tm_part", before.alias("_tm_before"))  # one row for each partition
    return placed.join(F.broadcast(offsets), part == F.col("_tm_part")).withColumn(out, F.col("_tm_before") + row).select(*rows.columns, out)


#: Rows in a stretch within which the last run is looked for.
CELL = 65_536


def _runs(messages: DataFrame) -> DataFrame:
    """Adds `run` to rows numbered `g`: the number of the last row, up to this one, that begins a run.

    A running maximum within stretches of rows, and one over the stretches' own maxima.
    """
    begun = F.when(F.col("begins"), F.col("g"))
    cell = F.floor(F.col("g") / CELL)
    within = F.max(begun).over(Window.partitionBy("cell").orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    cells = messages.groupBy(cell.alias("cell")).agg(F.max(begun).alias("most"))
    carried = cells.select("cell", F.max("most").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    return messages.withColumn("cell", cell).join(carried, "cell").withColumn("run", F.coalesce(within, "carried")).drop("cell", "carried")


_STEPS = "array<struct<a:bigint,b:bigint>>"


def _paths(runs: DataFrame, save) -> DataFrame:
    """(run, path) from (run, up, step): the steps from a conversation's first run down to each run.

    Each round doubles how far up a path reaches, so rounds are as many as the binary digits of the deepest nesting.
    """
    none = F.array().cast(_STEPS)
    now = save(runs.select("run", "up", F.when(F.col("up").isNull(), none).otherwise(F.array("step")).alias("path")), "paths")
    while now.filter("up is not null").limit(1).count():
        above = now.select(F.col("run").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        now = save(now.join(above, "up", "left").select("run", F.col("next").alias("up"), F.concat(F.coalesce("head", none), "path").alias("path")), "paths")
    return now.select("run", "path")


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Reply-ordered conversations without quotes, one row per message.

    Returns conv_id, position (from 0, in reply order), turn, role, text (without quotes), reply_to (the turn of the
    message replied to), quotes, linked and foreign (quoted passages, those with an original, and those whose original
    is in another conversation).

    A passage is a run of lines of one quote level between blank lines, compared in lower case with white space
    collapsed: first by hash, then by text. A quoted passage's original is the first message of its conversation that
    has it unquoted, if that comes before the quoting one; else the first in all other conversations by id and turn. A
    message replies to the latest original of its level-one quotes within the conversation, else to the message before
    it. Reply order puts each message before its replies: the branch of the next message first, then other replies,
    those to later messages first, then by turn.

    Null texts are empty; null conversations form one; messages without a turn come first; of repeated turns the order
    is by role and text. No rows give none; other columns are ignored.
    """
    with Scratch(messages.sparkSession) as work:
        told = _told(messages, work.saved, conv_col, turn_col, role_col, text_col)
        placed = numbered(told, ["key", "path", "g"], "after", "told")
    return placed.select("conv_id", (F.col("after") - F.col("zero")).alias("position"), "turn", "role", "text", "reply_to", "quotes", "linked", "foreign")


def _told(messages: DataFrame, save, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The messages with what they quote and reply to, and their path in reply order."""
    # No id is the key of null.
    base = messages.select(F.when(F.col(conv_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(conv_col).cast("string"))).alias("key"), F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("raw"))
    rows = numbered(base, ["key", "turn", "role", "raw"], "g", "messages", save)
    begin = rows.groupBy("key").agg(F.min("g").alias("zero"))
    rows = save(rows.join(begin, "key"), "numbered")
    passages = _passages(rows.select("key", "conv_id", "turn", "g", _lines(F.col("raw")).alias("lines"))).withColumn("hash", F.xxhash64("passage"))
    quoting = rows.filter(F.col("raw").rlike(r"(^|[\r\n])[ \t]*>")).select("key", "conv_id", "turn", "g", _lines(F.col("raw")).alias("lines"))
    quoted = save(_passages(quoting).filter("level > 0").withColumn("hash", F.xxhash64("passage")), "quoted")
    originals = save(passages.filter("level = 0").join(quoted.select("hash").distinct(), "hash", "left_semi"), "originals")
    here = originals.groupBy("key", "hash", "passage").agg(F.min("g").alias("origin"))
    place = F.struct(F.col("conv_id").isNotNull().alias("known"), "conv_id", "turn", "g", "key")
    # The first conversation that has a passage, and the first other one: the original of all who aren't in the first.
    by_conv = originals.groupBy("hash", "passage", "key").agg(F.min(place).alias("far"))
    first = by_conv.groupBy("hash", "passage").agg(F.min("far").alias("far"))
    second = by_conv.join(first.withColumnRenamed("far", "least"), ["hash", "passage"]).filter(F.col("key") != F.col("least.key")).groupBy("hash", "passage").agg(F.min("far").alias("other"))
    matched = quoted.join(here, ["key", "hash", "passage"], "left").withColumn("origin", F.when(F.col("origin") < F.col("g"), F.col("origin"))).join(first, ["hash", "passage"], "left").join(second, ["hash", "passage"], "left")
    foreign = F.col("origin").isNull() & ((F.col("far.key") != F.col("key")) | F.col("other").isNotNull())
    linked = matched.groupBy("g").agg(F.count("*").alias("quotes"), F.count(F.when(F.col("origin").isNotNull() | foreign, 1)).alias("linked"), F.count(F.when(foreign, 1)).alias("foreign"), F.max(F.when(F.col("level") == 1, F.col("origin"))).alias("parent"))
    begins = (F.col("g") == F.col("zero")) | (F.col("parent") != F.col("g") - 1)
    replied = rows.join(linked, "g", "left").withColumn("parent", F.coalesce("parent", F.when(F.col("g") > F.col("zero"), F.col("g") - 1))).withColumn("begins", begins)
    # A run is a stretch of messages that each reply to the one before. There are few, so paths are over runs.
    replied = save(_runs(replied), "runs")
    heads = replied.filter("begins").select("run", "parent")
    above = replied.select(F.col("g").alias("parent"), F.col("run").alias("up"), F.col("turn").alias("reply_to"))
    runs = heads.join(above, "parent", "left").select("run", "up", F.struct((-F.col("parent")).alias("a"), F.col("run").alias("b")).alias("step"))
    told = replied.join(above.drop("up"), "parent", "left").join(_paths(runs, save), "run")
    return told.select("key", "conv_id", "path", "g", "zero", "turn", "role", own_text(_lines(F.col("raw"))).alias("text"), "reply_to", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("quotes", "linked", "foreign")])
