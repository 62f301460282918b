"""Line deduplication by content-defined chunks, in DataFrame functions only.

A rolling hash over the hashes of the last lines puts each place of a text into one of a few classes; the places of a
class are its boundaries, which move with the text. A chunk runs from the lines that made a boundary to those that made
the class's next one, so that it depends on nothing around it, and the classes' chunks overlap. Chunks that occur more
than once in the corpus, byte for byte, stay at their first place and go elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, part, saved

#: Classes of boundaries; each has every CLASSES-th place, about.
CLASSES = 2
#: What makes a chunk worth removing: so many lines and words, or so many words of whatever lines.
LEAST_LINES, LEAST_WORDS, MANY_WORDS = 2, 10, 50
#: Multiplier and modulus of the rolling hash, which covers two lines.
BASE, MODULUS = 31, 1 << 32


def line_hash(line: Column) -> Column:
    """32 bits of a line."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[ \\t\\r\\n]+"), lambda w: w != ""))


def chunks(hashes: Column, words: Column, classes: int = CLASSES) -> Column:
    """The chunks of a text, as distinct (first, last) lines from 1; hashes: line_hash of each line, words: how many.

    A place is a line and the one before it. A class's chunks run from one of its places to the next, the lines of both
    included, and from and to the ends of the text. A line of MANY_WORDS is a chunk besides.
    """
    n = F.size(hashes)
    # Lines before the last, and after the first; none where there is but one.
    place = F.zip_with(F.slice(hashes, F.lit(1), n - 1), F.slice(hashes, F.lit(2), n - 1), lambda a, b: (a * BASE + b) % MODULUS % classes)
    some = lambda a: F.filter(a, lambda x: x.isNotNull())
    # First and extent in one long: Spark tells longs apart by a hash, which is the one half XOR the other, but structs in pairs.
    span = lambda a, b: F.shiftleft(a.cast("long"), 32) + (b - a).cast("long")
    long = some(F.transform(words, lambda w, i: F.when(w >= MANY_WORDS, span(i + 1, i + 1))))

    def of_class(c: int) -> Column:
        at = some(F.transform(place, lambda x, i: F.when(x == c, i + 2)))
        return F.zip_with(F.concat(F.array(F.lit(1)), F.transform(at, lambda i: i - 1)), F.concat(at, F.array(n)), span)

    found = F.array_distinct(F.concat(*map(of_class, range(classes)), long))
    return F.transform(found, lambda c: F.struct(F.shiftright(c, 32).cast("int").alias("first"), (F.shiftright(c, 32) + c.bitwiseAND(F.lit((1 << 32) - 1))).cast("int").alias("last")))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, work: Scratch, classes: int = CLASSES) -> DataFrame:
    """The lines to remove: _tm_id, _tm_hash (of the text) and _tm_drop, a sorted array of disjoint (first, last).

    Hashes of all chunks, over those of their lines, are counted first, in narrow rows; only chunks whose hash repeats
    are read as text, and grouped by it, which compares their bytes. A chunk's first place, by id, text hash and line,
    stays.
    """
    rows = docs.select(F.col(id_col).alias("_tm_id"), F.xxhash64(text_col).alias("_tm_hash"), F.col(text_col).alias("text")).filter(F.col("text") != "")
    lined = rows.withColumn("lines", F.split("text", "\n")).select("_tm_id", "_tm_hash", F.transform("lines", line_hash).alias("hashes"), F.transform("lines", _words).alias("words"), F.transform("lines", lambda x: F.xxhash64(x)).alias("names"))
    # Sizes and names are made within the array, so that no row of a chunk drags its text's arrays along.
    total = lambda c: F.aggregate(part(F.col("words"), c["first"], c["last"]), F.lit(0), lambda s, w: s + w)
    sized = F.transform(chunks(F.col("hashes"), F.col("words"), classes), lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"), total(c).alias("words")))
    worth = lambda c: ((c["last"] > c["first"] + LEAST_LINES - 2) & (c["words"] >= LEAST_WORDS)) | (c["words"] >= MANY_WORDS)
    named = F.transform(F.filter(sized, worth), lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"), F.xxhash64(part(F.col("names"), c["first"], c["last"])).alias("chunk")))
    found = work.saved(lined.select("_tm_id", "_tm_hash", F.explode(named).alias("c")).select("_tm_id", "_tm_hash", F.struct("c.first", "c.last").alias("c"), "c.chunk"), "chunks")
    again = work.saved(found.groupBy("chunk").agg(F.count("*").alias("times")).filter("times > 1").select("chunk"), "again")
    maybe = found.join(again, "chunk").groupBy("_tm_id", "_tm_hash").agg(F.sort_array(F.collect_set("c")).alias("some"))
    same = [rows["_tm_id"].eqNullSafe(maybe["_tm_id"]), rows["_tm_hash"] == maybe["_tm_hash"]]
    # What repeats grows with the input, so documents meet it in a shuffle join at every size, never a broadcast one.
    body = F.transform("some", lambda c: F.struct(c.alias("c"), F.array_join(part(F.col("lines"), c["first"], c["last"]), "\n").alias("body")))
    texts = rows.join(maybe.hint("merge"), same).select(rows["_tm_id"], rows["_tm_hash"], "some", F.split("text", "\n").alias("lines"))
    texts = texts.select("_tm_id", "_tm_hash", F.explode(body).alias("b")).select("_tm_id", "_tm_hash", "b.c", "b.body")
    texts = work.saved(texts, "texts")  # bodies of repeated hashes alone; read twice
    place = F.struct(F.col("_tm_id").isNotNull().alias("known"), "_tm_id", "_tm_hash", "c")
    # Grouped by the bytes; the text itself goes no further, each group is named by two hashes and its length.
    name = [F.xxhash64("body").alias("chunk"), F.md5(F.col("body").cast("binary")).alias("digest"), F.length("body").alias("size")]
    firsts = texts.groupBy("body").agg(F.count("*").alias("times"), F.min(place).alias("first")).filter("times > 1").select(*name, "first")
    firsts = work.saved(firsts, "firsts")
    gone = texts.select("_tm_id", "_tm_hash", "c", *name).join(firsts, ["chunk", "digest", "size"]).filter(~place.eqNullSafe(F.col("first")))
    lines = gone.select("_tm_id", "_tm_hash", F.explode(F.sequence("c.first", "c.last")).alias("line")).distinct()
    run = F.col("line") - F.row_number().over(Window.partitionBy("_tm_id", "_tm_hash").orderBy("line"))
    spans = lines.withColumn("run", run).groupBy("_tm_id", "_tm_hash", "run").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    return spans.groupBy("_tm_id", "_tm_hash").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("_tm_drop"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_cols: tuple[str, str] | None = None, drop_empty: bool = True) -> DataFrame:
    """The documents without repeated chunks of lines; all columns are kept, text is rewritten.

    A chunk counts if it has LEAST_LINES lines and LEAST_WORDS words, or MANY_WORDS words. A line goes if it lies in any
    chunk whose first place is another; an equal line at that place, or at one before it, stays. Null and empty texts
    stay as they are. Documents that lose all their lines go, unless drop_empty is false. Rows that repeat both id and
    text count as one document: they keep and lose the same lines. Null ids come first in the order of places.
    count_cols names two columns to add: lines kept and lines removed.
    """
    with Scratch(docs.sparkSession) as work:
        gone, _ = saved(repeated_lines(docs, id_col, text_col, work), "gone")
    marked = docs.select("*", F.xxhash64(text_col).alias("_tm_key"))
    joined = marked.join(gone.hint("merge"), marked[id_col].eqNullSafe(gone["_tm_id"]) & (marked["_tm_key"] == gone["_tm_hash"]) & F.col(text_col).isNotNull(), "left")
    joined = joined.withColumn("_tm_lines", F.split(F.col(text_col), "\n"))
    lines, n, drop = F.col("_tm_lines"), F.size("_tm_lines"), F.col("_tm_drop")
    starts = F.concat(F.array(F.lit(1)), F.transform(drop, lambda c: c["last"] + 1))
    ends = F.concat(F.transform(drop, lambda c: c["first"] - 1), F.array(n))
    gaps = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda g: g["a"] <= g["b"])
    hit = drop.isNotNull()
    text = F.when(hit, F.array_join(F.transform(gaps, lambda g: F.array_join(part(lines, g["a"], g["b"]), "\n")), "\n")).otherwise(F.col(text_col))
    removed = F.coalesce(F.aggregate(drop, F.lit(0), lambda s, c: s + c["last"] - c["first"] + 1), F.lit(0)).cast("long")
    total = F.when(F.coalesce(F.col(text_col), F.lit("")) == "", 0).otherwise(n).cast("long")
    extra = [] if count_cols is None else [(total - removed).alias(count_cols[0]), removed.alias(count_cols[1])]
    if drop_empty:
        joined = joined.filter(~hit | (removed < total))
    return joined.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns], *extra)


def oracle() -> str:
    """DuckDB SQL for the digest of dedup_lines over `documents` with unique ids."""
    return f"""
WITH rows AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''),
placed AS (SELECT doc_id, len(lines) AS n, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM rows),
hashed AS (SELECT doc_id, n, i, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, len(list_filter(regexp_split_to_array(line, '[ \\t\\r\\n]+'), lambda w: w <> '')) AS words FROM placed),
rolled AS (SELECT *, (lag(h) OVER (PARTITION BY doc_id ORDER BY i) * {BASE} + h) % {MODULUS} % {CLASSES} AS class FROM hashed),
classed AS (SELECT doc_id, n, i, class FROM rolled WHERE i > 1
  UNION ALL SELECT doc_id, len(lines), NULL, unnest(range({CLASSES})) FROM rows),
spans AS (SELECT doc_id, coalesce(lag(i) OVER (PARTITION BY doc_id, class ORDER BY i NULLS LAST) - 1, 1) AS first, coalesce(i, n) AS last FROM classed
  UNION SELECT doc_id, i, i FROM hashed WHERE words >= {MANY_WORDS}),
counted AS (SELECT doc_id, list(words ORDER BY i) AS words FROM hashed GROUP BY doc_id),
bodies AS (SELECT doc_id, first, last, array_to_string(lines[first:last], chr(10)) AS body, list_sum(words[first:last]) AS words FROM spans JOIN rows USING (doc_id) JOIN counted USING (doc_id)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first, last) AS nth FROM bodies
  WHERE (last - first + 1 >= {LEAST_LINES} AND words >= {LEAST_WORDS}) OR words >= {MANY_WORDS}),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM numbered WHERE nth > 1),
kept AS (SELECT p.* FROM placed p ANTI JOIN gone g USING (doc_id, i)),
texts AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM kept GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(t.n, 0) AS BIGINT) AS lines_kept,
  CAST(CASE WHEN coalesce(d.text, '') = '' THEN 0 ELSE len(string_split(d.text, chr(10))) END - coalesce(t.n, 0) AS BIGINT) AS lines_removed,
  md5(coalesce(t.text, '')) AS text_md5
FROM documents d LEFT JOIN texts t USING (doc_id)"""
