"""TF-IDF retrieval: single words and pairs without stop words, smoothed inverse document frequencies, cosine scores.
Also what a question asks for: names in it, intents, and what isn't answered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import cut

LEAST_SCORE, TOP, FEATURES = 0.05, 10, 5_000
#: Words that say nothing; a parameter of all functions. The most frequent of English.
STOP_WORDS = tuple(
    "a about after all also an and any are as at be been but by can could did do does for from had has have he her his how i if in into is it its"
    " just like me more most my no not of on one only or other our out over she so some such than that the their them then there these they this"
    " those to too under up us was we were what when where which while who why will with would you your".split()
)


#: Pairs of words are first counted by so many hash values.
CELLS = 1 << 20


def _words(text_col: str, stop: tuple[str, ...]) -> Column:
    return F.filter(F.split(F.lower(text_col), "[^a-z]+"), lambda w: (F.length(w) >= 2) & ~w.isin(*stop))


def _pairs(words: str) -> Column:
    most = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), most), F.slice(words, F.lit(2), most), lambda a, b: F.concat_ws(" ", a, b))


def occurrences(df: DataFrame, id_col: str, text_col: str = "text", stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(id, term): words of two ASCII letters and more in lower case, without stop words, and pairs of neighbours."""
    return df.select(F.col(id_col).alias("id"), _words(text_col, stop).alias("words")).select("id", F.explode(F.concat("words", _pairs("words"))).alias("term"))


def terms(df: DataFrame, id_col: str, text_col: str = "text", stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(id, term, tf) of occurrences()."""
    return occurrences(df, id_col, text_col, stop).groupBy("id", "term").agg(F.count("*").alias("tf"))


def vocabulary(docs: DataFrame, features: int, text_col: str = "text", stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(term, t): the `features` most frequent terms (ties: by term), numbered from 0.

    Words are counted outright. A pair is only counted if all pairs of its hash value together occur as often as the last
    word that would be chosen, for else `features` words come before it.
    """
    held = docs.select(_words(text_col, stop).alias("words"))
    words = cut(held.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("times")))
    last = words.orderBy(F.desc("times"), "term").limit(features).agg(F.count("*").alias("n"), F.min("times").alias("least")).first()
    pairs = held.select(F.explode(_pairs("words")).alias("term")).withColumn("cell", F.pmod(F.xxhash64("term"), F.lit(CELLS)).cast("int"))
    if last["n"] == features:
        often = pairs.groupBy("cell").agg(F.count("*").alias("times")).filter(F.col("times") >= last["least"]).select("cell")
        pairs = pairs.join(F.broadcast(often), "cell", "left_semi")  # CELLS rows at most
    times = words.unionByName(pairs.groupBy("term").agg(F.count("*").alias("times")))
    chosen = times.orderBy(F.desc("times"), "term").limit(features)
    return cut(chosen.select("term", (F.row_number().over(Window.orderBy(F.desc("times"), "term")) - 1).alias("t")))


def tfidf_topk(queries: DataFrame, query_id: str, docs: DataFrame, doc_id: str, k: int = TOP, least: float = LEAST_SCORE, features: int = FEATURES) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query.

    Terms are the `features` most frequent of the documents (ties: by term), weights tf * (ln((1 + n) / (1 + df)) + 1).
    Only terms of queries are multiplied; other terms of a document count in its norm alone.
    """
    known = F.broadcast(vocabulary(docs, features))  # `features` rows at most
    # Only numbers of chosen terms are dealt out, once, by document; all below stays where its document is.
    d = occurrences(docs, doc_id).join(known, "term").select("id", "t").repartition("id").groupBy("id", "t").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    idf = cut(d.groupBy("t").agg(F.count("*").alias("df")).crossJoin(n).select("t", (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    weighted = d.join(F.broadcast(idf), "t").withColumn("w", F.col("tf") * F.col("idf"))
    asked = occurrences(queries, query_id).join(known, "term").groupBy("id", "t").agg(F.count("*").alias("tf"))
    q = asked.join(F.broadcast(idf), "t").select(F.col("id").alias("q"), "t", (F.col("tf") * F.col("idf")).alias("qw"))
    normed = q.withColumn("qn", F.sqrt(F.sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("q"))))
    # One row a document: its norm and its weights of at most `features` terms.
    held = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"), F.collect_list(F.struct("t", "w")).alias("ws"))
    flat = held.select("id", "dn", F.explode("ws").alias("x")).select("id", "dn", "x.*")
    dots = flat.join(normed, "t").groupBy("q", "id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.any_value("dn").alias("dn"), F.any_value("qn").alias("qn"))
    scored = dots.select("q", "id", F.round(F.col("dot") / (F.col("dn") * F.col("qn")), 6).alias("score")).filter(F.col("score") > least)
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("id").alias("doc_id"), "score", "rank")


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    words = lambda c, t: f"SELECT {c} AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) >= 2 AND w NOT IN ({stop})) AS ws FROM {t}"
    grams = lambda t: f"SELECT id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: concat(ws[i], ' ', ws[i + 1])))) AS term FROM {t}"
    return f"""
WITH dl AS ({words("doc_id", "documents")}), dw AS ({grams("dl")}), d AS (SELECT id, term, COUNT(*) AS tf FROM dw GROUP BY id, term), ql AS ({words("item_id", "benchmark")}), qw0 AS ({grams("ql")}),
idf AS (SELECT term, ln((1 + (SELECT COUNT(*) FROM documents))::DOUBLE / (1 + COUNT(*))) + 1 AS idf FROM d GROUP BY term ORDER BY SUM(tf) DESC, term LIMIT {FEATURES}),
w AS (SELECT id, term, tf * idf AS w FROM d JOIN idf USING (term)), q AS (SELECT id AS q, term, COUNT(*) * any_value(idf) AS qw FROM qw0 JOIN idf USING (term) GROUP BY id, term),
dn AS (SELECT id, sqrt(SUM(w * w)) AS dn FROM w GROUP BY id), qn AS (SELECT q, sqrt(SUM(qw * qw)) AS qn FROM q GROUP BY q),
s AS (SELECT q, id, ROUND(SUM(w * qw) / (any_value(dn) * any_value(qn)), 6) AS score FROM w JOIN q USING (term) JOIN dn USING (id) JOIN qn USING (q) GROUP BY q, id)
SELECT q AS query_id, id AS doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s WHERE score > {LEAST_SCORE}) WHERE rank <= {TOP}"""


ORACLE = _oracle()

#: Questions that aren't answered, and words that tell an intent with its confidence, in this order.
REFUSED = ("ceo.*favorite", "password", "private key", "pii", "encryption key", "secret", "unicorn_fact", "predict.*revenue", "highest paid", "hr schema", "snowflake.*private")
INTENTS = (
    ("wedge", ("recommend", "wedge", "migrate first", "should we migrate"), 0.85),
    ("impact", ("what breaks", "impact", "blast radius", "downstream", "if i drop", "if i change", "depends on", "what depends"), 0.9),
    ("lineage", ("feeds", "upstream", "lineage", "what feeds", "which tables does", "what does", "which views", "which dashboards"), 0.9),
    ("orphan", ("orphan", "unused", "dead code"), 0.9),
    ("hot", ("hot", "most depended"), 0.9),
    ("complex", ("complex", "riskiest"), 0.9),
)


def refused(question: Column) -> Column:
    """Whether a question asks for what is never told."""
    return F.coalesce(reduce(lambda a, b: a | b, [F.lower(question).rlike(p) for p in REFUSED]), F.lit(False))


def intent(question: Column) -> Column:
    """(intent, confidence) of a question: the first whose words it holds, else `vague` at 0.5."""
    q, out = F.lower(question), F.struct(F.lit("vague").alias("intent"), F.lit(0.5).alias("confidence"))
    for name, words, sure in reversed(INTENTS):
        hit = reduce(lambda a, b: a | b, [q.contains(w) for w in words])
        out = F.when(hit, F.struct(F.lit(name).alias("intent"), F.lit(sure).alias("confidence"))).otherwise(out)
    return out


def named_objects(questions: DataFrame, objects: DataFrame, most: int = 10) -> DataFrame:
    """(id, fqn, how): objects (fqn) that questions (id, text) name, in full, by leaf name, or by a part of over 3 letters.

    A question's words meet objects' names in a join. Only the best way that finds anything counts for a question, and
    of the `most` first names by alphabet.
    """
    words = questions.select("id", F.explode(F.array_distinct(F.split(F.upper("text"), r"[^A-Z0-9_.]+"))).alias("w")).withColumn("w", F.regexp_replace("w", r"^\.+|\.+$", "")).filter("w <> ''")
    full = objects.select("fqn", F.upper("fqn").alias("w"), F.lit(1).alias("how"))
    leaf = objects.select("fqn", F.upper(F.substring_index("fqn", ".", -1)).alias("w"), F.lit(2).alias("how"))
    part = objects.select("fqn", F.explode(F.array_distinct(F.split(F.upper("fqn"), "[_.]"))).alias("w"), F.lit(3).alias("how")).filter(F.length("w") > 3)
    pieces = words.select("id", F.explode(F.array_distinct(F.array_append(F.split("w", "[_.]"), F.col("w")))).alias("w")).distinct()
    met = words.join(full.unionByName(leaf), "w").unionByName(pieces.join(part, "w")).groupBy("id", "fqn").agg(F.min("how").alias("how"))
    best = met.withColumn("best", F.min("how").over(Window.partitionBy("id"))).filter("how = best")
    n = F.row_number().over(Window.partitionBy("id").orderBy("fqn"))
    said = F.element_at(F.array(F.lit("full"), F.lit("leaf"), F.lit("part")), F.col("how"))
    return best.withColumn("n", n).filter(F.col("n") <= most).select("id", "fqn", said.alias("how"))
