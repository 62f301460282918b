"""Mining phrases that stick together, by pivot partitioning: each n-gram is counted where its rarest word is at home.

A first pass counts words. Which words are frequent, and which of two is the rarer, goes to all tasks as a sketch of
fixed size: exact counts of frequent words, added up in WIDTH cells by hash. Cells that two words share make a word look
more frequent than it is; that makes work and changes no result, for every n-gram of frequent words still has exactly one
rarest word by (estimate, word), the same in every task.

A second pass counts pairs, a third one all longer phrases, for which texts are also cut between two words that are no
frequent pair (as a bitmap of fixed size tells, which may take more pairs for frequent, never less). Both rewrite texts
to fragments: a frequent word with up to `longest` - 1 neighbours on either side, cut off at the end of its piece, at
rarer words, and on the left at the same word, so that an n-gram that holds its pivot twice belongs to the first of them
alone. Fragments go to their pivot's partition, where all n-grams through the pivot are counted. A pivot of very many
occurrences has several partitions: an n-gram goes by the word after its pivot, or, if it ends there, by the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, runs_of, saved

#: Longest phrases, least count, phrases a language in a report, and the least share (%) of a phrase's occurrences
#: within a longer one that drops it.
LONGEST, LEAST, BEST, WITHIN = 5, 100, 2000, 100
#: Cells of the sketch of frequent words.
WIDTH = 2**20
#: Bits of the bitmap of frequent pairs.
BITS = 2**22
#: Occurrences of a pivot in one partition, and n-grams that a task holds at once.
HOT, HELD = 2**16, 2_000_000
#: Bytes of text that a task takes apart at once.
BYTES = 4_000_000

#: What a partition of fragments is of.
KEY = ("lang", "home", "part")

#: What parts pieces becomes END, what parts words a space, A-Z become a-z; END occurs in no UTF-8.
END = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\x09.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz " + END * 10)


def _tokens(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    """Words and ENDs of texts, in parts of about `most` bytes; a part ends between words."""
    for a, b in runs_of([len(t) for t in texts], most):
        whole, at = END.join(texts[a:b]).translate(_TABLE), 0
        while at < len(whole):
            to = at + most
            if to < len(whole):
                cuts = [c for c in (whole.find(b" ", to), whole.find(END, to)) if c >= 0]
                to = min(cuts, default=len(whole))
            found = whole[at:to].replace(END, b" \xff ").split()
            if found:
                yield found
            at = to
        yield [END]


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of each batch by language; columns lang and text."""
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        langs = batch.column("lang").dictionary_encode()
        codes = langs.indices.to_numpy()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, texts.take(pa.array(np.flatnonzero(codes == i))).to_pylist()


def _encoded(tokens: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    found = pa.array(tokens, pa.binary()).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy()


def _words(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """lang, word, n: what each part of a batch holds."""
        for lang, texts in _by_lang(batches):
            for tokens in _tokens(texts, most):
                words, codes = _encoded(tokens)
                counts = np.bincount(codes, minlength=len(words))
                kept = [i for i, w in enumerate(words) if w != END]
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(kept)), pa.array([words[i] for i in kept], pa.binary()).cast(pa.string()), pa.array(counts[kept])], names=["lang", "word", "n"])

    return run


def _hash(lang: bytes, word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang + END + word)


def _pair(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The bit of each pair of words, by their hashes."""
    mixed = (first * np.uint64(0x9E3779B97F4A7C15) + second) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(bits)).astype(np.int64)


def _bitmap(pairs: DataFrame, bits: int) -> np.ndarray:
    """Which bits frequent pairs (lang, phrase) have, as bytes of eight bits; at most bits / 32 rows reach the driver."""
    @F.arrow_udf("long")
    def places(langs: pa.Array, phrases: pa.Array) -> pa.Array:
        hashes = [[_hash(a.as_py(), w) for w in b.as_py().split(b" ")] for a, b in zip(langs.cast(pa.binary()), phrases.cast(pa.binary()))]
        both = np.asarray(hashes, np.uint64).reshape(-1, 2)
        return pa.array(_pair(both[:, 0], both[:, 1], bits))

    at = pairs.select(places("lang", "phrase").alias("at"))
    words = at.groupBy(F.expr("at div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 32 AS INT))")).alias("set"))
    out = np.zeros(-(-bits // 32), np.uint32)
    for r in words.toLocalIterator():
        out[r["word"]] = r["set"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _sketch(frequent: DataFrame, width: int) -> np.ndarray:
    """Counts of frequent words (lang, word, n), added up by cell; at most `width` rows reach the driver."""
    @F.arrow_udf("long")
    def cells(langs: pa.Array, words: pa.Array) -> pa.Array:
        return pa.array([_hash(a.as_py(), b.as_py()) % width for a, b in zip(langs.cast(pa.binary()), words.cast(pa.binary()))], pa.int64())

    out = np.zeros(width, np.int64)
    for r in frequent.select(cells("lang", "word").alias("cell"), "n").groupBy("cell").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["cell"]] = r["n"]
    return out


def fragments_of(rank: np.ndarray, linked: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """How many neighbours each position has to its left and right in the fragment that it is the pivot of.

    rank: of each position, -1 where nothing may go through (ends, rare words); a larger rank is a more frequent word.
    linked: whether a position and the next one may be within an n-gram.
    """
    n, ahead = len(rank), longest - 1
    pad = lambda x, end: np.concatenate([np.full(ahead, end), x, np.full(ahead + 1, end)])
    wide, link = pad(rank, -1), pad(linked, False)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    on_left, on_right = rank >= 0, rank >= 0
    for step in range(1, ahead + 1):
        on_left = on_left & (wide[ahead - step : ahead - step + n] > rank) & link[ahead - step : ahead - step + n]
        on_right = on_right & (wide[ahead + step : ahead + step + n] >= rank) & link[ahead + step - 1 : ahead + step - 1 + n]
        left += on_left
        right += on_right
    return left, right


def _fragments(sketch, bitmap, least: int, shortest: int, longest: int, hot: int, most: int):
    """lang, home, part, after, left, words and n of a batch's distinct fragments; sketch and bitmap are broadcast variables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, ahead = sketch.value, longest - 1
        for lang, texts in _by_lang(batches):
            said, kept, cache = lang.encode(), [], {}
            for tokens in _tokens(texts, most):
                # The last words of a part are pivots together with the next part, which repeats what stands before them.
                context = max(0, len(kept) - ahead)
                tokens, ended = kept + tokens, tokens[-1] == END
                words, codes = _encoded(tokens)
                hashes = np.asarray([cache[w] if w in cache else cache.setdefault(w, _hash(said, w)) for w in words], np.uint64)
                count = cells[(hashes % np.uint64(len(cells))).astype(np.int64)]
                count[[i for i, w in enumerate(words) if w == END]] = 0
                order = sorted(np.flatnonzero(count >= least), key=lambda i: (count[i], words[i]))
                rank = np.full(len(words), -1)
                rank[order] = np.arange(len(order))
                linked = np.ones(len(codes), bool)
                if bitmap is not None:
                    linked[:-1] = bitmap.value[_pair(hashes[codes[:-1]], hashes[codes[1:]], len(bitmap.value))]
                left, right = fragments_of(rank[codes], linked, longest)
                pivots = np.arange(len(codes))
                own = (left + right + 1 >= shortest) & (pivots >= context) & ((pivots < len(codes) - ahead) | ended)
                kept = [] if ended else tokens[-2 * ahead :]
                if own.any():
                    at = np.flatnonzero(own)
                    yield _distinct(lang, words, codes, hashes, -(-count // hot), left[at], right[at], at)
                if len(cache) > 1_000_000:
                    cache = {}

    return run


def _distinct(lang: str, words: list[bytes], codes: np.ndarray, hashes: np.ndarray, parts: np.ndarray, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """The fragments around the positions `at`, equal ones added up; hot pivots have two of each, for both sides."""
    n = parts[codes[at]]
    beside = lambda step: (hashes[codes[np.clip(at + step, 0, len(codes) - 1)]] % np.maximum(n, 1).astype(np.uint64)).astype(np.int64)
    one, before, after = np.flatnonzero(n <= 1), np.flatnonzero((n > 1) & (left > 0)), np.flatnonzero((n > 1) & (right > 0))
    part = np.concatenate([np.zeros(len(one), np.int64), beside(-1)[before], beside(1)[after]])
    right = np.concatenate([right[one], np.zeros(len(before), np.int64), right[after]])
    only = np.repeat([0, 0, 1], [len(one), len(before), len(after)])
    rows = np.concatenate([one, before, after])
    left, at = left[rows], at[rows]
    sizes = left + right + 1
    ends = np.cumsum(sizes)
    places = np.arange(ends[-1]) + np.repeat(at - left - ends + sizes, sizes)
    said = pa.array(words, pa.binary())
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), said.take(pa.array(codes[places])))
    table = pa.table([pa.array(hashes[codes[at]].view(np.int64)), pa.array(part.astype(np.int32)), pa.array(only.astype(np.int32)), pa.array(left.astype(np.int32)), pc.binary_join(lists, b" ").cast(pa.string())], names=["home", "part", "after", "left", "words"])
    found = table.group_by(table.column_names, use_threads=False).aggregate([([], "count_all")]).combine_chunks()
    return pa.RecordBatch.from_arrays([pa.repeat(lang, found.num_rows), *(found.column(c).combine_chunks() for c in (*table.column_names, "count_all"))], names=["lang", *table.column_names, "n"])


def _expanded(batch: pa.RecordBatch, run_of: np.ndarray, shortest: int, longest: int) -> pa.Table:
    """run, phrase, words and f: the n-grams through each fragment's pivot (after: none that end there), added up by run."""
    split = pc.split_pattern(batch.column("words"), " ")
    values, starts, sizes = split.flatten(), split.offsets.to_numpy()[:-1] - split.offsets[0].as_py(), pc.list_value_length(split).to_numpy()
    left, after = batch.column("left").to_numpy(), batch.column("after").to_numpy()
    rows, begins, lengths = [], [], []
    for m in range(shortest, longest + 1):
        for before in range(m):  # words of the n-gram that stand before its pivot
            fits = np.flatnonzero((left >= before) & (left - before + m <= sizes) & (before < m - after))
            rows.append(fits)
            begins.append((starts + left)[fits] - before)
            lengths.append(np.full(len(fits), m))
    rows, begins, lengths = map(np.concatenate, (rows, begins, lengths))
    ends = np.cumsum(lengths)
    places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + lengths, lengths)
    said = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values.take(pa.array(places))), " ")
    return _added(pa.table([pa.array(run_of[rows]), said, pa.array(lengths.astype(np.int32)), batch.column("n").take(pa.array(rows))], names=["run", "phrase", "words", "f"]))


def _added(grams: pa.Table) -> pa.Table:
    found = grams.group_by(["run", "phrase", "words"], use_threads=False).aggregate([("f", "sum")])
    return found.rename_columns(["run", "phrase", "words", "f"])


def _mine(least: int, shortest: int, longest: int, most: int = HELD):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fragments by KEY: the n-grams through each pivot with their counts.

        What is counted here is final, so that the less frequent n-grams go. Where one part of one pivot has over `most`
        n-grams, its counts so far are told, and from there on all of its counts, to be added up later.
        """
        key, held, open_ = None, [], False

        def told(grams: pa.Table, langs: pa.Array) -> pa.RecordBatch:
            names = ["phrase", "words", "f"]
            return pa.RecordBatch.from_arrays([langs, *(grams.column(c).combine_chunks() for c in names)], names=["lang", *names])

        def closed() -> Iterator[pa.RecordBatch]:
            if held:
                grams = _added(pa.concat_tables(held))
                grams = grams if open_ else grams.filter(pc.greater_equal(grams.column("f"), least))
                if grams.num_rows:
                    yield told(grams.combine_chunks(), pa.repeat(key[0], grams.num_rows))

        for batch in batches:
            if not batch.num_rows:
                continue
            run_of = _runs([batch.column(c) for c in KEY])
            firsts = np.searchsorted(run_of, np.arange(run_of[-1] + 1))
            of = lambda i: tuple(batch.column(c)[int(firsts[i])].as_py() for c in KEY)
            grams = _expanded(batch, run_of, shortest, longest)
            runs = grams.column("run").combine_chunks().to_numpy()
            if key != of(0):
                yield from closed()
                key, held, open_ = of(0), [], False
            held.append(_numbered(grams.filter(pa.array(runs == 0))))
            if sum(t.num_rows for t in held) > most:
                held = [_numbered(_added(pa.concat_tables(held)))]
                if 2 * held[0].num_rows > most:
                    open_ = True
                    yield from closed()
                    held = []
            last = len(firsts) - 1
            if last:
                yield from closed()
                inner = grams.filter(pc.and_(pa.array((runs > 0) & (runs < last)), pc.greater_equal(grams.column("f").combine_chunks(), least))).combine_chunks()
                if inner.num_rows:
                    yield told(inner, batch.column("lang").take(pa.array(firsts[inner.column("run").to_numpy()])))
                key, held, open_ = of(last), [_numbered(grams.filter(pa.array(runs == last)))], False
        yield from closed()

    return run


def _numbered(grams: pa.Table) -> pa.Table:
    """The n-grams of one run, whose number no longer matters."""
    return grams.set_column(0, "run", pa.array(np.zeros(grams.num_rows, np.int64)))


def _runs(columns: list[pa.Array]) -> np.ndarray:
    """Numbers that go up by one wherever a row differs from the one before."""
    change = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        change[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(change)


def counts(docs: DataFrame, work: Scratch, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text", width: int = WIDTH, bits: int = BITS, hot: int = HOT, at_once: int = BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to `longest` words with f >= least, and (lang, n) of all words."""
    spark = docs.sparkSession
    plain = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    per_word = work.saved(plain.mapInArrow(_words(at_once), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    totals = per_word.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = per_word.filter(F.col("n") >= least)
    sketch = spark.sparkContext.broadcast(_sketch(frequent, width))

    def mined(shortest: int, longest: int, bitmap, name: str) -> DataFrame:
        found = plain.mapInArrow(_fragments(sketch, bitmap, least, shortest, longest, hot, at_once), "lang string, home long, part int, after int, left int, words string, n long")
        routed = found.repartition(*KEY).sortWithinPartitions(*KEY)
        counted = routed.mapInArrow(_mine(least, shortest, longest), "lang string, phrase string, words int, f long")
        return work.saved(counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), name)

    known = frequent.select("lang", F.col("word").alias("phrase"), F.lit(1).alias("words"), F.col("n").alias("f"))
    if longest > 1:
        pairs = mined(2, 2, None, "pairs")
        known = known.unionByName(pairs)
        if longest > 2:
            known = known.unionByName(mined(3, longest, spark.sparkContext.broadcast(_bitmap(pairs, bits)), "longer"))
    return known, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, within: int = WITHIN, lang_col: str = "lang", text_col: str = "text", width: int = WIDTH, bits: int = BITS, hot: int = HOT, at_once: int = BYTES) -> DataFrame:
    """The `best` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A phrase is 2 to `longest` words of one piece (texts end pieces, and so do .,;:!? and line ends) that occur at least
    `least` times in its language; A-Z are lower-cased. a, l, r and n count the phrase, the two parts of its weakest cut
    and all words; score is floor(1000 * a * n / (l * r)), exactly. A phrase goes if a phrase with one word more holds it
    and has at least `within` % of its occurrences. Ties: larger a, then the smaller phrase in byte order. A null
    language is `und`; null, empty and wordless texts have no words; repeated rows count again; an empty table gives no
    rows; other columns are ignored.
    """
    with Scratch(docs.sparkSession) as work:
        known, totals = counts(docs, work, least, longest, lang_col, text_col, width, bits, hot, at_once)
        w = F.split("phrase", " ")
        candidates = known.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
        # A phrase within one that is longer by more is also within one between, which occurs no less.
        holds = candidates.select("lang", F.explode(F.array(F.array_join(F.slice(w, 1, F.col("words") - 1), " "), F.array_join(F.slice(w, 2, F.col("words") - 1), " "))).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        kept = candidates.join(holds, ["lang", "phrase"], "left").filter(f"longer IS NULL OR CAST(100 AS DECIMAL(20,0)) * longer < CAST({int(within)} AS DECIMAL(20,0)) * a")
        cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        cuts = cuts.withColumns({"first": F.array_join(F.slice(w, 1, F.col("k")), " "), "rest": F.array_join(F.slice(w, F.col("k") + 1, F.col("words")), " ")})
        part = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
        scored = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
        scored = scored.withColumn("score", F.expr("(CAST(1000 * CAST(a AS DECIMAL(16,0)) AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
        weakest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
        return saved(weakest.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= best).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")[0]


def oracle(least: int = LEAST, longest: int = LONGEST, best: int = BEST, within: int = WITHIN) -> str:
    """DuckDB SQL for collocations() of `documents`."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, list_filter(regexp_split_to_array(unnest(regexp_split_to_array({low}, '[.,;:!?\x0A-\x0D]')), '[\x20\x09]+'), lambda x: x <> '') AS w FROM documents),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM pieces, range(1, {longest + 1}) AS t(m) WHERE len(w) >= m) GROUP BY ALL HAVING count(*) >= {least}),
kept AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams g WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM grams h
  WHERE h.lang = g.lang AND h.m > g.m AND contains(concat(' ', h.phrase, ' '), concat(' ', g.phrase, ' ')) AND 100 * h.f >= {within} * g.f)),
cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:m], ' ') AS rest FROM kept, range(1, {longest}) AS t(k) WHERE k < m),
scored AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, k, CAST((1000 * CAST(a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.first JOIN grams y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM weakest QUALIFY rank <= {best}"""
