"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text's byte n-grams, within and across word ends, are hashed to buckets; the mean of their embeddings goes through a
softmax. Held-back training documents set a temperature, so that scores are probabilities. A softmax is sure of what it
has never seen, too, so rejection has a measure of its own: how usual a text's n-grams are in the predicted language, as
the mean logarithm of their shares in training, in standard deviations of held-back texts of its length. Its threshold
is calibrated on held-back clean passages and on passages that are no language of the model.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets, embedding width and n-gram lengths.
BUCKETS, WIDTH, GRAMS = 1 << 14, 16, (1, 2, 3, 4)
#: Documents of each language that training reads, about; twice this bounds what the driver holds. Steps of id hashes.
PER_LANG, SCALE = 400, 1_000_000_000
#: Languages that are learnt at most.
LANGS = 256
EPOCHS, BATCH, RATE = 6, 32, 2.0
#: Share of held-back clean passages that may be rejected, and standard deviations that a text may always be off.
REJECT_SHARE, TOLERANCE = 0.001, 6.0
#: Up to so many n-grams a text's mean gets steadier with its length.
STEADY = 2_000
UNKNOWN = "und"
#: Bytes of a text whose n-grams are counted at once.
CHUNK = 1 << 20
#: Everything in ASCII that is no letter ends a word.
_WORDS = bytes(b if chr(b).isalpha() or b >= 128 else 32 for b in range(256))


def counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the n-grams of the whole text, lower-cased, other than letters as spaces."""
    found = np.zeros(BUCKETS, np.int64)
    raw = b" " + b" ".join(text.lower().encode().translate(_WORDS).split()) + b" "
    longest = max(GRAMS)
    for at in range(0, max(1, len(raw) - 1), CHUNK):
        part = np.frombuffer(raw[at : at + CHUNK + longest - 1], np.uint8).astype(np.uint32)
        rolled = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            here = len(part) - n + 1
            if here <= 0:
                break
            rolled = rolled[:here] * np.uint32(0x01000193) + part[n - 1 :] + np.uint32(1)
            if n in GRAMS:
                mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                found += np.bincount((mixed[: min(here, CHUNK)] >> np.uint32(18)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    return found


@dataclass
class Model:
    """embeddings: buckets x width, weights: width x languages, bias; languages sorted; temperature.

    usual: languages x buckets, logarithms of shares in training. level and spread: mean and standard deviation of how
    usual held-back texts of each language are (spread: of one n-gram). floor: standard deviations that texts may be off.
    """

    langs: list[str]
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    usual: np.ndarray | None = None
    level: np.ndarray | None = None
    spread: np.ndarray | None = None
    floor: float = -TOLERANCE

    def logits(self, bags: np.ndarray) -> np.ndarray:
        """bags: rows of bucket shares."""
        return bags @ self.embeddings @ self.weights + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score and whether the prediction is rejected."""
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        bag = counts(text)
        n = int(bag.sum())
        share = (bag / n).astype(np.float32)
        p = softmax(self.logits(share[None]) / self.temperature)[0]
        best = int(np.argmax(p))
        return self.langs[best], min(1.0, float(p[best])), bool(self.oddness(share, n, best) < self.floor)

    def oddness(self, share: np.ndarray, n: int, lang: int) -> float:
        """How usual a text of n n-grams is in a language, in standard deviations from the mean of its own texts."""
        return float((share @ self.usual[lang] - self.level[lang]) * math.sqrt(min(n, STEADY)) / self.spread[lang])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _passages(text: str, rng: np.random.Generator) -> list[str]:
    """The whole text and three short passages, so that short texts are learnt too."""
    words = text.split()
    cuts = [" ".join(words[(at := int(rng.integers(0, len(words)))) : at + int(n)]) for n in rng.integers(2, 30, 3)]
    return [text, *cuts]


def fit(rows: list[tuple[str, str]], seed: int = 42) -> Model:
    """Trains on (text, language) pairs; every fifth document is held back for calibration."""
    rows = [(t, x) for t, x in sorted(set(rows)) if any(map(str.isalpha, t))]
    langs = sorted({x for _, x in rows})
    rng = np.random.default_rng(seed)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    model = Model(langs, (rng.standard_normal((BUCKETS, WIDTH)) * 0.1).astype(np.float32), np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32))
    if not langs:
        return model
    sets: list[list] = [[], []]
    for i, (text, lang) in enumerate(rows):
        for whole, p in enumerate(_passages(text, rng)):
            if any(map(str.isalpha, p)):
                c = counts(p)
                at = np.flatnonzero(c)
                sets[i % 5 == 4].append((at, (c[at] / c.sum()).astype(np.float32), langs.index(lang), whole == 0, int(c.sum()), p))
    learn, hold = sets[0], sets[1] or sets[0]

    def dense(some: list) -> tuple[np.ndarray, np.ndarray]:
        bags = np.zeros((len(some), BUCKETS), np.float32)
        for row, (at, share, *_) in zip(bags, some):
            row[at] = share
        return bags, np.array([s[2] for s in some])

    size = np.bincount([s[2] for s in learn], minlength=len(langs))
    weight = (len(learn) / np.maximum(size, 1) / len(langs)).astype(np.float32)  # rare languages count as much
    steps = EPOCHS * -(-len(learn) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(learn))
        for at in range(0, len(learn), BATCH):
            bags, truth = dense([learn[i] for i in order[at : at + BATCH]])
            hidden = bags @ model.embeddings
            error = softmax(hidden @ model.weights + model.bias)
            error[np.arange(len(truth)), truth] -= 1
            error *= weight[truth][:, None] / len(truth)
            rate = RATE * (1 - step / steps)
            back = error @ model.weights.T
            model.weights -= rate * (hidden.T @ error)
            model.bias -= 0.1 * rate * error.sum(axis=0)
            model.embeddings -= rate * 50 * (bags.T @ back)  # bags hold shares, so this gradient is small
            step += 1
    x, truth = [], []
    for at in range(0, len(hold), 256):
        bags, t = dense(hold[at : at + 256])
        x.append(model.logits(bags))
        truth.append(t)
    x, truth = np.concatenate(x), np.concatenate(truth)
    loss = lambda t: -np.log(np.maximum(softmax(x / t)[np.arange(len(truth)), truth], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    _calibrate(model, learn, hold, rng)
    return model


def foreign(text: str, rng: np.random.Generator) -> list[str]:
    """Three texts of no language of the model: letters in another order, random letters, and another script."""
    words = text.split()[:200]
    letters = np.array([c for w in words for c in w])
    sizes = np.cumsum([len(w) for w in words])[:-1]
    mixed = ["".join(w) for w in np.split(rng.permutation(letters), sizes)]
    junk = ["".join(w) for w in np.split(rng.choice(list("bcdfghjklmnpqrstvwxzaeiouy0123456789"), len(letters)), sizes)]
    first = int(rng.choice([0x370, 0x400, 0x5D0, 0x627, 0x904, 0x3041, 0x4E00, 0xAC00]))
    other = ["".join(chr(first + int(i)) for i in rng.integers(0, 24, len(w))) for w in words]
    return [" ".join(p) for p in (mixed, junk, other)]


def _calibrate(model: Model, learn: list, hold: list, rng: np.random.Generator) -> None:
    """Sets usual, level, spread and floor from sparse bags (buckets, shares, language, whether a whole text, n, text).

    The floor is where REJECT_SHARE of the held-back passages would go, or further off where texts of no language of the
    model leave a gap: half-way into it. It is never nearer than half of TOLERANCE.
    """
    langs = len(model.langs)
    seen = np.full((langs, BUCKETS), 0.05)
    for at, share, lang, _, n, _ in learn:
        seen[lang, at] += share * n
    model.usual = np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32)
    value = lambda at, share, lang: float(share @ model.usual[lang, at])
    model.level, model.spread = np.zeros(langs), np.ones(langs)
    own = lambda some, lang: [(value(at, share, lang), n) for at, share, x, _, n, _ in some if x == lang]
    for lang in range(langs):
        rows = np.array(own(hold, lang) or own(learn, lang))
        model.level[lang] = np.median(rows[:, 0])
        off = (rows[:, 0] - model.level[lang]) * np.sqrt(np.minimum(rows[:, 1], STEADY))
        model.spread[lang] = max(1e-6, 1.4826 * np.median(np.abs(off)))  # of most texts, whatever junk a few are
    odd = lambda at, share, n, lang: float((value(at, share, lang) - model.level[lang]) * math.sqrt(min(n, STEADY)) / model.spread[lang])
    clean = np.array([odd(at, share, n, lang) for at, share, lang, _, n, _ in hold])
    alien = []
    for _, _, _, whole, _, text in hold:
        for t in foreign(text, rng) if whole else []:
            if any(map(str.isalpha, t)):
                c = counts(t)
                share = (c / c.sum()).astype(np.float32)
                best = int(np.argmax(model.logits(share[None])[0]))
                alien.append(model.oddness(share, int(c.sum()), best))
    least = float(np.quantile(clean, REJECT_SHARE))
    gap = float(np.quantile(alien, 0.99)) if alien else -math.inf
    model.floor = min(-TOLERANCE / 2, (least + gap) / 2 if gap < least and math.isfinite(gap) else least)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, most: int = LANGS) -> Model:
    """Fits a model on about per_lang documents of each language (all of a smaller one), chosen by their ids' hashes.

    The `most` languages of most documents are learnt (ties: by name); that and twice per_lang for each bound what the
    driver gets. Rows whose id, text or language is null take no part.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_tm_id"), F.col(lang_col).cast("string").alias("_tm_lang"), F.col(text_col).alias("_tm_text"))
    known = known.withColumn("_tm_at", F.pmod(F.xxhash64("_tm_id"), F.lit(SCALE)))
    sizes = known.groupBy("_tm_lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "_tm_lang").limit(most).collect()
    if not sizes:
        return fit([])
    share = {r["_tm_lang"]: min(SCALE, math.ceil(SCALE * per_lang / r["n"])) for r in sizes}
    upto = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("_tm_lang")]
    rows = known.filter(F.col("_tm_at") < upto).select("_tm_text", "_tm_lang").limit(2 * per_lang * len(sizes)).collect()
    return fit([(r[0], r[1]) for r in rows])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds the column _tm_found: lang_pred, score (0 to 1) and rejected.

    They are `und`, 0 and true for null texts and those without a letter.
    """

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def of(texts: pa.Array) -> pa.Array:
        found = [model.predict(t) for t in texts.to_pylist()]
        lang, score, rejected = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "rejected"])

    return docs.withColumn("_tm_found", of(F.col(text_col)))


def held_out(id_col: str = "doc_id"):
    """The documents that training must not see: crc32 of the id as text leaves 2 over four; a null id is not one."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: the id, held_out, lang_pred, score and rejected.

    The model learns from text and language of documents that aren't held out; predictions see the text alone. Without
    any labelled row all predictions are `und`. Repeated rows stay repeated, other columns are ignored.
    """
    model = train(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col), held_out(id_col).alias("_tm_held"), F.col(text_col).alias("_tm_text"))
    return predict(rows, model, "_tm_text").select(F.col(id_col), F.col("_tm_held").alias("held_out"), "_tm_found.*")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is not rejected, with their own columns, whatever their names; repeated rows stay."""
    model = train(docs.filter(~held_out(id_col)), id_col, text_col, lang_col)
    return predict(docs, model, text_col).filter(~F.col("_tm_found.rejected")).select(*docs.columns)


def accuracy(predicted: Iterator[tuple[str, str]]) -> float:
    """The share of equal (true, predicted) pairs."""
    pairs = list(predicted)
    return sum(a == b for a, b in pairs) / max(1, len(pairs))
