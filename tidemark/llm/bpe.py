"""Byte-pair encoding by backtracking, and decoding by an offset table.

A text is cut into words by the tokenizer's pattern. In each new word an Aho-Corasick automaton finds the longest token
at every place; the encoder takes it, checks it against the token before in a table of compatible pairs, and otherwise
falls back to the next shorter token or takes the last one back. No place is tried twice after it has failed, so the
time is linear in the word. Pairwise compatible tokens are exactly what the merges give.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER, runs_of, tokenizer_path

#: Words whose ids a worker remembers, and characters of new words that one automaton run covers.
WORDS_KEPT, CHUNK = 800_000, 4_000_000
#: Fixed value: how byte-level BPE cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same where all characters come before LATIN_END: letters, numbers and white space spelled out for Python's re.
LATIN_END = "\u0180"
LETTERS, NUMBERS, SPACES = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PATTERN = f" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: A character that stands in no token, between words in one automaton run.
BETWEEN = "Ā"


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class BytePairs:
    """A vocabulary with its automaton, pair table and offset table; texts in, ids as decimal strings out."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = _byte_alphabet(), spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])
        #: When a token is made: 0 for a single byte, else the number of its merge.
        self.made, self.parts, self.merged = [0] * size, [None] * size, {}
        for when, (left, right) in enumerate(merges, 1):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.merged[a, b] = when
            if self.parts[c] is None:
                self.made[c], self.parts[c] = when, (a, b)
        self.automaton = ahocorasick.Automaton()
        self.length = [len(s) for s in spelled]
        by_text = {spelled[i].decode("latin-1"): i for i in vocab.values()}
        for text, i in by_text.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        #: The next shorter token that begins a token, or -1.
        self.shorter = [-1] * size
        for text, i in by_text.items():
            self.shorter[i] = next((by_text[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in by_text), -1)
        self.words, self.latin = regex.compile(PATTERN), re.compile(LATIN_PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, str] = {}

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the merges ever leave b after a.

        It undoes the merges that made a and b, latest first, and looks at the two pieces that touch: had those merged
        before the undone merge, a and b would not both exist. Of equal merges the left one is done first.
        """
        found = self.pairs.get((a, b))
        if found is not None:
            return found
        x, y, limit, found = a, b, float("inf"), True
        while True:
            when = self.merged.get((x, y))
            if when is not None and when < limit:
                found = False
                break
            if self.made[x] > self.made[y]:
                limit, x = self.made[x], self.parts[x][1]
            elif self.made[y]:
                limit, y = self.made[y] + 0.5, self.parts[y][0]
            else:
                break
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        self.pairs[a, b] = found
        return found

    def _encode_word(self, longest: list[int], begin: int, end: int) -> list[int]:
        """longest: the longest token at each place; the word is places begin to end."""
        length, shorter, pairs, compatible = self.length, self.shorter, self.pairs, self._compatible
        out: list[int] = []
        failed: set[int] = set()
        at, token, last = begin, longest[begin], -1
        while at < end:
            while token >= 0:
                to = at + length[token]
                if last < 0 or (ok := pairs.get((last, token))) or ok is None and compatible(last, token):
                    if to not in failed:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, last, token = to, token, longest[to]
            else:
                failed.add(at)
                token = out.pop()
                at -= length[token]
                token, last = shorter[token], out[-1] if out else -1
        return out

    def _learn(self, words: list[str]) -> None:
        """Encodes new words, in one run of the automaton over all of them."""
        plain = [w if w.isascii() else w.encode().decode("latin-1") for w in words]
        joined = BETWEEN.join(plain)
        longest = [-1] * (len(joined) + 1)
        length, known, encode = self.length, self.known, self._encode_word
        for last, token in self.automaton.iter(joined):
            longest[last + 1 - length[token]] = token  # of one place, longer tokens end later
        at = 0
        for word, text in zip(words, plain):
            to = at + len(text)
            known[word] = ",".join(map(str, encode(longest, at, to)))
            at = to + 1

    def _words(self, text: str) -> list[list[str] | str]:
        """The words of the stretches between special tokens, and those tokens' ids."""
        if self.specials is not None and any(s in text for s in self.special):
            parts = [p for p in self.specials.split(text) if p]
            return [str(self.special[p]) if p in self.special else self._cut(p) for p in parts]
        return [self._cut(text)] if text else []

    def _cut(self, text: str) -> list[str]:
        return (self.latin if max(text) < LATIN_END else self.words).findall(text)

    def encode_all(self, texts: list[str]) -> list[str]:
        """Of each text the decimal ids joined by commas."""
        cut = [self._words(t) for t in texts]
        here = set().union(*[w for words in cut for w in words if not isinstance(w, str)])
        known = self.known
        if len(known) + len(here) > WORDS_KEPT:  # words of this batch stay
            known = self.known = {w: known[w] for w in here if w in known}
        missing = [w for w in here if w not in known]
        for a, b in runs_of([len(w) for w in missing], CHUNK):
            self._learn(missing[a:b])
        return [",".join([w if isinstance(w, str) else ",".join(map(known.__getitem__, w)) for w in words]) for words in cut]

    def encode(self, text: str) -> str:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens; what isn't UTF-8 is left to the caller."""
        begin = self.offsets[ids]
        size = self.offsets[ids + 1] - begin
        ends = np.cumsum(size)
        return self.flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


_loaded: dict[str, BytePairs] = {}


def byte_pairs(path: str) -> BytePairs:
    """The vocabulary in this worker, read once."""
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path]


def _ids(joined: str) -> np.ndarray:
    return np.fromstring(joined, dtype=np.int64, sep=",") if joined else np.empty(0, np.int64)


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER, out_col: str = "ids") -> DataFrame:
    """Adds the token ids of each whole text as array<int>; a null text has null ids, an empty one none."""
    path = tokenizer_path(tokenizer)

    @F.arrow_udf("array<int>")
    def of(texts: pa.Array) -> pa.Array:
        bpe = byte_pairs(path)
        raw = texts.to_pylist()
        return pa.array([None if t is None else _ids(ids).astype(np.int32) for t, ids in zip(raw, bpe.encode_all([t or "" for t in raw]))], pa.list_(pa.int32()))

    return docs.withColumn(out_col, of(F.col(text_col)))


def decode(docs: DataFrame, ids_col: str = "ids", tokenizer: str = TOKENIZER, out_col: str = "decoded") -> DataFrame:
    """Adds the text of each id list; bytes that are no UTF-8 become U+FFFD, special tokens stay as written."""
    path = tokenizer_path(tokenizer)

    @F.arrow_udf("string")
    def of(ids: pa.Array) -> pa.Array:
        bpe = byte_pairs(path)
        return pa.array([None if x is None else bpe.decode(np.asarray(x, np.int64)).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    return docs.withColumn(out_col, of(F.col(ids_col)))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Per document the digests of its ids and of the text they decode to.

    Returns the id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256 (of the decoded text
    in UTF-8). A null text counts as empty. Repeated rows stay repeated, other columns are ignored, no rows give none.
    """
    path = tokenizer_path(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_pairs(path)
        for batch in _batches(batches):
            n, ids_sha, text_sha = [], [], []
            for joined in bpe.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                ids = _ids(joined)
                back = bpe.decode(ids)
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
