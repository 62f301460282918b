"""Elements of XML files as rows, with what encloses them, so that nested ones are joins and no patterns.

A file is read by a pull parser in the task that has its row, and its elements leave in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, nr bigint, up array<bigint>, around array<string>, tag string, attributes map<string,string>, text string"
#: Elements of a batch, and the deepest nesting that is read.
BATCH, DEEPEST = 4096, 200
#: The tag of a row that says why the rest of a file isn't read.
ERROR = "#error"


class _Refused(Exception):
    """What this reader doesn't read although it may be well formed."""


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def _parse(path: str, text: str) -> Iterator[tuple]:
    """Rows of one file, each as its element ends; one more, tagged ERROR, where reading ends before the file does."""
    done, open_ = [], []
    nr = 0
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(name, attributes):
        nonlocal nr
        if len(open_) == DEEPEST:
            raise _Refused(f"nested deeper than {DEEPEST}")
        open_.append((nr, [e[0] for e in open_], [e[3] for e in open_], _local(name), {_local(k): v for k, v in attributes.items() if k.partition(":")[0] != "xmlns"}, []))
        nr += 1

    def end(name):
        at, up, around, tag, attributes, said = open_.pop()
        done.append((path, at, up, around, tag, attributes, "".join(said).strip()))

    def refuse(*_):
        raise _Refused("declares entities")

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: open_[-1][5].append(data)
    parser.EntityDeclHandler = refuse
    try:
        for i in range(0, len(text), 1 << 16):
            parser.Parse(text[i : i + (1 << 16)], False)
            yield from done
            done.clear()
        parser.Parse("", True)
    except (expat.ExpatError, _Refused) as error:
        done.append((path, nr, [e[0] for e in open_], [e[3] for e in open_], ERROR, {}, str(error)))
    yield from done


def elements(texts: DataFrame) -> DataFrame:
    """(path, nr, up, around, tag, attributes, text) of every element of files (path, text).

    nr counts start tags of a file from 0; up are the numbers of the elements around it, outermost first, around their tags. Names are
    without their prefixes and declarations of these left out, text is what stands directly inside, trimmed. No DTD is fetched. Where a file is malformed,
    declares entities or nests deeper than DEEPEST, the elements ended before stay and a row tagged ERROR says why; its
    `up` are those that were open. A null or empty text gives no row.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        held = []
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                for row in _parse(path, text):
                    held.append(row)
                    if len(held) == BATCH:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
        if held:
            yield pd.DataFrame(held, columns=columns)

    return texts.select("path", "text").filter("text <> ''").mapInPandas(rows, SCHEMA)


def enclosed(inner: DataFrame, outer: DataFrame, name: str) -> DataFrame:
    """inner (path, nr, up and more) with the number of its nearest element among outer (path, nr) as `name`, or null."""
    around = inner.select("path", "nr", F.explode("up").alias("_o")).join(outer.select("path", F.col("nr").alias("_o")).distinct(), ["path", "_o"], "left_semi")
    return inner.join(around.groupBy("path", "nr").agg(F.max("_o").alias(name)), ["path", "nr"], "left")


def nearest(*tags: str) -> Column:
    """The number of the nearest element with one of these tags around a row of elements(), or null; needs no join."""
    held = F.filter(F.arrays_zip("up", "around"), lambda e: e["around"].isin(*tags))
    return F.try_element_at(held, F.lit(-1))["up"]
