"""Computed columns of a table's definition, made as it is read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .dialect import to_spark_sql

#: Texts in quotes, quoted names, and names; what stands in quotes of a text is no name.
_NAMES = re.compile(r"'(?:[^']|'')*'|\[([^\]]+)\]|\"([^\"]+)\"|`([^`]+)`|([A-Za-z_]\w*)")


class Circular(ValueError):
    """Columns that are computed from themselves."""


def _plain(expression: str) -> str:
    """An expression with its quoted names as Spark quotes them."""
    return _NAMES.sub(lambda m: m.group(0) if m.group(0)[0] not in '["' else f"`{m.group(1) or m.group(2)}`", expression)


def _joined(expression: str, texts: set[str]) -> str:
    """An expression whose outermost operators are all + with || for these if a part of it is a text (columns: in lower case)."""
    parts, depth, quote, begin = [], 0, "", 0
    for i, c in enumerate(expression):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "+" and not depth:
            parts.append(expression[begin:i].strip())
            begin = i + 1
    parts.append(expression[begin:].strip())
    is_text = lambda part: part.startswith("'") or part.strip("`").lower() in texts
    return " || ".join(parts) if len(parts) > 1 and any(map(is_text, parts)) else expression


def _order(definitions: dict[str, str]) -> list[list[str]]:
    """Columns in rounds, each made of those of rounds before it; bounded by the columns of one table."""
    known = {name.lower(): name for name in definitions}
    needs = {name: {known[n.lower()] for m in _NAMES.finditer(text) if (n := next((g for g in m.groups() if g), "")).lower() in known} for name, text in definitions.items()}
    rounds, done = [], set()
    while len(done) < len(needs):
        ready = [name for name, used in needs.items() if name not in done and used <= done]
        if not ready:
            raise Circular(", ".join(name for name in definitions if name not in done))
        rounds.append(ready)
        done.update(ready)
    return rounds


def with_computed(df: DataFrame, definitions: dict[str, str]) -> DataFrame:
    """df with columns (name: SQL text) that may name each other in any order and case; null texts are left out.

    They are one projection for each length of a chain, which Catalyst folds into the scan's. A stored column of the same
    name is replaced, but a definition can't use it: that is circular, and refused with Circular. Functions of other
    dialects are rewritten as dialect.to_spark_sql() does, and texts may be joined by +.
    """
    given = {name: text for name, text in definitions.items() if text}
    for names in _order(given):
        texts = {f.name.lower() for f in df.schema.fields if isinstance(f.dataType, StringType)}
        df = df.withColumns({name: F.expr(_joined(to_spark_sql(_plain(given[name])), texts)) for name in names})
    return df


def definitions_of(columns: DataFrame, table: str) -> dict[str, str]:
    """The computed columns of one table from rows of estate.tables(), in their order."""
    found = columns.filter((F.col("fqn") == table) & F.col("computed").isNotNull()).orderBy("ordinal").select("name", "computed")
    return {r["name"]: r["computed"] for r in found.collect()}
