"""Column helpers with the semantics of warehouse SQL dialects, and rewrites of their text into Spark SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_boundaries(start: Column, end: Column) -> Column:
    """DATEDIFF(MONTH): month ends passed, not whole months."""
    return ((F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))).cast("long")


def year_boundaries(start: Column, end: Column) -> Column:
    return (F.year(end) - F.year(start)).cast("long")


def age(born: Column, on: Column) -> Column:
    """Completed years."""
    before = (F.month(on) < F.month(born)) | ((F.month(on) == F.month(born)) & (F.dayofmonth(on) < F.dayofmonth(born)))
    return (F.year(on) - F.year(born) - before.cast("int")).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.nullif(b, F.lit(0))


def date_key(day: Column) -> Column:
    """CONVERT(VARCHAR, d, 112): the day as yyyyMMdd."""
    return F.date_format(day, "yyyyMMdd").cast("int")


#: What a CONVERT style means.
STYLES = {101: "MM/dd/yyyy", 103: "dd/MM/yyyy", 108: "HH:mm:ss", 112: "yyyyMMdd", 120: "yyyy-MM-dd HH:mm:ss", 121: "yyyy-MM-dd HH:mm:ss.SSS", 126: "yyyy-MM-dd'T'HH:mm:ss.SSS"}


def convert(moment: Column, style: int) -> Column:
    """CONVERT(VARCHAR, moment, style)."""
    return F.date_format(moment, STYLES[style])


def boundaries(part: str, start: Column, end: Column) -> Column:
    """DATEDIFF(part, start, end): how many boundaries of YEAR, MONTH, DAY, HOUR, MINUTE or SECOND are passed."""
    if part == "YEAR":
        return year_boundaries(start, end)
    if part == "MONTH":
        return month_boundaries(start, end)
    if part == "DAY":
        return F.datediff(end, start).cast("long")
    size = {"HOUR": 3600, "MINUTE": 60, "SECOND": 1}[part]
    at = lambda t: F.floor(F.unix_timestamp(t.cast("timestamp")) / size)
    return (at(end) - at(start)).cast("long")


def date_add(part: str, n: Column | int, moment: Column) -> Column:
    """DATEADD(part, n, moment) for YEAR, MONTH, DAY, HOUR, MINUTE and SECOND; the last three of timestamps."""
    n = F.lit(n) if isinstance(n, int) else n
    if part in ("YEAR", "MONTH"):
        days = F.add_months(moment, n * (12 if part == "YEAR" else 1))
        return days
    if part == "DAY":
        return F.date_add(moment, n)
    name = {"HOUR": "hours", "MINUTE": "mins", "SECOND": "secs"}[part]
    return moment + F.make_interval(**{name: n})


def weekday(day: Column) -> Column:
    """DATEPART(WEEKDAY): 1 for Sunday."""
    return F.dayofweek(day)


def format_n2(x: Column) -> Column:
    """FORMAT(x, 'N2'): thousands parted by commas, two decimals."""
    return F.format_number(x, 2)


def to_char(moment: Column, pattern: str) -> Column:
    """TO_CHAR with the codes YYYY, MM, DD, HH24 or HH, MI and SS; MM after HH means minutes, as its writers intend."""
    out, hours, i = "", False, 0
    codes = {"YYYY": "yyyy", "HH24": "HH", "HH": "HH", "MI": "mm", "SS": "ss", "DD": "dd"}
    while i < len(pattern):
        code = next((c for c in ("YYYY", "HH24", "HH", "MI", "SS", "DD", "MM") if pattern.startswith(c, i)), None)
        if code is None:
            out += pattern[i] if not pattern[i].isalpha() else f"'{pattern[i]}'"
            i += 1
            continue
        hours = hours or code.startswith("HH")
        out += codes.get(code) or ("mm" if hours else "MM")
        i += len(code)
    return F.date_format(moment, out)


def datastage_expression(text: str) -> Column | None:
    """A BASIC derivation as a column: a link's column, a literal, @TRUE, @FALSE, @NULL or SetNull(); None for others."""
    t = text.strip()
    fixed = {"@TRUE": F.lit(True), "@FALSE": F.lit(False), "@NULL": F.lit(None), "SETNULL()": F.lit(None)}
    if t.upper() in fixed:
        return fixed[t.upper()]
    if re.fullmatch(r"[A-Za-z_]\w*\.[A-Za-z_]\w*", t):
        return F.col(t.split(".")[1])
    if re.fullmatch(r"-?\d+", t):
        return F.lit(int(t))
    if re.fullmatch(r"-?\d+\.\d+", t):
        return F.lit(float(t))
    quoted = re.fullmatch(r"'([^']*)'|\"([^\"]*)\"", t)
    return F.lit(quoted[1] if quoted[1] is not None else quoted[2]) if quoted else None


def uuid5(name: Column, namespace: str = "6ba7b811-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The version 5 UUID of a name, in SQL functions: SHA-1 of the namespace's bytes and the name, with its marks."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.substring(F.sha1(F.concat(space, name.cast("binary"))), 1, 32)
    high = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))
    v = F.lower(F.hex(high))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), v, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def money(x: Column) -> Column:
    """A double as decimal, so that sums don't depend on their order."""
    return x.cast("decimal(18,2)")


def fqn(name: Column) -> Column:
    """Canonical SCHEMA.OBJECT: upper case, no quotes, brackets or white space."""
    return F.upper(F.regexp_replace(name, r"[\[\]\"`\s]", ""))


#: What differs between Oracle or T-SQL text and Spark SQL, in the order of application.
REWRITES = [
    (r"\bTRUNC\s*\(\s*SYSDATE\s*\)", "current_date()"),
    (r"\bSYSDATE\b", "current_timestamp()"),
    (r"\bSYSTIMESTAMP\b", "current_timestamp()"),
    (r"\bGETDATE\s*\(\s*\)", "current_timestamp()"),
    (r"\bSYSDATETIME\s*\(\s*\)", "current_timestamp()"),
    (r"\bNVL\s*\(", "coalesce("),
    (r"\bISNULL\s*\((?=[^()]*(?:\([^()]*\)[^()]*)*,)", "coalesce("),
    (r"\bIIF\s*\(", "if("),
    (r"\bDATEDIFF\s*\(\s*DAY\s*,\s*([^,()]+(?:\(\))?\s*),\s*([^,()]+(?:\(\))?\s*)\)", r"datediff(\2, \1)"),
    (r"\bDATEDIFF\s*\(\s*MONTH\s*,\s*([^,()]+(?:\(\))?\s*),\s*([^,()]+(?:\(\))?\s*)\)", r"((year(\2) * 12 + month(\2)) - (year(\1) * 12 + month(\1)))"),
    (r"\bDATEDIFF\s*\(\s*YEAR\s*,\s*([^,()]+(?:\(\))?\s*),\s*([^,()]+(?:\(\))?\s*)\)", r"(year(\2) - year(\1))"),
    (r"\bDATEADD\s*\(\s*DAY\s*,\s*([^,()]+),\s*([^,()]+)\)", r"date_add(\2, \1)"),
    (r"\bDATEADD\s*\(\s*MONTH\s*,\s*([^,()]+),\s*([^,()]+)\)", r"add_months(\2, \1)"),
    (r"\bWITH\s*\(\s*NOLOCK\s*\)", ""),
    (r"\[(\w+)\]", r"`\1`"),
]
TOP = re.compile(r"^(\s*SELECT\s+)TOP\s*\(?\s*(\d+)\s*\)?\s+(.*)$", re.IGNORECASE | re.DOTALL)


def to_spark_sql(text: str, as_of: str | None = None) -> str:
    """Rewrites one statement; what no rule covers stays as it is, and TOP n becomes LIMIT n.

    as_of: the time (yyyy-MM-dd HH:mm:ss) that the statement takes for now, so that runs can be repeated; else the clock.
    """
    out = text.strip().rstrip(";")
    for pattern, into in REWRITES:
        out = re.sub(pattern, into, out, flags=re.IGNORECASE)
    if as_of is not None:
        out = out.replace("current_timestamp()", f"TIMESTAMP_NTZ '{as_of}'").replace("current_date()", f"DATE '{as_of[:10]}'")
    top = TOP.match(out)
    return f"{top[1]}{top[3]} LIMIT {top[2]}" if top else out


#: Source column types and the Spark types that hold them.
TYPES = {
    "VARCHAR2": "string", "VARCHAR": "string", "NVARCHAR2": "string", "NVARCHAR": "string", "CHAR": "string", "NCHAR": "string",
    "CLOB": "string", "NCLOB": "string", "TEXT": "string", "FLOAT": "double", "REAL": "float", "INT": "int", "INTEGER": "int",
    "BIGINT": "bigint", "SMALLINT": "smallint", "TINYINT": "tinyint", "BIT": "boolean", "DATE": "date", "DATETIME": "timestamp_ntz",
    "DATETIME2": "timestamp_ntz", "TIMESTAMP": "timestamp_ntz", "TIME": "string",
}


def spark_type(source: str) -> str:
    """The Spark type for an Oracle or T-SQL column type; unknown ones are strings."""
    m = re.match(r"\s*(\w+)\s*(?:\(([^)]*)\))?\s*(.*)", source.upper())
    if not m:
        return "string"
    name, args, rest = m[1], [a.strip() for a in (m[2] or "").split(",") if a.strip()], m[3]
    if name in ("NUMBER", "DECIMAL", "NUMERIC"):
        if not args:
            return "decimal(38,10)" if name == "NUMBER" else "decimal(18,0)"
        return f"decimal({38 if args[0] == '*' else min(38, int(args[0]))},{args[1] if len(args) > 1 else 0})"
    if name == "TIMESTAMP" and "TIME ZONE" in rest:
        return "timestamp"
    return TYPES.get(name, "string")
