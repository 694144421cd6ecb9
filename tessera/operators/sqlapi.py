"""SQL over a collection's ``docs`` view, with the names that other engines use.

Double quotes name identifiers.  ``rewrite`` turns clauses and function names
that Spark doesn't know into ones that it does, outside of literals and
comments; ``register`` adds a few functions as SQL functions, which Catalyst
inlines.  Only queries are run, no statements that define or change anything.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: name(parameters), return type, body
FUNCTIONS = (
    ("strpos(s STRING, part STRING)", "INT", "instr(s, part)"),
    ("ends_with(s STRING, part STRING)", "BOOLEAN", "endswith(s, part)"),
    ("starts_with(s STRING, part STRING)", "BOOLEAN", "startswith(s, part)"),
    ("to_hex(n BIGINT)", "STRING", "lower(hex(n))"),
    ("substr_index(s STRING, part STRING, n INT)", "STRING", "substring_index(s, part, n)"),
    ("iszero(x DOUBLE)", "BOOLEAN", "x = 0"),
    ("gcd(a BIGINT, b BIGINT)", "BIGINT", "aggregate(sequence(1, 93), named_struct('x', abs(a), 'y', abs(b)), (s, i) -> if(s.y = 0, s, named_struct('x', s.y, 'y', s.x % s.y)), s -> s.x)"),
    ("lcm(a BIGINT, b BIGINT)", "BIGINT", "if(a = 0 OR b = 0, 0, abs(a div aggregate(sequence(1, 93), named_struct('x', abs(a), 'y', abs(b)), (s, i) -> if(s.y = 0, s, named_struct('x', s.y, 'y', s.x % s.y)), s -> s.x) * b))"),
    ("to_timestamp_nanos(n BIGINT)", "TIMESTAMP", "timestamp_micros(n div 1000)"),
    ("to_unixtime(t TIMESTAMP)", "BIGINT", "unix_seconds(t)"),
    ("today()", "DATE", "current_date()"),
)
#: Names that mean what a function of Spark's own means.
ALIASES = {
    "approx_distinct": "approx_count_distinct", "approx_median": "median", "approx_percentile_cont": "percentile", "covar": "covar_samp", "var": "var_samp", "var_sample": "var_samp", "var_population": "var_pop",
    "array_has": "array_contains", "list_has": "array_contains", "list_contains": "array_contains", "array_has_any": "arrays_overlap", "list_has_any": "arrays_overlap",
    "array_length": "size", "list_length": "size", "array_to_string": "array_join", "list_to_string": "array_join", "list_join": "array_join", "make_array": "array", "make_list": "array",
    "generate_series": "sequence", "array_concat": "concat", "array_cat": "concat", "list_concat": "concat", "list_cat": "concat", "list_append": "array_append", "array_push_back": "array_append", "list_prepend": "array_prepend", "array_push_front": "array_prepend",
    "array_remove_all": "array_remove", "list_remove_all": "array_remove", "array_reverse": "reverse", "list_reverse": "reverse", "list_sort": "array_sort", "list_distinct": "array_distinct", "list_union": "array_union", "list_intersect": "array_intersect", "list_except": "array_except", "list_position": "array_position", "list_repeat": "array_repeat", "list_slice": "array_slice",
    "make_map": "map", "to_timestamp_seconds": "timestamp_seconds", "to_timestamp_millis": "timestamp_millis", "to_timestamp_micros": "timestamp_micros", "arrow_typeof": "typeof", "datetrunc": "date_trunc",
}
#: Calls that need other arguments: the new call from those given.
CALLS: dict[str, Callable[..., str]] = {
    "approx_percentile_cont_with_weight": lambda x, w, p: f"percentile({x}, {p}, {w})",
    "array_has_all": lambda a, b: f"(size(array_except({b}, {a})) = 0)",
    "array_slice": lambda a, low, high: f"slice({a}, {low}, greatest(0, ({high}) - ({low}) + 1))",
    "array_element": lambda a, i: f"try_element_at({a}, {i})",
    "array_extract": lambda a, i: f"try_element_at({a}, {i})",
    "list_element": lambda a, i: f"try_element_at({a}, {i})",
    "array_pop_back": lambda a: f"slice({a}, 1, greatest(0, size({a}) - 1))",
    "array_pop_front": lambda a: f"slice({a}, 2, greatest(0, size({a}) - 1))",
    "array_empty": lambda a: f"(size({a}) = 0)",
    "empty": lambda a: f"(size({a}) = 0)",
    "array_positions": lambda a, x: f"filter(sequence(1, greatest(1, size({a}))), i -> try_element_at({a}, i) = {x})",
    "array_replace_all": lambda a, x, y: f"transform({a}, v -> if(v <=> {x}, {y}, v))",
    "array_any_value": lambda a: f"get(filter({a}, v -> v is not null), 0)",
    "string_to_array": lambda s, part: f"split({s}, concat('\\\\Q', {part}, '\\\\E'), -1)",
    "regexp_match": lambda s, p: f"if({s} rlike {p}, array(regexp_extract({s}, {p}, 0)), null)",
    "date_bin": lambda step, t, origin="TIMESTAMP '1970-01-01 00:00:00'": _date_bin(step, t, origin),
    "digest": lambda s, kind: f"unhex(CASE lower({kind}) WHEN 'md5' THEN md5({s}) ELSE sha2({s}, CAST(substr({kind}, 4) AS INT)) END)",
    "sha224": lambda s: f"unhex(sha2({s}, 224))",
    "sha256": lambda s: f"unhex(sha2({s}, 256))",
    "sha384": lambda s: f"unhex(sha2({s}, 384))",
    "sha512": lambda s: f"unhex(sha2({s}, 512))",
    "arrow_cast": lambda x, kind: f"CAST({x} AS {_ARROW[kind.strip(chr(39)).lower()]})",
}
_ARROW = {"int8": "TINYINT", "int16": "SMALLINT", "int32": "INT", "int64": "BIGINT", "float32": "FLOAT", "float64": "DOUBLE", "utf8": "STRING", "largeutf8": "STRING", "utf8view": "STRING", "boolean": "BOOLEAN", "binary": "BINARY", "date32": "DATE", "timestamp(second, none)": "TIMESTAMP_NTZ", "timestamp(millisecond, none)": "TIMESTAMP_NTZ", "timestamp(microsecond, none)": "TIMESTAMP_NTZ", "timestamp(nanosecond, none)": "TIMESTAMP_NTZ"}


def _date_bin(step: str, t: str, origin: str) -> str:
    at, zero = f"unix_micros(CAST({t} AS TIMESTAMP))", f"unix_micros(CAST({origin} AS TIMESTAMP))"
    width = f"unix_micros(CAST(TIMESTAMP_NTZ '1970-01-01 00:00:00' + {step} AS TIMESTAMP) - INTERVAL '0' SECOND) - unix_micros(CAST(TIMESTAMP_NTZ '1970-01-01 00:00:00' AS TIMESTAMP))"
    return f"timestamp_micros({zero} + CAST(floor(({at} - {zero}) / ({width})) AS BIGINT) * ({width}))"


class SqlError(ValueError):
    """Text that isn't a query."""


def register(spark: SparkSession) -> None:
    """Add the functions to the session."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")


def docs_view(docs: DataFrame, *, compat: bool = False) -> DataFrame:
    """What SQL sees: id, text, category, vector as JSON text; beside them metadata and the vector's numbers.

    With ``compat`` only the four strings, and one row of empty strings for an
    empty collection.
    """
    vector = F.concat(F.lit("["), F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), F.lit("]"))
    base = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("id", "text", "category")] + [F.coalesce(vector, F.lit("[]")).alias("vector")]
    if not compat:
        return docs.select(*base, *(["metadata"] if "metadata" in docs.columns else []), F.col("vector").alias("embedding"))
    out = docs.select(*base)
    if out.isEmpty():
        return docs.sparkSession.createDataFrame([("", "", "", "[]")], "id string, text string, category string, vector string")
    return out


_LITERAL = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
_MARK = re.compile("\x00([0-9]+)\x00")


def _mask(text: str) -> tuple[str, list[str]]:
    """The text with a mark in place of each literal, quoted name or comment, and what the marks stand for."""
    kept: list[str] = []

    def put(m: re.Match) -> str:
        if m[0].startswith(("--", "/*")):
            return " "
        kept.append("`" + m[0][1:-1].replace('""', '"').replace("`", "``") + "`" if m[0][0] == '"' else m[0])
        return f"\x00{len(kept) - 1}\x00"

    return _LITERAL.sub(put, text), kept


def _unmask(text: str, kept: list[str]) -> str:
    return _MARK.sub(lambda m: kept[int(m[1])], text)


def _closing(text: str, at: int) -> int:
    """Place of the parenthesis that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(text)):
        depth += {"(": 1, ")": -1}.get(text[i], 0)
        if not depth:
            return i
    raise SqlError("a parenthesis isn't closed")


def _commas(text: str) -> list[str]:
    """The text cut at commas outside of brackets."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(c, 0)
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [x.strip() for x in [*out, text[start:]] if x.strip()]


def _word(text: str, pattern: str, start: int = 0) -> re.Match | None:
    """The first match of a pattern outside of parentheses, from ``start``."""
    depth = 0
    for m in re.finditer(rf"(?i)[()]|\b(?:{pattern})\b", text[start:]):
        if m[0] in "()":
            depth += 1 if m[0] == "(" else -1
        elif not depth:
            return re.compile(rf"(?i)\b(?:{pattern})\b").match(text, start + m.start())
    return None


def _calls(text: str, kept: list[str]) -> str:
    """Calls by other engines' names, inner ones first."""
    out, at = [], 0
    for m in re.finditer(r"(?<![\w.])([A-Za-z_]\w*)\s*\(", text):
        if m.start() < at:
            continue
        name = m[1].lower()
        end = _closing(text, m.end() - 1)
        inner = _calls(text[m.end() : end], kept)
        out.append(text[at : m.start()])
        args = _commas(inner)
        if name == "trunc" and len(args) == 1:
            out.append(f"(signum({args[0]}) * floor(abs({args[0]})))")
        elif name in ("encode", "decode") and len(args) == 2 and (how := _unmask(args[1], kept).strip("'").lower()) in ("hex", "base64"):
            out.append({"encodehex": "lower(hex({}))", "encodebase64": "base64({})", "decodehex": "unhex({})", "decodebase64": "unbase64({})"}[name + how].format(args[0]))
        elif ALIASES.get(name, name) in CALLS:
            new = CALLS[ALIASES.get(name, name)]
            out.append(new(*(_unmask(x, kept) if name == "arrow_cast" else x for x in args)))
        else:
            out.append(f"{ALIASES.get(name, m[1])}({inner})")
        at = end + 1
    return "".join([*out, text[at:]])


def _tail(text: str, start: int) -> tuple[str, str]:
    """What stands before the outer ORDER BY or LIMIT after ``start``, and it with the rest."""
    m = _word(text, r"order\s+by|limit|offset", start)
    return (text[: m.start()], text[m.start() :]) if m else (text, "")


def _distinct_on(text: str) -> str:
    """DISTINCT ON of the outer select: the first row of each key by the query's order, which the result keeps."""
    m = _word(text, r"select\s+distinct\s+on")
    if not m:
        return text
    opened = text.index("(", m.end() - 1)
    closed = _closing(text, opened)
    keys = text[opened + 1 : closed]
    body, tail = _tail(text, closed + 1)
    frm = _word(body, "from", closed + 1)
    if not frm:
        raise SqlError("DISTINCT ON without FROM")
    what, rest = body[closed + 1 : frm.start()], body[frm.start() :]
    order = re.match(r"(?is)order\s+by\s", tail)
    by, limit = "", tail
    if order:
        cut = _word(tail, "limit|offset")
        by, limit = tail[order.end() : cut.start() if cut else len(tail)], tail[cut.start() :] if cut else ""
    items = [re.match(r"(?is)(.*?)((?:\s+(?:asc|desc))?(?:\s+nulls\s+(?:first|last))?)\s*$", x) for x in _commas(by)]
    hidden = "".join(f", {x[1]} AS __o{i}" for i, x in enumerate(items))
    outer = ", ".join(f"__o{i}{x[2]}" for i, x in enumerate(items))
    names = ", ".join(["__rn", *(f"__o{i}" for i in range(len(items)))])
    inner = f"SELECT {what}, row_number() OVER (PARTITION BY {keys} ORDER BY {by or keys}) AS __rn{hidden} {rest}"
    return f"{text[: m.start()]}SELECT * EXCEPT ({names}) FROM ({inner}) WHERE __rn = 1{' ORDER BY ' + outer if outer else ''} {limit}"


def _qualify(text: str) -> str:
    """QUALIFY of the outer select."""
    q = _word(text, "qualify")
    if not q:
        return text
    first = _word(text, "select")
    frm = _word(text, "from", first.end())
    whole, tail = _tail(text, q.end())
    test = whole[q.end() :]
    return f"{text[: first.start()]}SELECT * EXCEPT (__keep) FROM ({text[first.start() : frm.start()]}, ({test}) AS __keep {text[frm.start() : q.start()]}) WHERE __keep {tail}"


def rewrite(sql: str) -> str:
    """A query as Spark says it: RIGHT SEMI/ANTI joins, SIMILAR TO, QUALIFY, DISTINCT ON, function names, quoted names.

    What isn't a query (a statement that defines, changes or sets something)
    is an ``SqlError``.
    """
    text, kept = _mask(sql)
    text = text.strip().rstrip(";").strip()
    if not re.match(r"(?is)[\s(]*(select|with|values|from|table)\b", text) or ";" in text or _word(text, r"insert\s+(?:into|overwrite)|merge\s+into|delete\s+from|update\s+\w+\s+set"):
        raise SqlError("only one query is run")
    text = _calls(text, kept)
    text = _qualify(_distinct_on(text))
    text = re.sub(r"(?i)\bfrom\s+(\w+)(\s+\w+)?\s+right\s+(semi|anti)\s+join\s+(\w+)(\s+(?!on\b)\w+)?\s+on\b", lambda x: f"FROM {x[4]}{x[5] or ''} LEFT {x[3].upper()} JOIN {x[1]}{x[2] or ''} ON", text)
    text = re.sub("(?i)\\bsimilar\\s+to\\s+\x00([0-9]+)\x00", lambda x: f"RLIKE '{_similar(kept[int(x[1])][1:-1])}'", text)
    return _unmask(text, kept)


def _similar(pattern: str) -> str:
    return "^(?:" + pattern.replace(".", "\\\\.").replace("%", ".*").replace("_", ".") + ")$"


def sql(spark: SparkSession, text: str, docs: DataFrame, *, compat: bool = False, **more: DataFrame) -> DataFrame:
    """A query over ``docs`` (and further frames by name).  ``compat``: the first column only, as strings.

    The frames are common table expressions of this query alone, so queries
    at the same time don't see one another's.
    """
    text = rewrite(text)
    register(spark)
    frames = {"docs": docs_view(docs, compat=compat)} | more
    views = {name: f"tessera_{name}_{uuid.uuid4().hex}" for name in frames}
    for name, df in frames.items():
        df.createOrReplaceTempView(views[name])
    tables = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
    own = re.match(r"(?is)\s*with\b(\s+recursive\b)?", text)
    try:
        out = spark.sql(f"WITH{own[1] or ''} {tables}, {text[own.end() :]}" if own else f"WITH {tables} {text}")
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    if compat:
        first = out.columns[0]
        if not isinstance(out.schema[0].dataType, T.StringType):
            return out.select(F.lit("").alias("value")).limit(0)
        out = out.select(F.coalesce(F.col(f"`{first}`"), F.lit("")).alias("value"))
    return out
