"""JSON value semantics as column expressions.

A path of a document is missing, JSON null or a value.  Values of all kinds
have one total order, the one of their serialised text except that numbers go
by value: missing < string < number < array < false < null < true < object.
``cell`` encodes that as a struct that Spark compares field by field.

Typed columns stay typed: comparisons with literals of their kind are plain
expressions that reach the scan; those of another kind fold to constants.
Only paths into JSON text pay for parsing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING, STRING, NUMBER, ARRAY, FALSE, NULL, TRUE, OBJECT = -1, 0, 1, 2, 3, 4, 5, 6
_CELL = "struct<rank:int,num:double,txt:string>"


def _make(rank: Column | int, num: Column | None = None, txt: Column | None = None) -> Column:
    rank = F.lit(rank) if isinstance(rank, int) else rank
    num = F.lit(None).cast("double") if num is None else num
    txt = F.lit(None).cast("string") if txt is None else txt
    return F.struct(rank.cast("int").alias("rank"), num.cast("double").alias("num"), txt.cast("string").alias("txt"))


def canonical(value: object) -> str:
    """Compact JSON text of a literal, keys sorted."""
    return json.dumps(value, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def literal_rank(value: object) -> int:
    if value is None:
        return NULL
    if isinstance(value, bool):
        return TRUE if value else FALSE
    if isinstance(value, (int, float)):
        return NUMBER
    if isinstance(value, str):
        return STRING
    return ARRAY if isinstance(value, (list, tuple)) else OBJECT


def literal_cell(value: object) -> Column:
    rank = literal_rank(value)
    if rank == NUMBER:
        return _make(rank, F.lit(float(value)))
    if rank == STRING:
        return _make(rank, txt=F.lit(value))
    return _make(rank, txt=F.lit(canonical(value)) if rank in (ARRAY, OBJECT) else None)


def literal_text(value: object) -> Column:
    """Canonical text as ``Value.text`` gives it: floats in Spark's own notation."""
    if isinstance(value, float):
        return F.lit(value).cast("double").cast("string")
    return F.lit(canonical(value))


@dataclass(frozen=True)
class Value:
    """What a path leads to: a typed column, a path into JSON text, or nothing."""

    column: Column | None = None
    type: T.DataType | None = None
    json_path: tuple[str, ...] | None = None

    # -- the three forms

    @property
    def is_missing(self) -> bool:
        return self.column is None

    @property
    def is_json(self) -> bool:
        return self.json_path is not None

    @property
    def rank(self) -> int | None:
        """The one rank that a typed column's values have; None for booleans and JSON."""
        if self.is_missing or self.is_json or isinstance(self.type, T.BooleanType):
            return None
        if isinstance(self.type, T.NumericType):
            return NUMBER
        if isinstance(self.type, T.ArrayType):
            return ARRAY
        if isinstance(self.type, (T.StructType, T.MapType)):
            return OBJECT
        return STRING

    def _where(self) -> str:
        return "$" + "".join(f"['{p}']" for p in self.json_path)

    def _variant(self) -> Column:
        parsed = F.try_parse_json(self.column)
        return F.try_variant_get(parsed, self._where(), "variant") if self.json_path else parsed

    def _lexeme(self) -> Column:
        return F.get_json_object(self.column, self._where())

    def _kind(self) -> Column:
        return F.substring_index(F.substring_index(F.schema_of_variant(self._variant()), "<", 1), "(", 1)

    def json_rank(self) -> Column:
        v, kind = self._variant(), self._kind()
        number = kind.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
        return (
            F.when(v.isNull(), MISSING)
            .when(kind == "VOID", NULL)
            .when(kind == "STRING", STRING)
            .when(number, NUMBER)
            .when(kind == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), TRUE).otherwise(FALSE))
            .when(kind == "ARRAY", ARRAY)
            .otherwise(OBJECT)
        )

    # -- what operators need

    def present(self) -> Column:
        """True unless missing; JSON null is present, SQL NULL of a typed column is missing."""
        if self.is_missing:
            return F.lit(False)
        return self._variant().isNotNull() if self.is_json else self.column.isNotNull()

    def as_string(self) -> Column:
        return self.column if isinstance(self.type, T.StringType) else self.column.cast("string")

    def text(self) -> Column:
        """Canonical JSON text; SQL NULL when missing, 'null' for JSON null.  The join key."""
        if self.is_missing:
            return F.lit(None).cast("string")
        if self.is_json:
            rank, lexeme = self.json_rank(), self._lexeme()
            number = F.when(lexeme.rlike("^-?[0-9]+$"), lexeme).otherwise(lexeme.cast("double").cast("string"))
            return F.when(rank == MISSING, None).when(rank == NUMBER, number).otherwise(F.to_json(self._variant()))
        if self.rank == NUMBER:
            return self.column.cast("string")
        if self.rank in (ARRAY, OBJECT):
            return F.to_json(self.column)
        if isinstance(self.type, T.BooleanType):
            return self.column.cast("string")
        quoted = F.to_json(F.array(self.as_string()))
        return F.when(self.column.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))

    def cell(self) -> Column:
        """The sort key over all kinds."""
        if self.is_missing:
            return _make(MISSING)
        if self.is_json:
            rank = self.json_rank()
            txt = F.when(rank == STRING, self._lexeme()).when(rank.isin(ARRAY, OBJECT), F.to_json(self._variant()))
            return _make(rank, F.when(rank == NUMBER, self._lexeme().try_cast("double")), txt)
        absent = self.column.isNull()
        if isinstance(self.type, T.BooleanType):
            return _make(F.when(absent, MISSING).when(self.column, TRUE).otherwise(FALSE))
        num = self.column if self.rank == NUMBER else None
        txt = None if self.rank == NUMBER else self.as_string() if self.rank == STRING else F.to_json(self.column)
        return _make(F.when(absent, MISSING).otherwise(self.rank), num, txt)

    def order_key(self) -> Column:
        """Something that sorts like the cell: typed scalars sort as they are, missing first."""
        if self.is_missing:
            return F.lit(0)
        if self.is_json or self.rank in (ARRAY, OBJECT):
            return self.cell()
        return self.column

    def number(self) -> Column:
        """The value as a double where it's a number, else NULL: what sums and means take."""
        if self.is_json:
            return F.when(self.json_rank() == NUMBER, self._lexeme().try_cast("double"))
        if not self.is_missing and self.rank == NUMBER:
            return self.column.cast("double")
        return F.lit(None).cast("double")

    def group_key(self) -> tuple[Column, Column]:
        """(what to group by, what to show): missing and JSON null are one group, shown as NULL."""
        if self.is_missing:
            return F.lit(None).cast("string"), F.lit(None).cast("string")
        if self.is_json:
            text = F.coalesce(self.text(), F.lit("null"))
            return text, text
        return self.column, self.column

    # -- predicates: false, never NULL, when missing

    def equals(self, value: object) -> Column:
        if self.is_missing:
            return F.lit(False)
        if self.is_json:
            return F.coalesce(self.text() == literal_text(value), F.lit(False))
        if isinstance(self.type, T.BooleanType):
            return (self.column == F.lit(value)) if isinstance(value, bool) else F.lit(False)
        if literal_rank(value) != self.rank:
            return F.lit(False)
        if self.rank in (ARRAY, OBJECT):
            return self.text() == literal_text(value)
        return self.column == F.lit(value)

    def differs(self, value: object) -> Column:
        if self.is_missing:
            return F.lit(False)
        if self.is_json:
            return F.coalesce(self.text() != literal_text(value), F.lit(False))
        if not isinstance(self.type, T.BooleanType) and self.rank in (STRING, NUMBER) and literal_rank(value) == self.rank:
            return self.column != F.lit(value)
        return self.present() & ~self.equals(value)

    def compares(self, op: str, value: object) -> Column:
        """``op`` is one of gt gte lt lte, by the order over all kinds."""
        act = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}[op]
        if self.is_missing:
            return F.lit(False)
        if self.is_json or isinstance(self.type, T.BooleanType) or self.rank in (ARRAY, OBJECT):
            return self.present() & act(self.cell(), literal_cell(value))
        other = literal_rank(value)
        if other != self.rank:
            return self.column.isNotNull() if act(self.rank, other) else F.lit(False)
        return act(self.column, F.lit(value))

    def contains(self, value: object) -> Column:
        """A substring of a string, or an element of an array."""
        if self.is_missing:
            return F.lit(False)
        if self.is_json:
            rank = self.json_rank()
            inside = F.contains(self._lexeme(), F.lit(value)) if isinstance(value, str) else F.lit(False)
            items = F.try_variant_get(self._variant(), "$", "array<variant>")
            among = F.exists(items, lambda x: F.to_json(x) == F.lit(canonical(value)))
            return F.coalesce(F.when(rank == STRING, inside).when(rank == ARRAY, among), F.lit(False))
        if self.rank == STRING:
            return F.contains(self.as_string(), F.lit(value)) if isinstance(value, str) else F.lit(False)
        if self.rank == ARRAY:
            kind = self.type.elementType
            fits = isinstance(value, (int, float)) and not isinstance(value, bool) if isinstance(kind, T.NumericType) else isinstance(value, str) if isinstance(kind, T.StringType) else isinstance(value, bool) and isinstance(kind, T.BooleanType)
            return F.array_contains(self.column, F.lit(value).cast(kind)) if fits else F.lit(False)
        return F.lit(False)

    def among(self, values: object) -> Column:
        """Equal to an element of a literal array; any other literal gives false."""
        if not isinstance(values, (list, tuple)) or self.is_missing or not values:
            return F.lit(False)
        if not self.is_json and not isinstance(self.type, T.BooleanType) and self.rank in (STRING, NUMBER):
            same = [v for v in values if literal_rank(v) == self.rank]
            return self.column.isin(*same) if same else F.lit(False)
        out = F.lit(False)
        for v in values:
            out = out | self.equals(v)
        return out


def join_keys(a: Value, b: Value) -> tuple[Column, Column]:
    """Keys for a plain equi-join with JSON equality: null meets null, missing meets nothing."""
    whole = lambda v: isinstance(v.type, T.IntegralType) and not v.is_json
    if not a.is_missing and not b.is_missing:
        if whole(a) and whole(b):
            return a.column.cast("bigint"), b.column.cast("bigint")
        if not a.is_json and not b.is_json and isinstance(a.type, T.StringType) and isinstance(b.type, T.StringType):
            return a.column, b.column
    return a.text(), b.text()
