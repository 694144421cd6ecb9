"""Stages to one lazy DataFrame.

Nothing runs until the caller asks for rows: a pipeline is folded into a
single plan that Catalyst optimises as a whole.  The row order that limits
depend on is carried as hidden columns and costs a sort only where a limit, a
skip or the final output needs it.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.values import Value, join_keys
from tessera.operators.search import text_match
from tessera.plans import parse as P

_HIDDEN = "__o"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Rows:
    """A frame, which of its paths hold JSON text, and the order so far.

    ``order`` lists (hidden column, ascending); ``asked`` says that a sort
    stage set it and nothing has used it up.
    """

    df: DataFrame
    json: frozenset[str] = frozenset({"metadata"})
    order: tuple[tuple[str, bool], ...] = ()
    asked: bool = False

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(_HIDDEN)]

    def value(self, path: str) -> Value:
        """What a dotted path leads to; an exact column name comes first."""
        names = self.columns
        if path in names:
            return self._at(quoted(path), self.df.schema[path].dataType, path, ())
        parts = path.split(".")
        for k in range(len(parts) - 1, 0, -1):
            head = ".".join(parts[:k])
            if head in names:
                return self._at(quoted(head), self.df.schema[head].dataType, head, tuple(parts[k:]))
        return Value()

    def _at(self, column: Column, kind: T.DataType, name: str, rest: tuple[str, ...]) -> Value:
        while True:
            if name in self.json and isinstance(kind, T.StringType):
                return Value(column, kind, rest)
            if not rest:
                return Value(column, kind)
            if not isinstance(kind, T.StructType):
                return Value()
            for k in range(len(rest), 0, -1):
                key = ".".join(rest[:k])
                if key in kind.names:
                    column, kind, name, rest = column.getField(key), kind[key].dataType, f"{name}.{key}", rest[k:]
                    break
            else:
                return Value()

    def sorted_frame(self) -> DataFrame:
        keys = [quoted(c).asc_nulls_first() if up else quoted(c).desc_nulls_last() for c, up in self.order]
        return self.df.orderBy(*keys) if keys else self.df

    def frame(self) -> DataFrame:
        """The rows without hidden columns; in order where a sort asked for it."""
        return (self.sorted_frame() if self.asked else self.df).select(*(quoted(c) for c in self.columns))

    def to_json(self) -> DataFrame:
        """One column ``value``: each row as JSON, absent fields left out."""
        return self.frame().select(F.to_json(F.struct(*(quoted(c) for c in self.columns))).alias("value"))


class Engine:
    """Collections by name, and pipelines over them."""

    def __init__(self, collections: Mapping[str, DataFrame | Rows]):
        self.collections = collections

    # -- scans

    def scan(self, name: str) -> Rows:
        """A collection in its own order: by id."""
        found = self.collections[name]
        rows = found if isinstance(found, Rows) else Rows(found)
        return replace(rows, df=rows.df.withColumn(_HIDDEN + "0", quoted("id")), order=((_HIDDEN + "0", True),), asked=False)

    def _tagged(self, name: str) -> Rows:
        rows = self.scan(name)
        return replace(rows, df=rows.df.withColumn("_source_collection", F.lit(name)))

    def run(self, collection: str, spec: list) -> Rows:
        """An aggregation pipeline over one collection; ``spec`` is its JSON array."""
        rows = self._tagged(collection)
        for s in P.pipeline(spec):
            rows = self._tagged_search(collection, s) if isinstance(s, P.Search) else self.apply(rows, s)
        return rows

    def run_cross(self, spec: dict) -> Rows:
        """A cross-collection pipeline: only rows of a union say where they come from."""
        source, stages = P.cross_pipeline(spec)
        rows = self.scan(source)
        for s in stages:
            rows = self.apply(rows, s)
        return rows

    def _tagged_search(self, collection: str, s: P.Search) -> Rows:
        # a search starts from the base collection again, whatever came before
        rows = self._tagged(collection)
        return replace(rows, df=rows.df.where(text_match(rows.df, s.query, partial=s.partial, case_sensitive=s.case_sensitive, metadata=s.metadata)))

    # -- stages

    def apply(self, rows: Rows, s: object) -> Rows:
        return getattr(self, "_" + type(s).__name__.lower())(rows, s)

    def _match(self, rows: Rows, s: P.Match) -> Rows:
        test = F.lit(not s.any_of)
        for f in s.filters:
            one = predicate(rows.value(f.field), f.op, f.value)
            test = (test | one) if s.any_of else (test & one)
        return replace(rows, df=rows.df.where(test))

    def _sort(self, rows: Rows, s: P.Sort) -> Rows:
        names = [f"{_HIDDEN}{i}" for i in range(len(s.keys))]
        old = [(f"{_HIDDEN}{len(s.keys) + i}", c, up) for i, (c, up) in enumerate(rows.order)]
        keys = {n: rows.value(path).order_key() for n, (path, _) in zip(names, s.keys, strict=True)}
        df = rows.df.select(*(quoted(c) for c in rows.columns), *(k.alias(n) for n, k in keys.items()), *(quoted(c).alias(n) for n, c, _ in old))
        order = tuple((n, up) for n, (_, up) in zip(names, s.keys, strict=True)) + tuple((n, up) for n, _, up in old)
        return replace(rows, df=df, order=order, asked=True)

    def _limit(self, rows: Rows, s: P.Limit) -> Rows:
        return replace(rows, df=rows.sorted_frame().limit(s.n))

    def _skip(self, rows: Rows, s: P.Skip) -> Rows:
        return replace(rows, df=rows.sorted_frame().offset(s.n))

    def _project(self, rows: Rows, s: P.Project) -> Rows:
        hidden = [quoted(c) for c, _ in rows.order]
        if s.include:
            picked, json = [], set()
            for path in dict.fromkeys(s.include):
                v = rows.value(path)
                if not v.is_missing:
                    if v.is_json:
                        json.add(path)
                    picked.append((v.text() if v.is_json else v.column).alias(path))
            return replace(rows, df=rows.df.select(*picked, *hidden), json=frozenset(json))
        df = rows.df
        for path in s.exclude:
            df = _without(df, rows, path)
        return replace(rows, df=df)

    def _group(self, rows: Rows, s: P.Group) -> Rows:
        keys = [rows.value(p).group_key() for p in s.by]
        made = [aggregate(rows.value(a.field) if a.field else Value(), a.op).alias(a.name) for a in s.aggregates]
        names = [f"__k{i}" for i in range(len(keys))]
        # no key: grouped by a constant, so that no row in gives no row out
        by = [k.alias(n) for n, (k, _) in zip(names, keys, strict=True)] or [F.lit(1).alias("__k")]
        df = rows.df.groupBy(*by).agg(*(made or [F.count(F.lit(1)).alias("__n")]))
        parts = [F.col(n).alias(p) for n, p in zip(names, s.by, strict=True)]
        shown = F.struct(*parts) if parts else F.struct(F.lit(None).cast("string").alias("all"))
        out = [shown.alias("_id"), *(quoted(a.name) for a in s.aggregates)]
        json = frozenset(f"_id.{p}" for p in s.by if rows.value(p).is_json)
        order = [F.col(n).alias(f"{_HIDDEN}{i}") for i, n in enumerate(names)]
        return Rows(df.select(*out, *order), json, tuple((f"{_HIDDEN}{i}", True) for i in range(len(names))), False)

    def _lookup(self, rows: Rows, s: P.Lookup) -> Rows:
        other = self._side(s.source)
        if other is None:
            return replace(rows, df=rows.df.withColumn(s.name, F.array().cast("array<string>")))
        left, right = join_keys(rows.value(s.local), other.value(s.foreign))
        found = other.df.where(right.isNotNull()).groupBy(right.alias("__key")).agg(F.sort_array(F.collect_list(F.struct(*(quoted(c) for c in other.columns)))).alias("__found"))
        df = rows.df.drop(s.name) if s.name in rows.columns else rows.df
        kind = found.schema["__found"].dataType
        df = df.withColumn("__left", left).join(found, F.col("__left") == F.col("__key"), "left")
        df = df.withColumn(s.name, F.coalesce(F.col("__found"), F.array().cast(kind))).drop("__left", "__key", "__found")
        return replace(rows, df=df)

    def _join(self, rows: Rows, s: P.Join) -> Rows:
        other = self._side(s.source)
        if other is None:
            empty = rows.df.limit(0) if s.how in ("inner", "right") else rows.df.withColumn(s.name, F.lit(None).cast("string"))
            return replace(rows, df=empty)
        left, right = join_keys(rows.value(s.local), other.value(s.foreign))
        prefixed = [quoted(c).alias(f"{s.name}.{c}") for c in other.columns]
        n = len(rows.order)
        foreign = other.df.select(right.alias("__right"), *prefixed, quoted("id").alias(f"{_HIDDEN}{n}"))
        names = set(rows.columns) & {f"{s.name}.{c}" for c in other.columns}
        local = rows.df.drop(*("`" + c + "`" for c in names)).withColumn("__left", left)
        df = local.join(foreign, F.col("__left") == F.col("__right"), "inner" if s.how in ("inner", "right") else "left").drop("__left", "__right")
        if s.how in ("left", "full"):
            # rows without a partner: the name itself is null, and so are its fields
            df = df.withColumn(s.name, F.lit(None).cast("string")) if s.name not in rows.columns else df
        order = (*rows.order, (f"{_HIDDEN}{n}", True))
        json = rows.json | {f"{s.name}.{p}" for p in other.json}
        out = Rows(df, frozenset(json), order, rows.asked)
        if s.how in ("right", "full"):
            keys = rows.df.select(left.alias("__left")).where("__left is not null").distinct()
            bare = other.df.withColumn("__right", right).join(keys, F.col("__left") == F.col("__right"), "left_anti")
            bare = Rows(bare.select(*(quoted(c) for c in other.columns), quoted("id").alias(f"{_HIDDEN}{n}")), other.json)
            out = _stack([out, bare], order)
        return out

    def _union(self, rows: Rows, s: P.Union) -> Rows:
        parts = [rows]
        for name in s.collections:
            if name in self.collections:
                parts.append(self._tagged(name))
        if len(parts) == 1:
            return rows
        shift = []
        for k, part in enumerate(parts):
            names = [c for c, _ in part.order]
            df = part.df.select(*(quoted(c) for c in part.columns), F.lit(k).alias(f"{_HIDDEN}0"), *(quoted(c).alias(f"{_HIDDEN}{i + 1}") for i, c in enumerate(names)))
            shift.append(replace(part, df=df))
        order = ((f"{_HIDDEN}0", True), *((f"{_HIDDEN}{i + 1}", up) for i, (_, up) in enumerate(rows.order)))
        longest = max(len(p.order) for p in parts)
        order += tuple((f"{_HIDDEN}{i + 1}", True) for i in range(len(order) - 1, longest))
        return _stack(shift, order)

    def _side(self, name: str) -> Rows | None:
        """The foreign side of a join: an unknown collection is an empty one."""
        if name not in self.collections:
            return None
        found = self.collections[name]
        return found if isinstance(found, Rows) else Rows(found)


def predicate(value: Value, op: str, literal: object) -> Column:
    if op == "eq":
        return value.equals(literal)
    if op == "ne":
        return value.differs(literal)
    if op == "contains":
        return value.contains(literal)
    if op == "in":
        return value.among(literal)
    return value.compares(op, literal)


def aggregate(value: Value, op: str) -> Column:
    """Counts count rows; the others take numbers only, and 0.0 where there are none."""
    if op == "count":
        return F.count(F.lit(1))
    return F.coalesce({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[op](value.number()), F.lit(0.0))


def _without(df: DataFrame, rows: Rows, path: str) -> DataFrame:
    """Drop a column, a struct's field or a key of JSON text; absent paths change nothing."""
    if path in df.columns:
        return df.drop(quoted(path))
    head, _, rest = path.partition(".")
    if head not in df.columns or not rest:
        return df
    kind = df.schema[head].dataType
    if isinstance(kind, T.StructType):
        inner, parts = kind, rest.split(".")
        for part in parts[:-1]:
            if not isinstance(inner, T.StructType) or part not in inner.names:
                return df
            inner = inner[part].dataType
        if not isinstance(inner, T.StructType) or parts[-1] not in inner.names:
            return df
        return df.withColumn(head, quoted(head).dropFields(".".join(f"`{p}`" for p in parts)))
    if head in rows.json and isinstance(kind, T.StringType):
        return df.withColumn(head, _json_without(quoted(head), rest.split(".")))
    return df


def _json_without(text: Column, parts: list[str]) -> Column:
    """JSON text of an object without one (nested) key."""
    as_map = F.from_json(F.to_json(F.try_parse_json(text)), "map<string,variant>")
    kept = F.map_filter(as_map, lambda k, _: k != parts[0])
    if len(parts) == 1:
        return F.coalesce(F.to_json(kept), text)
    inner = F.to_json(F.try_variant_get(F.try_parse_json(text), f"$['{parts[0]}']", "variant"))
    changed = F.map_concat(kept, F.create_map(F.lit(parts[0]), F.parse_json(_json_without(inner, parts[1:]))))
    return F.when(inner.startswith("{"), F.to_json(changed)).otherwise(text)


def _stack(parts: list[Rows], order: tuple[tuple[str, bool], ...]) -> Rows:
    """Bag union of rows of different shapes: missing columns are NULL, clashing types become JSON text."""
    kinds: dict[str, set[str]] = {}
    for p in parts:
        for f in p.df.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    clash = {c for c, k in kinds.items() if len(k) > 1}
    json = frozenset().union(*(p.json for p in parts))
    frames = []
    for p in parts:
        cols = []
        for f in p.df.schema.fields:
            c = quoted(f.name)
            if f.name in clash:
                if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
                    c = F.to_json(c)
                elif not f.name.startswith(_HIDDEN) and all(k in ("int", "bigint", "double", "float", "smallint", "tinyint") for k in kinds[f.name]):
                    c = c.cast("double")
                else:
                    c = c.cast("string")
            cols.append(c.alias(f.name))
        frames.append(p.df.select(*cols))
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    made = {c for c in clash if any("struct" in k or "array" in k for k in kinds[c])}
    present = set(df.columns)
    return Rows(df, json | frozenset(made), tuple((c, up) for c, up in order if c in present), parts[0].asked)
