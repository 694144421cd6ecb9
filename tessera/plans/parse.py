"""JSON pipelines to stage objects; errors name what is wrong and where."""

from __future__ import annotations

from dataclasses import dataclass, field

OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "in")
AGGREGATES = ("count", "sum", "avg", "min", "max")
JOINS = ("left", "inner", "right", "full")
#: Where a stage names several, the first of these counts.
STAGES = ("match", "sort", "group", "project", "limit", "skip", "search", "lookup", "join", "union")


class PipelineError(ValueError):
    """The pipeline's text isn't a pipeline."""


@dataclass(frozen=True)
class Filter:
    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Match:
    filters: tuple[Filter, ...]
    any_of: bool = False


@dataclass(frozen=True)
class Sort:
    keys: tuple[tuple[str, bool], ...]  # path, ascending


@dataclass(frozen=True)
class Aggregate:
    op: str
    field: str | None
    name: str


@dataclass(frozen=True)
class Group:
    by: tuple[str, ...]
    aggregates: tuple[Aggregate, ...]


@dataclass(frozen=True)
class Project:
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Limit:
    n: int


@dataclass(frozen=True)
class Skip:
    n: int


@dataclass(frozen=True)
class Search:
    query: str
    partial: bool = False
    case_sensitive: bool = False
    metadata: bool = True


@dataclass(frozen=True)
class Lookup:
    source: str
    local: str
    foreign: str
    name: str


@dataclass(frozen=True)
class Join:
    source: str
    local: str
    foreign: str
    name: str
    how: str = "inner"


@dataclass(frozen=True)
class Union:
    collections: tuple[str, ...] = field(default_factory=tuple)


def _get(spec: dict, key: str, kind: type | tuple, default: object = ..., *names: str):
    for name in (key, *names):
        if name in spec:
            if not isinstance(spec[name], kind) or isinstance(spec[name], bool) and kind is int:
                raise PipelineError(f"{name}: expected {kind}, got {spec[name]!r}")
            return spec[name]
    if default is ...:
        raise PipelineError(f"missing {key}")
    return default


def _choice(value: str, choices: tuple[str, ...], what: str) -> str:
    if value not in choices:
        raise PipelineError(f"{what} must be one of {', '.join(choices)}, not {value!r}")
    return value


def _count(value: object, what: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise PipelineError(f"{what} must be a whole number that isn't negative")
    return value


def _strings(spec: dict, key: str) -> tuple[str, ...]:
    return tuple(x for x in _get(spec, key, list, []) if isinstance(x, str))


def stage(spec: object):
    """One stage object from one JSON object."""
    if not isinstance(spec, dict):
        raise PipelineError("a stage must be an object")
    name = next((s for s in STAGES if s in spec), None)
    if name is None:
        raise PipelineError(f"unknown stage: {', '.join(map(str, spec)) or 'empty'}")
    body = spec[name]
    if name in ("limit", "skip"):
        return (Limit if name == "limit" else Skip)(_count(body, name))
    if name == "sort":
        keys = body if isinstance(body, list) else [body]
        if not all(isinstance(k, dict) for k in keys):
            raise PipelineError("sort takes a list of objects")
        return Sort(tuple((_get(k, "field", str), _choice(_get(k, "order", str, "asc"), ("asc", "desc"), "order") == "asc") for k in keys))
    if not isinstance(body, dict):
        raise PipelineError(f"{name} takes an object")
    if name == "match":
        filters = tuple(Filter(_get(f, "field", str), _choice(_get(f, "op", str), OPERATORS, "op"), f.get("value")) for f in _get(body, "filters", list))
        return Match(filters, _choice(_get(body, "logic", str, "and"), ("and", "or"), "logic") == "or")
    if name == "group":
        made = tuple(Aggregate(_choice(_get(a, "op", str), AGGREGATES, "op"), a.get("field"), _get(a, "as", str)) for a in _get(body, "aggregations", list, []))
        return Group(tuple(_get(body, "by", list, [])), made)
    if name == "project":
        return Project(_strings(body, "include"), _strings(body, "exclude"))
    if name == "search":
        return Search(_get(body, "query", str), _get(body, "partial_match", bool, False), _get(body, "case_sensitive", bool, False), _get(body, "include_metadata", bool, True))
    if name == "union":
        return Union(_strings(body, "collections"))
    parts = (_get(body, "from", str), _get(body, "local_field", str), _get(body, "foreign_field", str), _get(body, "as", str))
    if name == "lookup":
        return Lookup(*parts)
    return Join(*parts, _choice(_get(body, "join_type", str, "inner", "type"), JOINS, "join_type"))


def pipeline(spec: object) -> list:
    """All stages of a JSON array."""
    if not isinstance(spec, list):
        raise PipelineError("a pipeline must be an array")
    return [stage(s) for s in spec]


def cross_pipeline(spec: object) -> tuple[str, list]:
    """``{source, stages}`` whose stages are lookup, join or union only."""
    if not isinstance(spec, dict):
        raise PipelineError("a cross pipeline must be an object")
    stages = [stage(s) for s in _get(spec, "stages", list)]
    if any(not isinstance(s, (Lookup, Join, Union)) for s in stages):
        raise PipelineError("a cross pipeline takes lookup, join and union only")
    return _get(spec, "source", str), stages
