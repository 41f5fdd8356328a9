"""The filter record: a flat conjunction, checked before any plan is made."""

from __future__ import annotations

from dataclasses import dataclass, field

FIELD_OPS = {"exists", "eq", "ne", "gt", "gte", "lt", "lte", "contains", "includes", "one_of"}


class InvalidParams(ValueError):
    """The caller's parameters can't be used."""


@dataclass
class JoinFilter:
    direction: str = "outgoing"
    rel_type: str | list[str] | None = None
    target: NodeFilter | None = None


@dataclass
class NodeFilter:
    node_ids: list[str] | None = None
    without_node_ids: list[str] | None = None
    types: list[str] | None = None
    without_types: list[str] | None = None
    fields: dict[str, dict] = field(default_factory=dict)
    without_fields: list[str] | None = None
    references: dict | None = None
    title_eq: str | None = None
    title_contains: str | None = None
    without_titles: list[str] | None = None
    path_prefix: str | None = None
    without_path_prefix: str | None = None
    path_dir: str | None = None
    modified_since: str | None = None
    join_filters: list[JoinFilter] = field(default_factory=list)
    without_joins: list[JoinFilter] = field(default_factory=list)

    @classmethod
    def parse(cls, spec: dict, nested: bool = False) -> NodeFilter:
        """From the JSON form; unknown keys, unknown field operators and joins within joins are errors."""
        known = set(cls.__dataclass_fields__)
        if unknown := set(spec) - known:
            raise InvalidParams(f"unknown filter keys: {sorted(unknown)}")
        if nested and (spec.get("join_filters") or spec.get("without_joins")):
            raise InvalidParams("a join filter's target can't have joins of its own")
        for name, ops in spec.get("fields", {}).items():
            if bad := set(ops) - FIELD_OPS:
                raise InvalidParams(f"unknown operators on {name}: {sorted(bad)}")
            if "one_of" in ops and not ops["one_of"]:
                raise InvalidParams(f"one_of on {name} is empty")
        out = cls(**{k: v for k, v in spec.items() if k not in ("join_filters", "without_joins")})
        for key in ("join_filters", "without_joins"):
            for j in spec.get(key) or []:
                if not j.get("rel_type") and not j.get("target"):
                    raise InvalidParams("a join filter needs rel_type or target")
                if bad := set(j) - {"direction", "rel_type", "target"}:
                    raise InvalidParams(f"unknown join filter keys: {sorted(bad)}")
                target = cls.parse(j["target"], True) if j.get("target") else None
                getattr(out, key).append(JoinFilter(j.get("direction", "outgoing"), j.get("rel_type"), target))
        return out


@dataclass
class Page:
    """Sort and window of a result page."""

    sort_by: str = "title"
    sort_order: str = "asc"
    limit: int = 50
    offset: int = 0

    def __post_init__(self) -> None:
        if self.sort_by not in ("title", "file_mtime", "indexed_at") or self.sort_order not in ("asc", "desc"):
            raise InvalidParams("sort_by is title, file_mtime or indexed_at; sort_order asc or desc")
        if not 1 <= self.limit <= 200 or self.offset < 0:
            raise InvalidParams("limit is 1 to 200, offset 0 or more")
