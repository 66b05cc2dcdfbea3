"""Scopes: which rows a caller may see. Every scope becomes a predicate at the scan."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles from the least to the most powerful.
ROLES = ["investigator", "supervisor", "station-admin", "platform-admin"]
CROSS_CASE_ROLES = frozenset(ROLES[1:])


@dataclass(frozen=True)
class Scope:
    """Project-or-global, case and source are independent and all must hold; an empty scope is everything."""

    project_id: str | None = None
    only_global: bool = False
    case_id: str | None = None
    source: str | None = None

    def predicate(self, project: str = "project_id", is_global: str = "is_global", case: str = "case_id", source: str = "source") -> Column:
        parts = []
        if self.project_id is not None:
            parts.append((F.col(project) == self.project_id) | F.col(is_global))
        elif self.only_global:
            parts.append(F.col(is_global))
        if self.case_id is not None:
            parts.append(F.col(case) == self.case_id)
        if self.source is not None:
            parts.append(F.col(source) == self.source)
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def tool_scope(case_id: str | None, project_id: str | None, case: str = "case_id", project: str = "project_id", is_global: str = "is_global") -> Column:
    """The tool layer's variant: a case wins over a project, a project over global rows."""
    if case_id is not None:
        return F.col(case) == case_id
    if project_id is not None:
        return (F.col(project) == project_id) | F.col(is_global)
    return F.col(is_global)


def row_policy(active: bool, cross_case: bool, setting: str, case: str = "case_id", is_global: Column | None = None) -> Column:
    """Row-level policy: inactive, cross-case, global, the session's case, or no case where the setting is empty."""
    if not active or cross_case:
        return F.lit(True)
    own = F.col(case) == setting
    if setting == "":
        own = own | F.col(case).isNull()
    own = F.coalesce(own, F.lit(False))
    return own if is_global is None else own | F.coalesce(is_global, F.lit(False))


class AccessDenied(Exception):
    """A role may not run a query."""


def require_cross_case(role: str, audit: list[dict] | None = None, what: str = "") -> None:
    """Raise unless ``role`` may look across cases; either outcome is appended to ``audit``."""
    ok = role in CROSS_CASE_ROLES
    if audit is not None:
        audit.append({"event": "cross_case_query" if ok else "authorization_violation", "role": role, "detail": what})
    if not ok:
        raise AccessDenied(f"role {role!r} may not query across cases")


def require_case(case_id: str | None) -> str:
    """A case-scoped plan is only built for a named case."""
    if not case_id:
        raise ValueError("a case-scoped query needs a case")
    return case_id


def accessible(cases: DataFrame, assignments: DataFrame, user_id: object, role: str, min_role: str, case: str = "case_id", user: str = "user_id", case_role: str = "role") -> DataFrame:
    """Cases a user may see: all for platform-admin, else assigned ones whose role in the case is at least ``min_role``."""
    if role == "platform-admin":
        return cases
    rank = F.create_map(*[F.lit(x) for k, r in enumerate(ROLES) for x in (r, k)])
    mine = assignments.where((F.col(user) == F.lit(user_id)) & (rank[F.col(case_role)] >= ROLES.index(min_role)))
    return cases.join(mine.select(case), case, "left_semi")
