"""The finding record and the columns derived from it."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions.text import let

FINDING = (
    "struct<detector:string,severity:string,category:string,description:string,"
    "pattern:string,line:int,points:int>"
)
FINDINGS = f"array<{FINDING}>"

# what a detector saw, before the file's total decides the severity
HIT = "struct<category:string,description:string,pattern:string,line:int,points:int>"

FILES_SCHEMA = (
    "repo_id string, path string, size bigint, is_symlink boolean, content binary"
)


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def rule_table(rows: list[dict], schema: str) -> Column:
    """Rules as one constant ``array<struct>``. They stay inside the expression: a
    join with a rule table would multiply the rows and their contents."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")


def hit(category, description, pattern=None, line=None, points=0) -> Column:
    """One hit struct; plain Python values become literals."""
    return F.struct(*map(_col, (category, description, pattern, line, points))).cast(HIT)


def hits_if(*conditional: tuple[Column, Column]) -> Column:
    """The hits whose condition holds."""
    return F.array_compact(F.array(*[F.when(condition, h) for condition, h in conditional]))


def to_findings(detector: str, hits: Column, severity="low") -> Column:
    """Hits as findings. ``severity`` is that of the scored ones: a name, or a function
    of the file's hits. Caution categories are routed to ``info``."""

    def build(found, scored):
        return F.transform(found, lambda h: F.struct(
            F.lit(detector), route_severity(h["category"], scored), h["category"],
            h["description"], h["pattern"], h["line"], h["points"],
        ).cast(FINDING))

    if callable(severity):
        found = let(hits, lambda hs: let(severity(hs), lambda scored: build(hs, scored)))
    else:
        found = build(hits, F.lit(severity))
    return or_none(found)


def no_findings() -> Column:
    return F.array().cast(FINDINGS)


def or_none(findings: Column) -> Column:
    """Findings, with an empty list in place of NULL."""
    return F.coalesce(findings, no_findings())


def total_points(findings: Column) -> Column:
    return F.aggregate(findings, F.lit(0), lambda acc, f: acc + f["points"])


def capped_score(findings: Column) -> Column:
    """File score. Points are never negative, so one cap after the sum is enough."""
    return F.least(F.lit(rules.MAX_SCORE), total_points(findings)).cast("double")


def route_severity(category: Column, default: Column | str) -> Column:
    """Categories that are good-practice notes become cautions."""
    return F.when(category.isin(rules.CAUTION_CATEGORIES), rules.CAUTION).otherwise(default)


def is_caution(severity: Column) -> Column:
    return severity == rules.CAUTION


def severity_rank(severity: Column) -> Column:
    rank = F.lit(rules.OTHER_SEVERITY_RANK)
    for name, position in rules.SEVERITY_RANK.items():
        rank = F.when(severity == name, position).otherwise(rank)
    return rank
