"""Malicious patterns, long lines, dangerous functions and network use."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions.findings import hit, rule_table, to_findings
from riskloom.functions.text import language, let, line_of_literal, line_of_regex

_PLAIN = re.compile(r"(?:\w|\\\.|\\\()+")
_GAP = re.compile(r"\.\{0,200\}|\([a-z|]+\)")


def _rule(category: str, pattern: str) -> dict:
    """A pattern that is only an escaped literal is searched as such. Any other keeps
    its regex and lists the literals that every match contains."""
    plain = _PLAIN.fullmatch(pattern) is not None
    parts = [pattern] if plain else [part for part in _GAP.split(pattern) if part]
    return {
        "category": category, "pattern": pattern,
        "literals": [part.replace("\\", "") for part in parts],
        "regex": None if plain else f"(?d){pattern}",
    }


def _matching(folded: Column, patterns: list[tuple[str, str]]) -> Column:
    """``(category, pattern)`` rules that match the folded text, in rule order.

    A regex costs far more per character than a literal search, so it is tried only
    where all its literals occur.
    """
    table = rule_table(
        [_rule(category, pattern) for category, pattern in patterns],
        "category:string,pattern:string,literals:array<string>,regex:string",
    )
    return F.filter(table, lambda r: (
        F.forall(r["literals"], lambda literal: F.contains(folded, literal))
        & (r["regex"].isNull() | F.rlike(folded, r["regex"]))
    ))


def _first_line(folded: Column, rule: Column) -> Column:
    return F.when(
        rule["regex"].isNull(), line_of_literal(folded, F.get(rule["literals"], 0))
    ).otherwise(line_of_regex(folded, rule["regex"]))


def malicious(folded: Column, patterns: dict[str, list[str]] | None = None) -> Column:
    """Each pattern counts once per file, at its first match. All become medium when
    the file's patterns exceed 20 points."""
    ordered = [
        (category, pattern)
        for category, group in (patterns or rules.MALICIOUS_PATTERNS).items() for pattern in group
    ]
    hits = F.transform(_matching(folded, ordered), lambda r: hit(
        r["category"], F.concat(F.lit("Malicious pattern: "), r["pattern"]), r["pattern"],
        _first_line(folded, r), rules.POINTS_PATTERN,
    ))
    return to_findings("malicious", hits, malicious_severity)


def malicious_severity(hits: Column) -> Column:
    return F.when(F.size(hits) * rules.POINTS_PATTERN > rules.MEDIUM_ABOVE, "medium").otherwise("low")


def network(folded: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """Network calls, as unscored cautions at their first line."""
    ordered = [(label, pattern) for pattern, label in patterns or rules.NETWORK_PATTERNS]
    return to_findings("network", F.transform(
        _matching(folded, ordered),
        lambda r: hit("network", r["category"], line=_first_line(folded, r)),
    ))


def long_lines(text: Column) -> Column:
    """Every line over 500 characters, as an unscored caution."""
    lines = F.transform(F.split(text, "\n"), lambda line, i: F.struct(
        (i + 1).alias("line"), F.char_length(line).alias("chars")
    ))
    hits = F.transform(
        F.filter(lines, lambda x: x["chars"] > rules.LONG_LINE),
        lambda x: hit("long_line", F.concat(
            F.when(x["chars"] > rules.EXTREMELY_LONG_LINE, "extremely long line: ")
            .otherwise("long line: "),
            x["chars"].cast("string"), F.lit(" chars"),
        ), line=x["line"]),
    )
    return to_findings("long_line", F.when(F.char_length(text) > rules.LONG_LINE, hits))


def dangerous_functions(
    text: Column, extension: Column, functions: dict[str, list[str]] | None = None
) -> Column:
    """Case-sensitive substrings by language, once per function, at the first line."""
    table = rule_table(
        [{"language": lang, "name": name}
         for lang, names in (functions or rules.DANGEROUS_FUNCTIONS).items() for name in names],
        "language:string,name:string",
    )
    called = let(language(extension), lambda lang: F.filter(
        table, lambda r: (r["language"] == lang) & F.contains(text, r["name"])
    ))
    return to_findings("dangerous_fn", F.transform(called, lambda r: hit(
        "dangerous_function", F.concat(F.lit("Dangerous function: "), r["name"]),
        line=line_of_literal(text, r["name"]), points=rules.POINTS_FUNCTION,
    )))
