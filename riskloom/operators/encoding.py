"""Base64 payloads and base64 calls, and high byte entropy."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions.entropy import high_entropy_runs
from riskloom.functions.findings import hit, hits_if, rule_table, to_findings, total_points
from riskloom.functions.text import line_of_literal

# The run pattern with its character class spelled out: Java looks a listed character
# up in one table, but tests ranges one after the other.
_LISTED = string.ascii_letters + string.digits + "+/"
BASE64_RUN = rules.BASE64_RUN.replace("[A-Za-z0-9+/]", f"[{_LISTED}]")


def base64_shaped(text: Column) -> Column:
    """Runs of at least 40 base64 characters whose length is a multiple of 4."""
    return F.filter(
        F.regexp_extract_all(text, F.lit(BASE64_RUN), F.lit(0)),
        lambda run: F.length(run) % 4 == 0,
    )


def base64_runs(text: Column, few: int = rules.BASE64_FEW) -> Column:
    """``struct<n, first>`` over the shaped runs with an entropy of 4.5 bits or more.

    Two or fewer candidates can never be reported, so their text stays in the JVM.
    """
    shaped = base64_shaped(text)
    return high_entropy_runs(F.when(F.size(shaped) > few, shaped))


def counted_runs(n: Column, line: Column) -> Column:
    """The hit for ``n`` runs, the first of them on ``line``."""
    many = n > rules.BASE64_MANY
    return hits_if((n > rules.BASE64_FEW, hit(
        "encoding",
        F.concat(F.when(many, "Multiple base64 strings: ").otherwise("Base64 strings: "), n.cast("string")),
        line=line,
        points=F.when(many, rules.POINTS_BASE64_MANY).otherwise(rules.POINTS_BASE64_FEW),
    )))


def base64_calls(text: Column, folded: Column) -> Column:
    """The hits for base64 functions, each at its first line."""
    calls = rule_table(
        [dict(zip(("literal", "description", "points"), call)) for call in rules.BASE64_CALLS],
        "literal:string,description:string,points:int",
    )
    lowered = F.lower(text)
    # the folded text contains every literal that the lower-cased one does; lower-casing
    # again is only paid on a hit
    called = F.filter(calls, lambda c: (
        F.contains(folded, c["literal"]) & F.contains(lowered, c["literal"])
    ))
    return F.transform(called, lambda c: hit(
        "encoding", c["description"], line=line_of_literal(lowered, c["literal"]), points=c["points"],
    ))


def encoding_severity(hits: Column) -> Column:
    return F.when(total_points(hits) > rules.MEDIUM_ABOVE, "medium").otherwise("low")


def base64_findings(text: Column, folded: Column, runs: Column) -> Column:
    """``runs`` is the result of :func:`base64_runs`. Medium above 20 points in all."""
    counted = counted_runs(runs["n"], line_of_literal(text, runs["first"]))
    return to_findings("base64", F.concat(counted, base64_calls(text, folded)), encoding_severity)


def high_entropy(entropy: Column) -> Column:
    """One finding for content of more than 7.5 bits per byte."""
    description = F.concat(
        F.lit("High entropy: "), F.format_string("%.2f", F.bround(entropy, 2)),
        F.lit(" (possible obfuscation)"),
    )
    return to_findings("entropy", hits_if((
        entropy > rules.HIGH_ENTROPY,
        hit("obfuscation", description, points=rules.POINTS_ENTROPY),
    )), "medium")
