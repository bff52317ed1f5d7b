"""Hard-coded credentials.

Decided here, as the rule set leaves it open: a masked value shows its first four
characters and one ``*`` per hidden character; patterns run over the whole text; a
value found more than once on one line is kept once, under the first pattern.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import rules
from riskloom.functions.findings import hit, rule_table, to_findings
from riskloom.functions.text import let, mask, match_lines, to_java

# Literals every match contains, checked before the regex runs. The
# first list is matched as written; the second with case ignored.
_GATES = {
    "AWS Access Key ID": (["AKIA"], []),
    "AWS Secret Access Key": (["aws_secret_access_key"], []),
    "GitHub Token": (["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], []),
    "GitLab Token": (["glpat-"], []),
    "Slack Token": (["xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"], []),
    "Slack Webhook": (["https://hooks.slack.com/services/"], []),
    "Google API Key": (["AIza"], []),
    "Stripe Key": (["sk_live_", "sk_test_", "pk_live_", "pk_test_"], []),
    "Private Key Block": (["PRIVATE KEY-----"], []),
    "JWT": (["eyJ"], []),
    "Generic API Key Assignment": ([], ["apikey", "api_key", "api-key"]),
    "Generic Secret Assignment": ([], ["secret", "token"]),
    "Hardcoded Password": ([], ["password"]),
    "Twilio API Key": (["SK"], []),
    "SendGrid API Key": (["SG."], []),
}
_NO_GATE = ([""], [])

# The plain token pattern tries every "eyJ" of a long run and is quadratic. Within
# one segment only the first "eyJ" can start a match, so each segment is entered at
# its start and walked once.
_JWT_LINEAR = (
    r"(?<![A-Za-z0-9_-])(?>[A-Za-z0-9_-]*?(?=eyJ))"
    r"(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)"
)


def _rule(name: str, pattern: str) -> dict:
    as_written, any_case = _GATES.get(name, _NO_GATE)
    return {
        "name": name, "regex": _JWT_LINEAR if name == "JWT" else to_java(pattern),
        "as_written": as_written, "any_case": any_case,
    }


def is_placeholder(value: Column) -> Column:
    markers = rule_table([{"text": m} for m in rules.SECRET_PLACEHOLDERS], "text:string")
    return F.exists(markers, lambda m: F.contains(F.lower(value), m["text"]))


def secrets(text: Column, folded: Column, patterns: dict[str, str] | None = None) -> Column:
    """All matches of all patterns, in pattern order, placeholders dropped."""
    table = rule_table(
        [_rule(name, pattern) for name, pattern in (patterns or rules.SECRET_PATTERNS).items()],
        "name:string,regex:string,as_written:array<string>,any_case:array<string>",
    )
    possible = F.filter(table, lambda r: (
        F.exists(r["as_written"], lambda literal: F.contains(text, literal))
        | F.exists(r["any_case"], lambda literal: F.contains(folded, literal))
    ))

    def matches(r):
        """Lines take two more passes over the text, so they are looked for on a match only."""
        return let(F.regexp_extract_all(text, r["regex"], F.lit(1)), lambda values: F.when(
            F.size(values) > 0, F.zip_with(values, match_lines(text, r["regex"]), lambda value, line: F.struct(
                r["name"].alias("name"), value.alias("value"), line.alias("line")
            ))
        ))

    found = F.flatten(F.filter(F.transform(possible, matches), lambda listed: listed.isNotNull()))
    real = F.filter(found, lambda c: ~is_placeholder(c["value"]))
    return to_findings("secrets", F.transform(_first_per_value_and_line(real), lambda c: hit(
        "secret", F.concat(c["name"], F.lit(" detected: "), mask(c["value"])),
        line=c["line"], points=rules.POINTS_SECRET,
    )), "critical")


def _first_per_value_and_line(found: Column) -> Column:
    """Sorting by (line, value, position) puts repeats next to each other, so the test
    looks at one neighbour; the result is back in pattern order."""
    ordered = F.sort_array(F.transform(found, lambda c, i: F.struct(
        c["line"].alias("line"), c["value"].alias("value"),
        i.alias("pos"), c["name"].alias("name"),
    )))

    def firsts(sorted_):
        def starts_group(c, i):
            before = F.get(sorted_, i - 1)
            return (i == 0) | (before["line"] != c["line"]) | (before["value"] != c["value"])
        return F.filter(sorted_, starts_group)

    return F.sort_array(F.transform(let(ordered, firsts), lambda c: F.struct(
        c["pos"].alias("pos"), c["name"].alias("name"),
        c["value"].alias("value"), c["line"].alias("line"),
    )))
