"""Risk bands, verdict labels and report figures computed from a score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import rules


def band(score: Column) -> Column:
    """Score to risk level; lower bounds are inclusive."""
    level = F.lit(rules.SAFE)
    for name, floor in reversed(rules.BANDS):
        level = F.when(score >= floor, name).otherwise(level)
    return level


def band_rank(level: Column) -> Column:
    """safe 0, low 1, ... critical 4."""
    rank = F.lit(0)
    for position, (name, _) in enumerate(reversed(rules.BANDS), start=1):
        rank = F.when(level == name, position).otherwise(rank)
    return rank


def _label(level: Column, labels: dict[str, str]) -> Column:
    text = F.lit(None).cast("string")
    for name, value in labels.items():
        text = F.when(level == name, value).otherwise(text)
    return text


def status(score: Column) -> Column:
    return _label(band(score), rules.STATUS)


def recommendation(score: Column) -> Column:
    return _label(band(score), rules.RECOMMENDATION)


def exceeds(score: Column, fail_on: str) -> Column:
    """True when the score reaches the band ``fail_on``; ``none`` never fails."""
    if fail_on == "none":
        return F.lit(False)
    return score >= dict(rules.BANDS)[fail_on]


def multi_factor(score: Column) -> list[Column]:
    zero, hundred = F.lit(0.0), F.lit(100.0)
    return [
        F.greatest(zero, 85 - score * 0.5).alias("code_quality"),
        F.greatest(zero, 100 - score).alias("security"),
        F.least(hundred, score * 0.7).alias("obfuscation"),
        F.least(hundred, score * 0.5).alias("malicious"),
    ]


def score_bar(value: Column, width: int = 20) -> Column:
    """``###---`` bar; the value is clamped to 0-100 and the fill truncated."""
    clamped = F.greatest(F.lit(0.0), F.least(value.cast("double"), F.lit(100.0)))
    filled = (clamped / 100 * width).cast("int")
    return F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("-"), F.lit(width) - filled))


def location(path: Column, line: Column) -> Column:
    """``path:line``, or the path alone when no line is known."""
    return F.concat_ws(":", path, line.cast("string"))


def short_description(description: Column, limit: int = 60) -> Column:
    return F.when(
        F.length(description) > limit, F.concat(F.left(description, F.lit(limit)), F.lit("..."))
    ).otherwise(description)


def repo_name(url: Column) -> Column:
    """Last path element without trailing slashes and without one ``.git``."""
    last = F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/]*)$", 1)
    return F.regexp_replace(last, r"\.git$", "")
