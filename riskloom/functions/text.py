"""Text expressions: white space, scrubbing, entropy, shingles, verdicts, page diagnoses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed


def _by_first_letter(starts: list[str]) -> str:
    """Alternatives that each begin at a word with a letter, grouped by that letter: one look at a letter in place of a try of each. Their order among those of one letter stays."""
    grouped: dict[str, list[str]] = {}
    for x in starts:
        grouped.setdefault(x[0], []).append(x[1:])
    return r"\b(?:" + "|".join(f"{k}(?:{'|'.join(v)})" for k, v in grouped.items()) + ")"


BRAND_PATTERN = _by_first_letter(sorted(fixed.BRANDS, key=len, reverse=True)) + r"\b"
ACTION_PATTERN = _by_first_letter([x.removeprefix(r"\b") for x in fixed.ACTIONS])


def clean(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def scrubbed(text: Column) -> Column:
    """Brands as [BRAND], then calls to act as [ACTION]."""
    return F.regexp_replace(F.regexp_replace(text, "(?iuU)" + BRAND_PATTERN, "[BRAND]"), "(?iuU)" + ACTION_PATTERN, "[ACTION]")


def without_scripts(page: Column) -> Column:
    return F.regexp_replace(page, "(?is)" + fixed.SCRIPT_STYLE, "")


def verdict(score: Column) -> Column:
    return F.when(score >= fixed.PHISHING_FROM, "phishing").when(score >= fixed.SUSPICIOUS_FROM, "suspicious").otherwise("safe")


def percent(score: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * 100)


def challenges(page: Column) -> Column:
    return F.filter(F.array(*map(F.lit, fixed.CHALLENGES)), lambda s: F.contains(page, s))


def parked(page: Column) -> Column:
    return F.filter(F.array(*map(F.lit, fixed.PARKED)), lambda s: F.contains(F.lower(page), F.lower(s)))


def packed(text: Column) -> Column:
    """Without white space, in lower case; null counts as empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))
