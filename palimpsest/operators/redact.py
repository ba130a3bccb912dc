"""Secret redaction of captured text: an ordered pattern chain, then high-entropy runs near a tell-tale word."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest import config
from palimpsest.functions.text import entropy


#: Strings that every match of a pattern holds; without it a text need not be scanned.
HELD = {"openai_key": "sk-", "github_pat": "ghp_", "aws_access_key": "AKIA", "private_key_header": "-----BEGIN ", "bearer_token": "Bearer ", "db_connection_string": "://"}


def _bound(text: Column, step: Callable[[Column], Column]) -> Column:
    """step(text), the text being worked out once however often step names it."""
    return F.element_at(F.transform(F.array(text), step), 1)


def _where_held(held: str, pattern: str, marker: str) -> Callable[[Column], Column]:
    return lambda t: F.when(F.contains(t, F.lit(held)), F.regexp_replace(t, pattern, marker)).otherwise(t)


def redact_patterns(text: Column) -> Column:
    """Each pattern on the output of the one before."""
    for name, pattern, marker in config.REDACTION_PATTERNS:
        if name in HELD:
            text = _bound(text, _where_held(HELD[name], pattern, marker))
        else:
            text = F.regexp_replace(text, pattern, marker)
    return text


def pattern_counts(text: Column) -> dict[str, Column]:
    """Matches of each pattern in the text as it reaches that pattern."""
    out = {}
    for name, pattern, marker in config.REDACTION_PATTERNS:
        out[name] = F.regexp_count(text, F.lit(pattern)).cast("long")
        text = F.regexp_replace(text, pattern, marker)
    return out


def entropy_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(" + config.ENTROPY_RUN + ")"), F.lit(1))


def redact_entropy(text: Column) -> Column:
    """Runs in order; a telling run is replaced everywhere in the text so far."""

    def step(so_far: Column, run: Column) -> Column:
        at, w = F.position(run, so_far), config.ENTROPY_CONTEXT
        context = F.lower(F.substring(so_far, F.greatest(F.lit(1), at - w), F.least(F.lit(w), at - 1) + F.length(run) + w))
        told = F.lit(False)
        for word in config.ENTROPY_INDICATORS:
            told = told | F.contains(context, F.lit(word))
        return F.when((at > 0) & (entropy(run) >= config.ENTROPY_THRESHOLD) & told, F.replace(so_far, run, F.lit(config.ENTROPY_MARKER))).otherwise(so_far)

    def told_at_all(t: Column) -> Column:
        low = F.lower(t)
        return reduce(operator.or_, (F.contains(low, F.lit(word)) for word in config.ENTROPY_INDICATORS))

    return _bound(text, lambda t: F.when(told_at_all(t), F.aggregate(entropy_runs(t), t, step)).otherwise(t))


def redact(text: Column) -> Column:
    """Both steps; null and empty pass through."""
    return F.when(text.isNull() | (text == ""), text).otherwise(redact_entropy(redact_patterns(text)))
