"""Severity rules. Three different rules exist on purpose and must not be unified.

``errors_total`` counts as an error for the substring rule but not for the word rule;
``warned`` matches the open-ended prefix rule but not the word filter.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ["error", "warn", "info", "debug"]

# The word filters, case-insensitive with Unicode case folding.
LEVEL_PATTERNS = {
    "error": r"(?iU)\berror\b",
    "warning": r"(?iU)\bwarn(ing)?\b",
    "debug": r"(?iU)\bdebug\b",
    "info": r"(?iU)\binfo\b",
}


def matches_level(line: Column, level: str | None) -> Column | None:
    """Word filter for ``level``; None when the level means "every line"."""
    pattern = LEVEL_PATTERNS.get(level or "all")
    return None if pattern is None else line.rlike(pattern)


def _first_substring(line: Column, order: list[str]) -> Column:
    low = F.lower(line)
    chain = F.when(low.contains(order[0]), order[0])
    for level in order[1:]:
        chain = chain.when(low.contains(level), level)
    return chain.otherwise("none")


def level_by_substring(line: Column) -> Column:
    """Catalog and viewer rule: error, then warn, info, debug."""
    return _first_substring(line, ["error", "warn", "info", "debug"])


def level_in_merge(line: Column) -> Column:
    """Merged-view rule: debug is tested before info."""
    return _first_substring(line, ["error", "warn", "debug", "info"])


def level_by_word(line: Column) -> Column:
    """Colouring rule: whole words, except that ``warn`` is only a word prefix."""
    low = F.lower(line)
    return (F.when(low.rlike(r"\berror\b"), "error")
            .when(low.rlike(r"\bwarn"), "warn")
            .when(low.rlike(r"\bdebug\b"), "debug")
            .when(low.rlike(r"\binfo\b"), "info")
            .otherwise("none"))


def level_counts(level: Column) -> list[Column]:
    """One exclusive count per level, ready for ``agg``."""
    return [F.count_if(level == name).alias(f"{name}_count") for name in LEVELS]
