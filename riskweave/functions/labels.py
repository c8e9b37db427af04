"""Ordered enumerations and their labels."""

from pyspark.sql import Column, functions as F

# Labels by ordinal.
SEVERITIES = ["INFO", "WARNING", "HIGH", "CRITICAL"]
CONFIDENCES = {1: "low", 2: "medium", 3: "high"}
TIERS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
# Option words; any other word means the default.
SEVERITY_LEVELS = {"info": 0, "warning": 1, "high": 2, "critical": 3}
CONFIDENCE_LEVELS = {"low": 1, "medium": 2, "high": 3}
DEFAULT_SEVERITY_LEVEL = 3
DEFAULT_CONFIDENCE_LEVEL = 1
# Report level by severity.
SARIF_LEVELS = {0: "note", 1: "warning", 2: "error", 3: "error"}


def _label(value: Column, names: dict[int, str], default: str) -> Column:
    expr = F.lit(default)
    for number, name in names.items():
        expr = F.when(value == number, name).otherwise(expr)
    return expr


def severity_label(value: Column) -> Column:
    return _label(value, dict(enumerate(SEVERITIES)), "UNKNOWN")


def confidence_label(value: Column) -> Column:
    return _label(value, CONFIDENCES, "unknown")


def tier_label(value: Column) -> Column:
    return _label(value, dict(enumerate(TIERS)), "UNKNOWN")


def sarif_level(value: Column) -> Column:
    return _label(value, SARIF_LEVELS, "none")


def severity_level(word: str) -> int:
    return SEVERITY_LEVELS.get(word, DEFAULT_SEVERITY_LEVEL)


def confidence_level(word: str) -> int:
    return CONFIDENCE_LEVELS.get(word.strip().lower(), DEFAULT_CONFIDENCE_LEVEL)
