"""Detection limits: how a raw value is read, and the two series that stand in for censored values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes of censoring, in the order in which they are declared.
CLASSES = ["none", "below_lod", "not_detected", "above_lod", "unknown"]
_BELOW_SUFFIX = "未満"


def _limit(number: Column, raw: Column) -> Column:
    parsed = number.try_cast("double")
    return F.when(parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("no limit can be read from "), raw)).cast("double"))


def classify(raw: Column) -> Column:
    """struct(censoring, censoring_limit) of a raw value. '<x' and 'x未満' lie below a limit, '>x' above one, 'ND' is not detected; a limit that is no number is an error."""
    s = F.trim(raw)
    below = F.when(s.startswith("<"), F.substring(s, F.lit(2), F.length(s))).when(s.endswith(_BELOW_SUFFIX), F.substring(s, F.lit(1), F.length(s) - len(_BELOW_SUFFIX)))
    above = F.when(s.startswith(">"), F.substring(s, F.lit(2), F.length(s)))
    kind = F.when(s.startswith("<"), "below_lod").when(s == "ND", "not_detected").when(s.startswith(">"), "above_lod").when(s.endswith(_BELOW_SUFFIX), "below_lod").otherwise("none")
    limit = F.when(kind == "below_lod", _limit(below, raw)).when(kind == "above_lod", _limit(above, raw))
    return F.struct(kind.alias("censoring"), limit.alias("censoring_limit"))


def resolved(censoring: Column, value: Column) -> Column:
    """The value of an uncensored row; null for all others."""
    return F.when(censoring == "none", value)


def zero_series(censoring: Column, value: Column) -> Column:
    """0 for what lies below a limit, nothing for what isn't detected, else the value."""
    return F.when(censoring == "below_lod", F.lit(0.0)).when(censoring == "not_detected", F.lit(None).cast("double")).otherwise(value)


def limit_series(censoring: Column, value: Column, limit: Column) -> Column:
    """The limit for what lies below it, nothing for what isn't detected, else the value."""
    return F.when(censoring == "below_lod", limit).when(censoring == "not_detected", F.lit(None).cast("double")).otherwise(value)


def is_member(v_zero: Column, censoring: Column) -> Column:
    """Whether a row counts in its cell: it has a value, or is known not to be detected."""
    return v_zero.isNotNull() | (censoring == "not_detected")
