"""Column expressions shared by the operators. All of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.schema import DEFAULT_TIMEZONE

# --- fixed values -----------------------------------------------------------------------------
PRIORITY_LABELS = {0: "No priority", 1: "Urgent", 2: "High", 3: "Medium", 4: "Low"}
PROVIDER_BY_PREFIX = {
    "claude": "anthropic",
    "gpt": "openai",
    "o1": "openai",
    "o3": "openai",
    "o4": "openai",
}
STOP_REASONS = {"stop": "end_turn", "tool_calls": "tool_use", "length": "max_tokens"}
LEGAL_SUFFIXES = ("Inc", "LLC", "Ltd", "Corp", "Co", "GmbH", "S.A.")
METADATA_KEY = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")
# --- end of fixed values ----------------------------------------------------------------------


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def text_or_empty(value: Column | str) -> Column:
    return F.coalesce(as_col(value).cast("string"), F.lit(""))


def blank_to_null(value: Column | str) -> Column:
    column = as_col(value)
    return F.when(F.trim(column) != "", column)


def is_current(stale: Column | str = "stale") -> Column:
    return ~F.coalesce(as_col(stale), F.lit(False))


def contains_ignoring_case(text: Column | str, needle: str) -> Column:
    """Literal containment: `%` and `_` in the needle are ordinary characters."""
    return F.contains(F.lower(as_col(text)), F.lit(needle.lower()))


def local_day(moment: Column | str, timezone: str = DEFAULT_TIMEZONE) -> Column:
    """Calendar day of a UTC moment in the deployment's timezone."""
    return F.to_date(F.from_utc_timestamp(as_col(moment), timezone))


def moment(text: Column | str) -> Column:
    """ISO text as a timestamp, null when it is blank or not a time."""
    return F.try_to_timestamp(blank_to_null(text))


def source_time(
    metadata: Column | str = "metadata",
    created_at: Column | str = "created_at",
    prefer_change_time: bool = False,
) -> Column:
    """Event time of a record: the source's own time where there is one, else its arrival."""
    fields = ["received_at", "linear_created_at", "created_at"]
    if prefer_change_time:
        fields.insert(0, "changed_at")
    bag = as_col(metadata)
    return F.coalesce(*[moment(bag[name]) for name in fields], as_col(created_at))


def target_node(to_id: Column | str = "to_id", to_day: Column | str = "to_day") -> Column:
    """One non-null key for the far end of a fact, be it an entity or a day."""
    return F.coalesce(as_col(to_id), F.concat(F.lit("day:"), as_col(to_day).cast("string")))


def display_name(name: Column | str, to_day: Column | str) -> Column:
    return F.coalesce(as_col(name), as_col(to_day).cast("string"), F.lit("?"))


def words(text: Column | str) -> Column:
    return F.filter(F.split(as_col(text), r"(?U)\s+"), lambda w: w != "")


def grounding(fact: Column | str, content: Column | str) -> Column:
    """1.0 when the fact stands in the content, else the share of its distinct words that do."""
    needle, hay = F.lower(as_col(fact)), F.lower(as_col(content))
    distinct = F.array_distinct(words(needle))
    found = F.filter(distinct, lambda w: F.contains(hay, w))
    share = F.size(found) / F.greatest(F.size(distinct), F.lit(1))
    return F.when(F.contains(hay, needle), F.lit(1.0)).otherwise(share)


def ratio(part: Column | str, whole: Column | str, when_empty: float) -> Column:
    return F.when(as_col(whole) == 0, F.lit(when_empty)).otherwise(as_col(part) / as_col(whole))


def harmonic(precision: Column | str, recall: Column | str) -> Column:
    p, r = as_col(precision), as_col(recall)
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))


def lookup(value: Column, table: dict, default: Column) -> Column:
    """A small fixed table as a CASE expression."""
    result = None
    for key, label in table.items():
        arm = (value == F.lit(key), F.lit(label))
        result = F.when(*arm) if result is None else result.when(*arm)
    return result.otherwise(default)


def priority_label(code: Column | str) -> Column:
    c = as_col(code)
    return F.when(c.isNull(), F.lit("")).otherwise(lookup(c, PRIORITY_LABELS, c.cast("string")))


def provider_of(model: Column | str) -> Column:
    """Provider by model prefix; null when the prefix is not known."""
    head = F.lower(F.split_part(as_col(model), F.lit("-"), F.lit(1)))
    return lookup(head, PROVIDER_BY_PREFIX, F.lit(None).cast("string"))


def stop_reason(raw: Column | str) -> Column:
    given = F.coalesce(blank_to_null(raw), F.lit("unknown"))
    return lookup(given, STOP_REASONS, given)


def fresh_input(prompt_tokens: Column | str, cached_tokens: Column | str) -> Column:
    zero = F.lit(0)
    return F.coalesce(as_col(prompt_tokens), zero) - F.coalesce(as_col(cached_tokens), zero)


def stable_id(prefix: str, *parts: Column | str) -> Column:
    """Deterministic id: a recomputed task gives the row the same id again."""
    fields = [F.coalesce(as_col(p).cast("string"), F.lit("\u0000")) for p in parts]
    digest = F.sha2(F.concat_ws("\u001f", *fields), 256)
    return F.concat(F.lit(prefix + "_"), F.left(digest, F.lit(20)))


def normalised_company(name: Column | str) -> Column:
    """A company name without its legal suffix."""
    suffixes = "|".join(re.escape(s.rstrip(".")) for s in LEGAL_SUFFIXES)
    return F.trim(F.regexp_replace(as_col(name), rf"(?i)(,?\s+(?:{suffixes})\.?)+\s*$", ""))
