"""Parsing with the four boolean conventions and the two timestamp conventions of the corpus contracts."""

from __future__ import annotations

import math
import re
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of the token mode.
TRUE_TOKENS, FALSE_TOKENS = ("true", "1"), ("false", "0")
#: The split contract's text.
SPLIT_CONTRACT = r"\s*train<([^;]+);\s*validation<([^;]+);\s*test>=([^;]+)\s*"
#: ISO 8601 with an offset.
AWARE = r"^\s*\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})\s*$"


def bool_text(text: Column) -> Column:
    """Lenient: true only for the word true in any case; null and everything else is false."""
    return F.coalesce(F.lower(text) == "true", F.lit(False))


def bool_filled(text: Column) -> Column:
    """Object-column truth: null is false, any non-empty string (the word false included) is true."""
    return F.coalesce(F.length(text) > 0, F.lit(False))


def bool_strict(text: Column) -> Column:
    """true or false in any case; anything else raises."""
    low = F.lower(F.trim(text))
    return F.when(low == "true", True).when(low == "false", False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def bool_strict_or_null(text: Column) -> Column:
    """As bool_strict, with null where that raises: for audits that count bad rows."""
    low = F.lower(F.trim(text))
    return F.when(low == "true", True).when(low == "false", False)


def bool_token_or_null(text: Column) -> Column:
    """true/false and 1/0; null where neither: for audits that count bad rows."""
    low = F.lower(F.trim(text))
    return F.when(low.isin(*TRUE_TOKENS), True).when(low.isin(*FALSE_TOKENS), False)


def bool_token(text: Column) -> Column:
    """true/false and 1/0; anything else raises."""
    return F.coalesce(bool_token_or_null(text), F.raise_error(F.concat(F.lit("not a boolean token: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def time_lenient(text: Column) -> Column:
    """A timestamp, or null where the text is none."""
    return F.try_to_timestamp(text)


def time_is_aware(text: Column) -> Column:
    """Whether the text is a timestamp with an offset."""
    return F.coalesce(text.rlike(AWARE), F.lit(False))


def time_strict(text: Column) -> Column:
    """A timestamp with an offset; null, malformed and naive texts raise."""
    return F.when(time_is_aware(text), F.to_timestamp(text)).otherwise(F.raise_error(F.concat(F.lit("not an aware timestamp: "), F.coalesce(text, F.lit("null")))).cast("timestamp"))


def visible_before(label_time: Column, cutoff: Column) -> Column:
    """Strict maturity: a label counts only if it was available before the cutoff; without a time it never is."""
    return F.coalesce(label_time < cutoff, F.lit(False))


def json_number(text: Column, path: str, default: int = 0) -> Column:
    """A number inside a JSON text; bad JSON, a missing field and null give the default."""
    return F.coalesce(F.get_json_object(text, path).try_cast("bigint"), F.lit(default))


def bounded_bin(text: Column, bins: int = 12) -> Column:
    """Histogram bin of a number in [0, 1]; null for what is no number."""
    number = text.try_cast("double")
    return F.when(number.isNotNull(), F.least(F.lit(bins - 1), F.floor(number * bins))).cast("int")


def month_of(text: Column) -> Column:
    """First seven characters of a timestamp's text, or ? if it is shorter."""
    return F.when(F.length(text) >= 7, F.substring(text, 1, 7)).otherwise(F.lit("?"))


def framed(*parts: Column) -> Column:
    """Bytes of several texts, each after its length in eight big-endian bytes: no two lists of texts give the same bytes."""
    return F.concat(*[F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), p.cast("binary")) for p in parts])


def framed_hash(*parts: Column) -> Column:
    return F.sha2(framed(*parts), 256)


def id_list_hash(ids: Column) -> Column:
    """SHA-256 (hex) of an array of texts: their number in eight bytes, then each after its length in eight bytes."""
    head = F.unhex(F.lpad(F.hex(F.size(ids)), 16, "0"))
    return F.sha2(F.concat(head, F.unhex(F.array_join(F.transform(ids, lambda x: F.concat(F.lpad(F.hex(F.octet_length(x)), 16, "0"), F.hex(x))), ""))), 256)


def ordered_hash(rows: DataFrame, key: str, number: str, part: int = 4096) -> DataFrame:
    """key, n, ids_hash: one hash of all numbers under a key in their order.

    No list holds more than ``part`` numbers that differ; what is listed for a key is a hash of 64 letters a part.
    """
    parts = rows.groupBy(key, F.floor(F.col(number) / part).alias("part")).agg(F.array_sort(F.collect_list(number)).alias("ids"))
    hashed = parts.select(key, "part", F.size("ids").alias("n"), id_list_hash(F.transform("ids", lambda x: x.cast("string"))).alias("h"))
    listed = hashed.groupBy(key).agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("part", "h"))).alias("parts"))
    return listed.select(key, "n", F.concat(F.lit("sha256:"), id_list_hash(F.transform("parts", lambda x: x["h"]))).alias("ids_hash"))


def slug(text: Column, most: int = 80) -> Column:
    """Letters, digits, dot, dash and underscore; other runs become one dash."""
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), 1, most)


def lcg_jitter(i: Column, span: int = 101) -> Column:
    """Deterministic pseudo-noise of an integer."""
    return (i.cast("bigint") * 1103515245 + 12345).bitwiseAND(F.lit(0x7FFFFFFF)) % span


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def bucket_start(time: Column, unit: str) -> Column:
    """Start of the month, quarter or other unit that holds the time."""
    return F.date_trunc(unit, time)


def edge_category(kind: Column, outcome: set[str], social: set[str]) -> Column:
    """outcome, social, or structural for all other edge types."""
    return F.when(kind.isin(*sorted(outcome)), "outcome").when(kind.isin(*sorted(social)), "social").otherwise("structural")


def matches_groups(rows: DataFrame, groups: dict[str, list]) -> DataFrame:
    """Rows that have, for each column, one of the values; a column without values does not filter."""
    for column, values in groups.items():
        if values:
            rows = rows.where(F.col(column).isin(*values))
    return rows


def is_finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def iso_utc(time: Column) -> Column:
    """ISO 8601 with microseconds where there are any, and the offset."""
    fraction = F.when(F.date_format(time, "SSSSSS") == "000000", F.lit("")).otherwise(F.concat(F.lit("."), F.date_format(time, "SSSSSS")))
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def as_utc(value: str | datetime) -> datetime:
    """A scalar time in UTC; one without an offset is taken as UTC."""
    time = datetime.fromisoformat(value.strip()) if isinstance(value, str) else value
    return time.replace(tzinfo=UTC) if time.tzinfo is None else time.astimezone(UTC)


def aware_cutoff(value: str | datetime) -> datetime:
    """A scalar cutoff in UTC, which must have an offset."""
    time = datetime.fromisoformat(value.strip()) if isinstance(value, str) else value
    if time is None or time.tzinfo is None:
        raise ValueError("a cutoff needs an offset")
    return time.astimezone(UTC)


def split_contract(splits: DataFrame, column: str = "temporal_cutoff") -> tuple[datetime, datetime]:
    """(train cutoff, test cutoff) of the one contract that all rows declare; its validation cutoff must be where test starts."""
    found = splits.where(F.col(column).isNotNull()).select(F.col(column).cast("string")).distinct().limit(2).collect()
    if len(found) != 1:
        raise ValueError("rows must declare one temporal cutoff contract")
    match = re.fullmatch(SPLIT_CONTRACT, found[0][0])
    if match is None:
        raise ValueError(f"unsupported temporal cutoff contract: {found[0][0]!r}")
    train, validation, test = map(as_utc, match.groups())
    if validation != test:
        raise ValueError("the validation cutoff must be where test starts")
    return train, test


def forbidden_paths(payload, names: set[str], at: str = "$") -> list[str]:
    """Where a nested payload has one of the names as a key."""
    if isinstance(payload, dict):
        return [f"{at}.{k}" for k in payload if k in names] + [x for k, v in payload.items() for x in forbidden_paths(v, names, f"{at}.{k}")]
    if isinstance(payload, (list, tuple)):
        return [x for i, v in enumerate(payload) for x in forbidden_paths(v, names, f"{at}[{i}]")]
    return []


def json_safe(value):
    """Nested values as JSON can hold them: sets sorted, times as ISO texts, numbers that are not finite refused."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        return [json_safe(v) for v in sorted(value)]
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if hasattr(value, "tolist"):
        return json_safe(value.tolist())
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("a number is not finite")
    if isinstance(value, (str, int, float, bool)) or value is None:
        return value
    raise TypeError(f"no JSON for {type(value).__name__}")
