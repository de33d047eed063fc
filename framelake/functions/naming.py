"""What file paths say about their images, as column expressions.

Digit rules look at the whole path, name rules at the last path segment. Dates are assembled
from digits and not validated; :func:`observation_timestamp` is the validated twin.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from framelake.functions.measures import as_column

# Fixed values.
UNKNOWN = "UNKNOWN"
TYPE_WORDS = [("difference", "DIFFERENCE"), ("science", "SCIENCE"), ("template", "TEMPLATE")]
BANDS = ["g", "r", "i"]


def base_name(path: Column | str) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def _name_fields(path: Column | str) -> Column:
    return F.split(F.replace(base_name(path), F.lit(".fits"), F.lit("")), "_")


def object_id(path: Column | str) -> Column:
    return F.get(_name_fields(path), 0)


def image_type(path: Column | str) -> Column:
    return F.coalesce(F.upper(F.get(_name_fields(path), 1)), F.lit(UNKNOWN))


def type_from_substring(path: Column | str) -> Column:
    path = as_column(path)
    return first_match([(path.contains(word), name) for word, name in TYPE_WORDS])


def classify_by_patterns(
    path: Column | str, patterns: Mapping[str, str] | Sequence[tuple[str, str]]
) -> Column:
    """First (type, regular expression) pair found in the base name wins."""
    pairs = patterns.items() if isinstance(patterns, Mapping) else patterns
    name = base_name(path)
    return first_match([(name.rlike(pattern), kind) for kind, pattern in pairs])


def first_match(cases: Sequence[tuple[Column, str]], default: str = UNKNOWN) -> Column:
    result = F.lit(default)
    for condition, value in reversed(cases):
        result = F.when(condition, F.lit(value)).otherwise(result)
    return result


def digit_run(path: Column | str, digits: int) -> Column:
    """The first ``digits`` digits of the first run at least that long, else null."""
    return F.regexp_substr(as_column(path), F.lit(f"[0-9]{{{digits}}}"))


def telescope_id(path: Column | str) -> Column:
    return F.coalesce(F.left(digit_run(path, 10), F.lit(4)), F.lit(UNKNOWN))


def observation_time(path: Column | str) -> Column:
    run = digit_run(path, 10)
    part = lambda start: F.substring(run, start, 2)
    text = F.concat(
        F.lit("2025-"), part(3), F.lit("-"), part(5), F.lit("T"), part(7), F.lit(":"), part(9),
        F.lit(":00"),
    )
    return F.coalesce(text, F.lit(UNKNOWN))


def observation_timestamp(path: Column | str) -> Column:
    """Null where the digits form no calendar time."""
    return F.try_to_timestamp(observation_time(path), F.lit("yyyy-MM-dd'T'HH:mm:ss"))


def field_id(path: Column | str) -> Column:
    return F.substring(digit_run(path, 6), 1, 3).cast("int")


def ccd_id(path: Column | str) -> Column:
    return F.substring(digit_run(path, 6), 4, 2).cast("int")


def filter_band(ccd: Column | str) -> Column:
    """Detector 0 has no band."""
    ccd = as_column(ccd)
    return F.when(ccd != 0, F.get(F.array(*[F.lit(b) for b in BANDS]), F.pmod(ccd, F.lit(3))))


def observation_date(path: Column | str) -> Column:
    run = digit_run(path, 10)
    return F.concat(
        F.lit("20"), F.substring(run, 1, 2), F.lit("-"), F.substring(run, 3, 2), F.lit("-"),
        F.substring(run, 5, 2),
    )


def exposure_id(path: Column | str) -> Column:
    return digit_run(path, 10).cast("bigint")


def stable_bucket(path: Column | str, buckets: int) -> Column:
    """Bucket by content digest: the same on every run, executor and engine."""
    digest = F.conv(F.left(F.md5(as_column(path).cast("binary")), F.lit(8)), 16, 10).cast("bigint")
    return F.pmod(digest, F.lit(buckets)).cast("int")
