"""Scalar expressions. All are native columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions import contracts as C

INSTANT = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
#: Date, time, optional fraction and a zone, which is required.
INSTANT_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"


def epoch_millis(t: Column) -> Column:
    return F.unix_millis(t)


def format_instant(t: Column) -> Column:
    """ISO text in UTC with milliseconds, cut off, not rounded. The session's zone must be UTC."""
    return F.date_format(t, INSTANT)


def parse_instant(text: Column) -> Column:
    """Timestamp of an ISO text with a zone; null for anything else. Six digits of a fraction count."""
    exact = F.regexp_replace(text, r"(\.\d{6})\d+", "$1")
    return F.when(text.rlike(INSTANT_PATTERN), F.try_to_timestamp(exact))


def alert_id(machine: Column, window_start: Column, model_name: Column, model_version: Column) -> Column:
    """Name-based UUID (version 5) of the alert's four parts; null when a part is empty or holds the separator."""
    name = F.concat_ws("|", machine, format_instant(window_start), model_name, model_version)
    digest = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(C.ALERT_NAMESPACE).hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    text = F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )
    good = window_start.isNotNull()
    for part in (machine, model_name, model_version):
        good &= (F.length(part) > 0) & ~part.contains("|")
    return F.when(good, text)


def ratio_to_speed(signal: Column, rpm: Column) -> Column:
    """Signal per revolution; null when either is missing or the machine hardly turns."""
    return F.when(rpm >= 1, signal / rpm)


def null_count() -> Column:
    return sum((F.col(s).isNull().cast("int") for s in C.SENSORS), F.lit(0))


def schema_major_is_one(version: Column) -> Column:
    return version.startswith("1.")


def tolerant(value: Column, domain: tuple[str, ...]) -> Column:
    """The value, ``UNKNOWN`` when it is none of the domain; null stays null."""
    return F.when(value.isNull(), F.lit(None)).when(value.isin(*domain), value).otherwise("UNKNOWN")


def strict(value: Column, domain: tuple[str, ...]) -> Column:
    """Whether a strict reader accepts the value: one of the domain, or null."""
    return F.coalesce(value.isin(*domain), F.lit(True))


def epoch_floor(seconds: Column, step: int) -> Column:
    return F.floor(seconds / step) * step


def finite(x: Column) -> Column:
    """The number, null when it is not finite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def feature_array() -> Column:
    return F.array(*[finite(F.col(n).cast("double")) for n in C.feature_names()])


def feature_map() -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, C.feature_names())), feature_array())


def json_encode(value: Column) -> Column:
    """Compact JSON with null fields kept."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def base64_plain(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(data), r"\s", "")


def unbase64_tolerant(text: Column) -> Column:
    return F.unbase64(F.regexp_replace(text, r"\s", ""))


def partition_key(machine: Column) -> Column:
    """Key bytes of a message; null for an empty identifier, which has no partition."""
    return F.when(F.length(machine) > 0, F.encode(machine, "UTF-8"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, digest): a digest of the table that does not depend on the order of its rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    half = [F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16, 31, 46)]
    sums = [F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i, h in enumerate(half)]
    total = df.agg(F.count(F.lit(1)).alias("rows"), *sums)
    return total.select("rows", F.sha2(F.concat_ws("|", "rows", *[f"s{i}" for i in range(4)]), 256).alias("digest"))
