"""Cleansing, times and identifiers: column functions and whole-table forms that take and return DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Texts that mean "missing", and columns whose dates mean the end of that day.
SENTINELS = ("", "nan", "nat", "none", "null", "<na>")
DAY_COLUMNS = ("chartdate", "storedate", "dod", "expirationdate")
PLAN_COLUMNS = ("starttime", "stoptime", "expirationdate", "scheduletime")
NTZ = "timestamp_ntz"


def present(c: Column) -> Column:
    """Not null and not a text that means missing."""
    return c.isNotNull() & ~F.lower(F.trim(c.cast("string"))).isin(*SENTINELS)


def null_sentinels(df: DataFrame) -> DataFrame:
    """Missing-value texts of all string columns become null, in one projection."""
    return df.select(*[F.when(present(df[f.name]), df[f.name]).alias(f.name) if isinstance(f.dataType, StringType) else df[f.name] for f in df.schema.fields])


def end_of_day(c: Column, fraction: int = 999999) -> Column:
    return F.date_trunc("day", c) .cast(NTZ) + F.expr(f"INTERVAL '0 23:59:59.{fraction:06d}' DAY TO SECOND")


def parse_time(c: Column, name: str = "", formats: Sequence[str] = ()) -> Column:
    """Time from text, null where it is none. Under a day column's name a value means that day's last instant."""
    parsed = F.coalesce(c.try_cast(NTZ), *[F.try_to_timestamp(c.cast("string"), F.lit(f)).cast(NTZ) for f in formats])
    return end_of_day(parsed) if name.lower() in DAY_COLUMNS else parsed


def parse_time_by_value(c: Column) -> Column:
    """As ``parse_time``, but the value's own form decides: a bare date means 23:59:59 of that day."""
    parsed = c.try_cast(NTZ)
    return F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), end_of_day(parsed, 0)).otherwise(parsed)


def coalesce_times(*times: Column) -> Column:
    return F.coalesce(*times)


def latest_times(*times: Column) -> Column:
    return F.greatest(*times) if len(times) > 1 else times[0]


def availability_time(times: Sequence[Column], mode: str = "latest") -> Column:
    return latest_times(*times) if mode == "latest" else coalesce_times(*times)


def normalize_id(c: Column) -> Column:
    """"123", 123 and "123.0" are one identifier; other texts are trimmed; missing is null."""
    text = F.trim(c.cast("string"))
    whole = F.regexp_extract(text, r"^([+-]?\d+)(\.0*)?$", 1)
    return F.when(~present(c), None).when(whole != "", whole).otherwise(text)


def normalize_scalar(c: Column) -> Column:
    """Numbers compare by value: an integral one loses its fraction, other texts are trimmed."""
    number = F.trim(c.cast("string")).try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(~present(c), None).when(whole, number.cast("bigint").cast("string")).when(number.isNotNull(), number.cast("string")).otherwise(F.trim(c.cast("string")))


def normalize_code(c: Column, width: int = 11) -> Column:
    """Text before the first point, filled up with zeros on the left; longer codes are kept whole."""
    head = F.split_part(F.trim(c.cast("string")), F.lit("."), F.lit(1))
    return F.when(F.length(head) < width, F.lpad(head, width, "0")).otherwise(head)


def before(t: Column, cutoff: Column) -> Column:
    """Known and strictly before the cutoff."""
    return F.coalesce(t < cutoff, F.lit(False))


def guard_field(field: Column, available: Column, cutoff: Column) -> Column:
    return F.when(before(available, cutoff), field)


def guard_completion(fields: Iterable[str], times: Sequence[Column], cutoff: Column) -> dict[str, Column]:
    """Fields that stay only if every completion time is known and before the cutoff; none known counts as open."""
    done = F.lit(bool(times))
    for t in times:
        done = done & before(t, cutoff)
    return {f: F.when(done, F.col(f)) for f in fields}


def time_like(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "time" in c.lower() or "date" in c.lower() or c.lower() == "dod"]


def sanitize_timestamps(df: DataFrame, cutoff: str, exempt: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """Time-like columns lose values at or after the cutoff column, and values that are no times; ``exempt``
    ones keep future values. Adds future_nulled and unparseable_nulled, counts per row."""
    names = list(columns if columns is not None else [c for c in time_like(df) if c != cutoff])
    parsed = {c: parse_time(F.col(c), c) for c in names}
    late = {c: F.lit(False) if c.lower() in exempt else F.coalesce(parsed[c] >= F.col(cutoff), F.lit(False)) for c in names}
    broken = {c: present(F.col(c)) & parsed[c].isNull() for c in names}
    total = lambda flags: sum((f.cast("int") for f in flags), F.lit(0))
    kept = [F.when(~late[c], parsed[c]).alias(c) if c in parsed else F.col(c) for c in df.columns]
    return df.select(*kept, total(late.values()).alias("future_nulled"), total(broken.values()).alias("unparseable_nulled"))


def mentions_later(text: Column, cutoff: Column) -> Column:
    """Whether a text holds a date or time later than the cutoff."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?)"), F.lit(1))
    return F.exists(found, lambda x: F.coalesce(F.replace(x, F.lit("T"), F.lit(" ")).try_cast(NTZ) > cutoff, F.lit(False)))


def sweep_future_text(df: DataFrame, columns: Sequence[str], cutoff: Column) -> DataFrame:
    """Texts that mention a later time become null; adds swept, their number per row."""
    hit = {c: F.coalesce(mentions_later(F.col(c), cutoff), F.lit(False)) for c in columns}
    kept = [F.when(~hit[c], F.col(c)).alias(c) if c in hit else F.col(c) for c in df.columns]
    return df.select(*kept, sum((h.cast("int") for h in hit.values()), F.lit(0)).alias("swept"))


def keep_columns(df: DataFrame, allowed: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in df.columns if c in allowed])


def drop_columns(df: DataFrame, denied: Sequence[str]) -> DataFrame:
    """Without the denied columns; adds redacted, the number of values that went per row."""
    gone = [c for c in df.columns if c in denied]
    return df.select(*[c for c in df.columns if c not in denied], sum((present(F.col(c)).cast("int") for c in gone), F.lit(0)).alias("redacted"))


def allow_rows(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return df.where(F.col(column).isin(*values)) if column in df.columns else df.where(F.lit(False))


def require_nonempty(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    some = F.lit(False)
    for c in columns:
        if c in df.columns:
            some = some | present(F.col(c))
    return df.where(some)


def prune_list(cell: Column, allowed: Column) -> Column:
    """Members of a pipe-joined cell that are allowed, if some but not all are; single members stay."""
    members = F.split(cell, r"\|")
    kept = F.filter(members, lambda x: F.array_contains(allowed, x))
    return F.when((F.size(members) > 1) & (F.size(kept) > 0) & (F.size(kept) < F.size(members)), F.array_join(kept, "|")).otherwise(cell)


def row_json(df: DataFrame) -> Column:
    """All columns as one JSON text; nulls are kept and times are written to the second."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss"})


def truncate_text(c: Column, limit: int) -> Column:
    return F.substring(c, 1, limit) if limit > 0 else c


def tri_state(c: Column, cutoff: Column) -> Column:
    """before, after or unknown. A bare date on the cutoff's day is unknown, unless the cutoff is the day's end."""
    t = c.cast("string").try_cast(NTZ)
    bare = F.trim(c.cast("string")).rlike(r"^\d{4}-\d{2}-\d{2}$")
    same = F.to_date(t) == F.to_date(cutoff)
    last = F.date_format(cutoff, "HH:mm:ss") == "23:59:59"
    return F.when(t.isNull(), "unknown").when(bare & same & ~last, "unknown").when(t > cutoff, F.when(bare & same, "before").otherwise("after")).otherwise("before")
