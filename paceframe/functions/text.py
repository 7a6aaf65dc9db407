"""Text handling: codes, names, keys, normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def athlete_code(athlete_id: Column) -> Column:
    """``AT-`` plus the id padded to three digits at least; longer ids stay whole, so codes differ as ids do."""
    digits = athlete_id.cast("string")
    return F.concat(F.lit("AT-"), F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits))


def full_name(first: Column, last: Column) -> Column:
    """First and last name joined by one blank; a missing part counts as empty."""
    return F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit("")))


def first_positive_int(x: Column) -> Column:
    """The first run of digits as a number, NULL when there is none or it is zero."""
    value = F.regexp_extract(F.trim(x), r"(\d+)", 1).try_cast("bigint")
    return F.when(value > 0, value)


def session_key(athlete_id: Column, session_id: Column) -> Column:
    """Message key of a session."""
    return F.concat_ws("-", athlete_id.cast("string"), session_id.cast("string"))


def normalise_choice(x: Column, aliases: dict[str, str], default: str) -> Column:
    """Trim and lower-case, apply the default to missing text, map aliases, NULL for anything else."""
    given = F.when(F.coalesce(x, F.lit("")) == "", F.lit(default)).otherwise(x)
    cleaned = F.lower(F.trim(given))
    chosen = F.lit(None).cast("string")
    for alias, value in aliases.items():
        chosen = F.when(cleaned == alias, F.lit(value)).otherwise(chosen)
    return chosen


def words(x: Column) -> Column:
    """Lower-cased words split on white space; empty pieces are for the caller to drop."""
    return F.split(F.lower(x), r"\s+")


def alarm_text(athlete: Column, still_for: Column, lat: Column, lon: Column, bpm: Column) -> Column:
    """Message of a stillness alarm; the place of a missing heart rate stays empty."""
    # Fixed value: message format.
    template = "Atleta %s fermo da %d s in posizione %.6f, %.6f (bpm %.0f)"
    return F.format_string(template, athlete, still_for, lat, lon, bpm)


def is_duration(x: Column) -> Column:
    """True for a duration such as ``30s``, ``2m`` or ``1h``."""
    return F.coalesce(F.trim(x).rlike(r"^[0-9]+[smh]$"), F.lit(False))


def one_of(x: Column, allowed: Sequence[str]) -> Column:
    """Membership that is false, not NULL, for a missing value."""
    return F.coalesce(x.isin(*allowed), F.lit(False))
