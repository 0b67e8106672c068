"""Date expressions. The run date is always an explicit ``as_of`` column; nothing reads the clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import labels as L
from ..vocab import RuleSet
from .patterns import SPACE, WORD, bounded, built_once, extract, let
from .text import strip

# Day counts of the units in relative dates.
UNIT_DAYS = {"minute": 0, "min": 0, "hour": 0, "hr": 0, "day": 1, "week": 7, "month": 30, "year": 365}
LOCAL_UNIT_DAYS = {"דקות": 0, "דקה": 0, "שעות": 0, "שעה": 0, "ימים": 1, "יום": 1, "שבועות": 7, "שבוע": 7,
                   "חודשים": 30, "חודש": 30, "שנים": 365, "שנה": 365}
LOCAL_WORD_DAYS = {"יומיים": 2, "שבועיים": 14, "חודשיים": 60, "שעתיים": 0, "יום": 1, "שבוע": 7, "חודש": 30,
                   "שעה": 0, "דקה": 0}
TODAY_WORDS = ("just now", "today", "just posted", "few hours ago", "few minutes ago")
LOCAL_TODAY_WORDS = ("היום", "עכשיו")
YESTERDAY_WORD, LOCAL_YESTERDAY_WORD = "yesterday", "אתמול"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december")

_ISO = (r"([0-9]{4})-([0-9]{2})-([0-9]{2})"
        r"(?:[t ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?:\.[0-9]+)?(z|[+\-][0-9]{2}:?[0-9]{2})?)?")
_DMY = rf"(?<![{WORD}])([0-9]{{1,2}})[./]([0-9]{{1,2}})[./]([0-9]{{2,4}})(?![{WORD}])"
_MONTH_FIRST = rf"^([a-z]+){SPACE}+([0-9]{{1,2}}),?{SPACE}+([0-9]{{4}})$"
_DAY_FIRST = rf"^([0-9]{{1,2}}){SPACE}+([a-z]+){SPACE}+([0-9]{{4}})$"
_NAMED = rf"^(?:[a-z]+{SPACE}+[0-9]{{1,2}}|[0-9]{{1,2}}(?:st|nd|rd|th)?{SPACE}+[a-z]).*[0-9]{{4}}$"
_EPOCH = r"^[0-9]{9,15}$"


def _days(units: dict[str, int], name: Column) -> Column:
    expr = None
    for unit, days in units.items():
        expr = F.when(name == unit, days) if expr is None else expr.when(name == unit, days)
    return expr


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """A date, or null when there is no such day."""
    return F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def local_date(utc: Column, zone: str) -> Column:
    """A UTC wall-clock time (no zone) as a date in ``zone``; independent of the session time zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc).cast("date")


def epoch_to_local_date(number: Column, zone: str) -> Column:
    """Epoch seconds, or milliseconds above 1e11, as a local date."""
    seconds = F.when(number > F.lit(100_000_000_000), number / 1000).otherwise(number)
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return local_date(start + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")), zone)


def _iso_date(low: Column, zone: str) -> Column:
    def piece(group: int) -> Column:
        return F.regexp_extract(low, _ISO, group)

    offset = piece(7)
    wall = F.concat(piece(1), F.lit("-"), piece(2), F.lit("-"), piece(3), F.lit(" "), piece(4), F.lit(":"), piece(5),
                    F.lit(":"), F.when(piece(6) == "", "00").otherwise(piece(6))).try_cast("timestamp_ntz")
    digits = F.regexp_replace(offset, "[^0-9]", "")
    minutes = (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")) * F.when(
        offset.startswith("-"), -1).otherwise(1)
    shift = F.when(offset == "z", 0).when(offset != "", minutes)
    instant = local_date(wall - F.make_dt_interval(mins=shift), zone)
    return F.coalesce(instant, _ymd(piece(1), piece(2), piece(3)))


def _named_month(low: Column) -> Column:
    text = F.regexp_replace(low, "([0-9])(?:st|nd|rd|th)", "$1")
    names = F.create_map(*[F.lit(v) for i, m in enumerate(MONTHS, 1) for v in (m, str(i))],
                         *[F.lit(v) for i, m in enumerate(MONTHS, 1) if m != "may" for v in (m[:3], str(i))])

    def build(pattern: str, month: int, day: int) -> Column:
        return _ymd(extract(text, pattern, 3), F.try_element_at(names, extract(text, pattern, month)),
                    extract(text, pattern, day))

    return F.coalesce(build(_MONTH_FIRST, 1, 2), build(_DAY_FIRST, 2, 1))


def _back(as_of: Column, count: Column, unit_days: Column) -> Column:
    days = count.try_cast("int") * unit_days
    return F.date_sub(as_of, F.when(F.length(count) <= 6, days))


@built_once
def parse_posting_date(raw: Column, as_of: Column, rules: RuleSet) -> Column:
    """Absolute and relative date texts to a local date; null when it cannot be told.

    The attempts are ordered. A text that looks like an ISO or d/m/y date but names no real day
    is null and is not tried further. A text of 9 or more digits is an epoch number.
    """
    return let(F.translate(strip(raw), "‎‏", ""), lambda text: let(
        F.lower(text), lambda low: _parse(raw, text, low, as_of, rules.business_zone)))


def _parse(raw: Column, text: Column, low: Column, as_of: Column, zone: str) -> Column:
    units = "|".join(UNIT_DAYS)
    local_units = "|".join(LOCAL_UNIT_DAYS)
    local_words = "|".join(LOCAL_WORD_DAYS)
    ago = rf"([0-9]+)\+?{SPACE}*({units})s?{SPACE}*ago"
    local_count = rf"([0-9]+)\+?{SPACE}*({local_units})"
    local_word = rf"לפני{SPACE}+({local_words})"
    one_ago = rf"(?<![{WORD}])(?:an?|one){SPACE}+(hour|day|week|month){SPACE}+ago"
    return (
        F.when(raw.isNull() | (raw == ""), None)
        .when(low.rlike(_EPOCH), epoch_to_local_date(low.try_cast("bigint"), zone))
        .when(low.rlike(_ISO), _iso_date(low, zone))
        .when(low.rlike(_DMY), _ymd(
            F.when(F.length(F.regexp_extract(low, _DMY, 3)) == 2, F.concat(F.lit("20"), F.regexp_extract(low, _DMY, 3)))
            .otherwise(F.regexp_extract(low, _DMY, 3)),
            F.regexp_extract(low, _DMY, 2), F.regexp_extract(low, _DMY, 1)))
        .when(low.rlike(_NAMED) & _named_month(low).isNotNull(), _named_month(low))
        .when(low.rlike(bounded("|".join(TODAY_WORDS)) + "|" + "|".join(LOCAL_TODAY_WORDS)), as_of)
        .when(low.rlike(f"{bounded(YESTERDAY_WORD)}|{LOCAL_YESTERDAY_WORD}"), F.date_sub(as_of, 1))
        .when(low.rlike(ago), _back(as_of, F.regexp_extract(low, ago, 1),
                                    _days(UNIT_DAYS, F.regexp_extract(low, ago, 2))))
        .when(text.rlike(local_count), _back(as_of, F.regexp_extract(text, local_count, 1),
                                             _days(LOCAL_UNIT_DAYS, F.regexp_extract(text, local_count, 2))))
        .when(text.rlike(local_word),
              F.date_sub(as_of, _days(LOCAL_WORD_DAYS, F.regexp_extract(text, local_word, 1))))
        .when(low.rlike(one_ago), F.date_sub(as_of, _days(UNIT_DAYS, F.regexp_extract(low, one_ago, 1))))
    )


def relevant_date(posted: Column, updated: Column, as_of: Column) -> Column:
    """The later of both dates, never after ``as_of``; null when both are unknown."""
    latest = F.greatest(posted, updated)
    return F.when(latest.isNotNull(), F.least(latest, as_of))


@built_once
def latest_date(raws: list[Column], as_of: Column, rules: RuleSet) -> Column:
    """``relevant_date`` straight from the texts; every text goes through the same expression."""
    known = F.transform(F.array(*raws), lambda raw: parse_posting_date(raw, as_of, rules))
    return let(F.array_max(known), lambda latest: relevant_date(latest, latest, as_of))


def freshness(date: Column, as_of: Column, days: int) -> Column:
    """True or false for a known date, null when it is unknown."""
    return F.datediff(as_of, date) <= days


def date_display(date: Column) -> Column:
    return F.coalesce(F.date_format(date, "dd/MM/yyyy"), F.lit(L.UNKNOWN_DATE))
