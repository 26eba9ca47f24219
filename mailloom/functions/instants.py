"""Date texts of many notations to one UTC instant, in native column expressions.

An ordered cascade of anchored patterns rewrites a text to one canonical, separated form
(kind, year, month, day, hour, minute, second, fraction, AM/PM, zone); strict range checks
follow, and the zone policy last: an offset decides, then a zone name in the text, then the
source's default zone. Local readings that a zone skipped or had twice give null.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Months of the English notations.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Zones of RFC 822 in minutes east of UTC.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300,
    "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}

DAY_US = 86_400_000_000

_WEEKDAY = "(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*"
_MONTH = "(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*"
_OFFSET = r"[+-]\d{2}(?::?\d{2})?"
_REGION = r"[a-z]+(?:[/_+-][a-z0-9]+)+"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"

# (name, anchored case-blind pattern on the text with single blanks, canonical form).
# The canonical form is kind|year|month|day|hour|minute|second|fraction|am or pm|offset|zone name.
CASCADE: list[tuple[str, str, str]] = [
    ("epoch", r"^(\d{9,10}|\d{12,13}|\d{15,16})$", "epoch|$1|||||||||"),
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[t ]{_CLOCK} ?(z|{_OFFSET})?(?: ?\[?({_REGION})\]?)?$", "ymd|$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("iso_date", r"^(\d{4})-(\d{2})-(\d{2})$", "ymd|$1|$2|$3|0|0|||||"),
    ("basic", rf"^(\d{{4}})(\d{{2}})(\d{{2}})t(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?(z|{_OFFSET})?$", "ymd|$1|$2|$3|$4|$5|$6|$7||$8|"),
    ("mail", rf"^(?:{_WEEKDAY},? ?)?(\d{{1,2}}) {_MONTH} (\d{{4}}|\d{{2}}),? {_CLOCK}(?: ?({_OFFSET}|[a-z]{{1,4}}))?(?: ?\([^()]*\))?$", "ymd|$3|$2|$1|$4|$5|$6|$7||$8|"),
    ("asctime", rf"^(?:{_WEEKDAY},? )?{_MONTH} (\d{{1,2}}) {_CLOCK}(?: ({_OFFSET}|[a-z]{{1,4}}))? (\d{{4}})$", "ymd|$8|$1|$2|$3|$4|$5|$6||$7|"),
    ("dashed", rf"^(\d{{1,2}})-{_MONTH}-(\d{{4}}|\d{{2}}) {_CLOCK} ?(am|pm)?(?: ?({_OFFSET}|[a-z]{{1,4}}))?$", "ymd|$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    ("slashed", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}) {_CLOCK} ?(am|pm)?(?: ?({_OFFSET}|(?!am|pm)[a-z]{{1,4}}))?$", "xxy|$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
]


@lru_cache(maxsize=1)
def zone_names() -> tuple[str, ...]:
    """Names of the zone database of the Python installation that carry a region."""
    return tuple(sorted(n for n in available_timezones() if "/" in n and not n.startswith(("posix/", "right/"))))


def canonical_date(text: Column) -> Column:
    """The canonical separated form of a date text, or null where no pattern of the cascade matches."""
    flat = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return reduce(lambda rest, p: F.when(flat.rlike("(?i)" + p[1]), F.regexp_replace(flat, "(?i)" + p[1], p[2])).otherwise(rest), reversed(CASCADE), F.lit(None).cast("string"))


def days_from_civil(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, by integer arithmetic (never fails)."""
    y = F.when(month <= 2, year - 1).otherwise(year)
    era = F.floor(y / 400)
    yoe = y - era * 400
    doy = F.floor((F.lit(153) * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def month_length(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a timestamp column, zoneless ones read as UTC, whatever the session's zone is."""
    c = F.col(column)
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return F.unix_micros(c.cast("timestamp"))
    seconds = (F.unix_date(c.cast("date")).cast("long") * 24 + F.hour(c)) * 60 + F.minute(c)
    return seconds * 60_000_000 + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")


def _shown(us: Column, zone: Column) -> Column:
    """What the zone's clock shows at an instant, as microseconds."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(us), zone))


def _through(local_us: Column, zone: Column, shift: int) -> Column:
    """The instant a clock reading means by the offset in force `shift` away from it.

    The offsets a day before and a day after bracket any single transition; an instant counts
    if the zone's clock shows the reading then, and exactly one must remain.
    """
    return local_us - (_shown(local_us + F.lit(shift), zone) - (local_us + F.lit(shift)))


def _minutes(offset: Column) -> Column:
    """Signed minutes of +hh, +hhmm or +hh:mm; null for a text that isn't one or is out of range."""
    digits = F.regexp_replace(offset, r"[^0-9]", "")
    hh, mm = F.substring(digits, 1, 2).try_cast("int"), F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0))
    return F.when(offset.rlike(r"^[+-]") & (hh <= 18) & (mm < 60), F.when(offset.startswith("-"), -1).otherwise(1) * (hh * 60 + mm))


def with_utc_micros(df: DataFrame, text: str, default_zone: str, day_first: str, out: str = "utc_us") -> DataFrame:
    """Adds the microseconds since 1970 UTC that a date text means, else null.

    Null: null, empty or unknown notations; impossible dates or times; zone abbreviations outside
    RFC 822; zoneless texts without a valid default zone; slashed dates where day_first is null;
    local readings that were skipped or occurred twice. Each step names its values once, and is an
    inline() of one struct: through a plain projection the optimizer would push a later filter on the
    result down step by step, copying every expression into each of its uses.
    """
    def step(frame: DataFrame, **columns: Column) -> DataFrame:
        return frame.select("*", F.inline(F.array(F.struct(*[v.alias(f"__{k}") for k, v in columns.items()]))))

    c = {k: F.col(f"__{k}") for k in "part kind raw mon name half hour minute sec year month day micro local off text_zone zone before after".split()}
    x = step(df, part=F.split(canonical_date(F.col(text)), r"\|"))
    part = c["part"]
    x = step(x, kind=part[0], raw=part[1], mon=F.lower(F.substring(part[2], 1, 3)), half=F.lower(part[8]), off=F.lower(part[9]), text_zone=part[10],
             hour=part[4].try_cast("int"), minute=part[5].try_cast("int"), sec=F.coalesce(part[6].try_cast("int"), F.lit(0)),
             micro=F.when(part[7] == "", 0).otherwise(F.rpad(F.substring(part[7], 1, 6), 6, "0").try_cast("int")))
    year = c["raw"].try_cast("int")
    x = step(x, name=F.array_position(F.array(*map(F.lit, MONTHS)), c["mon"]).cast("int"),
             year=F.when(F.length(c["raw"]) > 4, None).when(F.length(c["raw"]) == 2, year + F.when(year < 50, 2000).otherwise(1900)).otherwise(year))
    first, second = F.when(c["name"] > 0, c["name"]).otherwise(c["mon"].try_cast("int")), part[3].try_cast("int")
    swap = (c["kind"] == "xxy") & F.col(day_first)
    x = step(x, month=F.when(swap, second).otherwise(first), day=F.when(swap, first).otherwise(second))
    good_hour = F.when(c["half"] == "", c["hour"] <= 23).otherwise(c["hour"].between(1, 12))
    valid = (
        (c["year"] >= 1) & c["month"].between(1, 12) & (c["day"] >= 1) & (c["day"] <= month_length(c["year"], c["month"]))
        & good_hour & (c["minute"] <= 59) & (c["sec"] <= 59) & ((c["kind"] == "ymd") | F.col(day_first).isNotNull())
    )
    clock = F.when(c["half"] == "", c["hour"]).otherwise(c["hour"] % 12 + F.when(c["half"] == "pm", 12).otherwise(0))
    local = days_from_civil(c["year"], c["month"], c["day"]) * 86_400_000_000 + (clock * 3600 + c["minute"] * 60 + c["sec"]).cast("long") * 1_000_000 + c["micro"]
    zone = F.when(c["text_zone"] != "", F.when(c["text_zone"].isin(*zone_names()), c["text_zone"])).otherwise(F.col(default_zone))
    x = step(x, local=F.when(valid, local), zone=F.when(c["off"] == "", zone))
    x = step(x, before=_through(c["local"], c["zone"], -DAY_US), after=_through(c["local"], c["zone"], DAY_US))
    good_before, good_after = (_shown(c[k], c["zone"]) == c["local"] for k in ("before", "after"))
    by_zone = F.when(good_before & good_after & (c["before"] != c["after"]), None).when(good_before, c["before"]).when(good_after, c["after"])
    short = reduce(lambda rest, p: F.when(c["off"] == p[0], p[1]).otherwise(rest), ABBREVIATIONS.items(), F.lit(None).cast("int"))
    by_offset = c["local"] - F.coalesce(_minutes(c["off"]), short).cast("long") * 60_000_000
    number, length = c["raw"].try_cast("long"), F.length(c["raw"])
    epoch = number * F.when(length <= 10, 1_000_000).when(length <= 13, 1_000).otherwise(1)
    x = x.withColumn(out, F.when(c["kind"] == "epoch", epoch).when(c["off"] != "", by_offset).otherwise(by_zone))
    return x.drop(*[f"__{k}" for k in c])
