"""Dates: tri-state cutoffs, fiscal quarters, month arithmetic, durations and parsers. Nothing reads the clock."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations in order.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def _month(name: Column) -> Column:
    return F.create_map(*[x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{i:02d}"))])[F.substring(F.lower(name), 1, 3)]


def fiscal_quarter(day: Column) -> Column:
    """FYyyyyQn; the fiscal year starts on 1 October."""
    later = F.add_months(day, 3)
    return F.concat(F.lit("FY"), F.year(later), F.lit("Q"), F.quarter(later))


def cutoff(token: Column, pivot: int = 100, short_day: bool = True) -> Column:
    """A bulletin token as 'CURRENT', an ISO date, or null for unavailable and unreadable.

    Two-digit years from `pivot` on are in the 1900s; with 100 all are in the 2000s. Without short_day a day has two digits.
    """
    t = F.upper(F.trim(token))
    day, month, year = (F.regexp_extract(t, rf"^(\d{{{1 if short_day else 2},2}})([A-Z]{{3}})(\d{{2}})$", i) for i in (1, 2, 3))
    century = F.when(F.try_to_number(year, F.lit("99")) >= pivot, "19").otherwise("20")
    text = F.concat(century, year, F.lit("-"), _month(month), F.lit("-"), F.lpad(day, 2, "0"))
    return F.when(t.isin("C", "CURRENT"), "CURRENT").otherwise(F.when(day != "", F.try_to_date(text, "yyyy-MM-dd").cast("string")))


def cutoff_rank(value: Column) -> Column:
    """Order of tri-state values: unavailable below all dates, current above."""
    return F.when(value.isNull(), F.lit(float("-inf"))).when(value == "CURRENT", F.lit(float("inf"))).otherwise(F.datediff(F.try_to_date(value, "yyyy-MM-dd"), F.lit("1970-01-01")).cast("double"))


def any_date(text: Column) -> Column:
    """ISO date of a text in one of the known layouts, else null."""
    t = F.trim(text)
    dmy = lambda i: F.regexp_extract(t, r"^(?:[A-Za-z]{3}, )?(\d{1,2}) ([A-Za-z]{3})[a-z]* (\d{4})", i)
    mdy = lambda i: F.regexp_extract(t, r"^([A-Za-z]{3})[a-z]*\.? (\d{1,2}), (\d{4})$", i)
    us = lambda i: F.regexp_extract(t, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", i)
    iso = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})", 1)
    make = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, m, F.lpad(d, 2, "0")), "yyyy-MM-dd")
    when = lambda part, value: F.when(part != "", value)
    return F.coalesce(when(iso, F.try_to_date(iso, "yyyy-MM-dd")), when(dmy(1), make(dmy(3), _month(dmy(2)), dmy(1))), when(mdy(1), make(mdy(3), _month(mdy(1)), mdy(2))), when(us(1), make(us(3), F.lpad(us(1), 2, "0"), us(2)))).cast("string")


def years_months(start: Column, end: Column) -> Column:
    """Whole years and months between two days, borrowing a month where the day is not reached."""
    early, late = F.least(start, end), F.greatest(start, end)
    months = (F.year(late) - F.year(early)) * 12 + F.month(late) - F.month(early) - (F.dayofmonth(late) < F.dayofmonth(early)).cast("int")
    return F.struct(F.floor(months / 12).cast("int").alias("years"), F.pmod(months, F.lit(12)).cast("int").alias("months"), (end < start).alias("negative"))


def duration_days(text: Column) -> Column:
    """Days of a text like '1.5 months': year 365, month 30, week 7."""
    amount = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(day|week|month|year)s?\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(day|week|month|year)s?\s*$", 2)
    size = F.when(unit == "year", 365).when(unit == "month", 30).when(unit == "week", 7).otherwise(1)
    return F.when(amount != "", F.round(amount.try_cast("double") * size).cast("int"))


# Month names in order.
MONTH_NAMES = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
NOTHING = ("", "--", "-", "n/a", "na", "none")


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date of three texts, null where the calendar has none."""
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _found(text: Column, pattern: str, make) -> Column:
    """make(group 1, group 2, ...) where the pattern is found, else null."""
    hit = F.regexp_extract(text, pattern, 0) != ""
    return F.when(hit, make(lambda i: F.regexp_extract(text, pattern, i)))


def file_date(name: Column) -> Column:
    """Date of a file named MONDDYYYY_NNB..., whatever its folder; null if the month or day is none."""
    base = F.upper(F.substring_index(name, "/", -1))
    return _found(base, r"^([A-Z]{3})(\d{2})(\d{4})_\d+B\d+", lambda g: _day(g(3), _month(g(1)), g(2)))


def body_date(text: Column) -> Column:
    """Date in a text's header: 'Date: JUL. 1, 2021', else the older 'DATE: APR 0 3 2015' with a split day.

    Where the newer header stands but holds no real date, the older is not tried.
    """
    new = r"(?i)Date:\s*([A-Z]{3})\.?\s*(\d{1,2}),\s*(\d{4})"
    old = r"(?i)DATE:\s*([A-Z]{3})[A-Z]*\.?\s*(\d)\s*(\d)?\s*,?\s*(\d{4})"
    modern = _found(text, new, lambda g: _day(g(3), _month(g(1)), g(2)))
    legacy = _found(text, old, lambda g: _day(g(4), _month(g(1)), F.concat(g(2), g(3))))
    return F.when(F.regexp_extract(text, new, 0) != "", modern).otherwise(legacy)


def sourced_date(name: Column, text: Column) -> Column:
    """date, source and disagrees: the file's date before the body's, with a flag where both are known and differ."""
    first, second = file_date(name), body_date(text)
    source = F.when(first.isNotNull(), "filename").when(second.isNotNull(), "body").otherwise("")
    return F.struct(F.coalesce(first, second).alias("date"), source.alias("source"), F.coalesce(first != second, F.lit(False)).alias("disagrees"))


def as_date(text: Column) -> Column:
    """2026-03-01, 3/1/2026, 2026-03-01 10:00:00 or 3/1/26, whose years from 69 on are in the 1900s."""
    first = F.substring_index(F.trim(text), " ", 1)
    iso = _found(first, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", lambda g: _day(g(1), g(2), g(3)))
    long = _found(first, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", lambda g: _day(g(3), g(1), g(2)))
    short = _found(first, r"^(\d{1,2})/(\d{1,2})/(\d{2})$", lambda g: _day(F.concat(F.when(g(3) >= "69", "19").otherwise("20"), g(3)), g(1), g(2)))
    return F.coalesce(iso, long, short)


def quarter_end(day: Column) -> Column:
    """Last day of the fiscal quarter, which is that of the calendar quarter."""
    return F.last_day(F.add_months(F.trunc(day, "quarter"), 2))


def expected_quarter(as_of: Column) -> Column:
    """The newest fiscal quarter that should be out: one before that of as_of."""
    return fiscal_quarter(F.add_months(as_of, -3))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_number(key: Column) -> Column:
    """Months since year 0 of a key yyyy-MM; null for other texts."""
    return F.when(key.rlike(r"^\d{4}-(0[1-9]|1[0-2])"), F.substring(key, 1, 4).try_cast("int") * 12 + F.substring(key, 6, 2).try_cast("int") - 1)


def month_of_number(number: Column) -> Column:
    return F.concat(F.lpad(F.floor(number / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.pmod(number, F.lit(12)) + 1).cast("string"), 2, "0"))


def month_range(first: Column, last: Column) -> Column:
    """All keys yyyy-MM from first to last, none where last comes first."""
    a, b = month_number(first), month_number(last)
    return F.when(a <= b, F.transform(F.sequence(a, F.greatest(a, b)), month_of_number)).otherwise(F.array().cast("array<string>"))


def previous_month(key: Column) -> Column:
    return month_of_number(month_number(key) - 1)


def directory_year(key: Column) -> Column:
    """Year of the folder a month is filed under: from October on the next."""
    n = month_number(key)
    return (F.floor(n / 12) + (F.pmod(n, F.lit(12)) >= 9).cast("int")).cast("int")


def months_apart(a: Column, b: Column) -> Column:
    """Calendar months from a to b, days ignored."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def _plural(n: Column, unit: str) -> Column:
    return F.concat(F.regexp_replace(n.cast("string"), r"\.0$", ""), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))


def say_months(n: Column) -> Column:
    """'5 months', '1 year', '2 years 3 months' (F50)."""
    years, rest = F.floor(n / 12).cast("int"), F.pmod(n, F.lit(12)).cast("int")
    return F.when(n < 12, _plural(n, "month")).otherwise(F.concat(_plural(years, "year"), F.when(rest > 0, F.concat(F.lit(" "), _plural(rest, "month"))).otherwise("")))


def say_days(days: Column) -> Column:
    """'3 days', 'about 4 weeks', 'about 2.5 months', 'about 1 year', with bounds at 14, 60 and 365 (F54); null: empty."""
    near = lambda x: F.concat(F.lit("about "), x)
    tenth = lambda x: F.floor(x * 10 + 0.5) / 10
    long = F.when(days < 60, near(_plural(F.floor(days / 7 + 0.5).cast("int"), "week"))).when(days < 365, near(_plural(tenth(days / 30), "month"))).otherwise(near(_plural(tenth(days / 365), "year")))
    return F.when(days.isNull(), "").when(days < 14, _plural(days, "day")).otherwise(long)


def named_month(text: Column) -> Column:
    """yyyy-MM of 'November 2025' or 'Sep. 2026'; null for blanks, other names and years outside 1990 to 2100.

    A name that is none counts by its first three letters.
    """
    key = _found(text, r"\b([A-Za-z]{3,9})\.?\s+(\d{4})\b", lambda g: F.when(g(2).try_cast("int").between(1990, 2100), F.concat(g(2), F.lit("-"), _month(g(1)))))
    return F.when(~F.lower(F.trim(text)).isin(*NOTHING), key)


def month_label(key: Column) -> Column:
    """'November 2025' of yyyy-MM."""
    n = month_number(key)
    return F.concat(F.element_at(F.array(*map(F.lit, MONTH_NAMES)), (F.pmod(n, F.lit(12)) + 1).cast("int")), F.lit(" "), F.substring(key, 1, 4))


def us_date(text: Column) -> Column:
    """Date of the first M/D/YYYY in a text."""
    return _found(text, r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", lambda g: _day(g(3), g(1), g(2)))


def whole_number(text: Column) -> Column:
    """The first whole number of a text, thousands separated or not; null, never 0, for blanks and dashes."""
    number = F.replace(F.regexp_extract(text, r"-?\d[\d,]*", 0), F.lit(","), F.lit(""))
    return F.when(~F.lower(F.trim(text)).isin(*NOTHING) & (number != ""), number.try_cast("long"))


def sentence_around(text: Column, at: Column) -> Column:
    """The sentence around a character position (from 1). Only '. ' ends one, so citations don't."""
    before = F.substring(text, F.lit(1), at - 1)
    # The last '. ' that starts and ends before the position.
    last = F.when(F.instr(before, ". ") == 0, 0).otherwise(F.length(before) - F.instr(F.reverse(before), " .") + 1)
    rest = F.substring(text, last + 1, F.length(text))
    from_here = F.call_function("locate", F.lit(". "), text, at)
    return F.trim(F.when(from_here > 0, F.substring(text, last + 1, from_here - last)).otherwise(rest))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """What the body makes of a value that is worked out once; an expression named twice is worked out twice inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def prose_dates(text: Column) -> Column:
    """All dates of a text as (date, at, matched) in order of their places, at from 1: 'May 1, 2020', '1 May 2020' and ISO; each date
    once, where it stands first (F53).

    Each match is set between marks in one pass, with its year, month and day behind it, so its place is that of the match itself.
    """
    names = "|".join(f"{n[:3]}(?:{n[3:]})?" if len(n) > 3 else n for n in MONTH_NAMES) + "|Sept"
    month, day, year = f"({names})", r"(\d{1,2})(?:st|nd|rd|th)?", r"(\d{4})"
    shapes = (rf"{month}\.?\s+{day},\s*{year}", rf"{day}\s+{month}\.?,?\s+{year}", r"(\d{4})-(\d{2})-(\d{2})")
    marked = F.regexp_replace(text, r"(?i)(?<!\w)(?:" + "|".join(shapes) + r")(?!\w)", "\x01$0\x02$3$6$7\x02$1$5$8\x02$2$4$9\x01")

    def dated(parts: Column, k: Column) -> Column:
        before = F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda n, p: n + F.length(p[0]))
        number = lambda part: F.when(part[2].rlike("^[0-9]"), part[2]).otherwise(_month(part[2]))
        return let(F.get(parts, k), lambda part: F.struct(_day(part[1], number(part), part[3]).alias("date"), (before + 1).alias("at"), part[0].alias("matched")))

    def found(parts: Column) -> Column:
        odd = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(odd, lambda k: dated(parts, k)), lambda d: d["date"].isNotNull())

    every = let(F.transform(F.split(marked, "\x01"), lambda p: F.split(p, "\x02")), found)
    return let(every, lambda all_: F.filter(all_, lambda d, i: ~F.exists(F.slice(all_, F.lit(1), i), lambda s: s["date"] == d["date"])))


def stale(as_of: Column, verified: Column) -> Column:
    """Whether a month key lies more than two months behind another; false where one is unknown."""
    return F.coalesce(month_number(verified) - month_number(as_of) > 2, F.lit(False))


def say_age(day: Column, now: Column) -> Column:
    """'as of 2026-03-01, 5 days ago'; empty without a date."""
    return F.coalesce(F.concat(F.lit("as of "), day.cast("string"), F.lit(", "), _plural(F.datediff(now, day), "day"), F.lit(" ago")), F.lit(""))


def scheduling_month(text: Column) -> Column:
    """yyyy-MM of 'Mon-YYYY', 'Month YYYY', 'MM/YYYY' or 'YYYY-MM' from 2000 to 2100."""
    t = F.trim(text)
    key = F.coalesce(
        _found(t, r"([A-Za-z]{3,})[\s\-/]+(\d{4})", lambda g: F.concat(g(2), F.lit("-"), _month(g(1)))),
        _found(t, r"^(\d{1,2})[\s\-/](\d{4})$", lambda g: F.concat(g(2), F.lit("-"), F.lpad(g(1), 2, "0"))),
        _found(t, r"^(\d{4})[\s\-/](\d{1,2})$", lambda g: F.concat(g(1), F.lit("-"), F.lpad(g(2), 2, "0"))),
    )
    return F.when(month_number(key).isNotNull() & F.substring(key, 1, 4).try_cast("int").between(2000, 2100), key)


def sort_key(shown: Column) -> Column:
    """YYYYMMDD of a shown date 'JUL. 1, 2021'; 99999999 for others, so they sort last."""
    return F.coalesce(_found(F.trim(shown), r"(?i)^([A-Z]{3})\.?\s*(\d{1,2}),\s*(\d{4})", lambda g: F.concat(g(3), F.coalesce(_month(g(1)), F.lit("00")), F.lpad(g(2), 2, "0"))), F.lit("99999999"))


def reglue(text: Column) -> Column:
    """Dates a text layer has split, as in '01 SEP 2 1', in one piece and capitals; others stay."""
    name = "|".join(m.upper() for m in MONTHS)
    joined = F.regexp_replace(text, rf"(?i)(\d{{1,2}})\s*({name})\s*(\d)\s*(\d)(?!\d)", "$1$2$3$4")
    for m in MONTHS:
        joined = F.regexp_replace(joined, rf"(?i)(?<=\d){m}(?=\d\d(?!\d))", m.upper())
    return joined


def show_day(iso: Column) -> Column:
    """'Jul 1, 2021' of an ISO date, 'Current' of CURRENT; other texts as they are (F100)."""
    good = _found(iso, r"^(\d+)-(\d+)-(\d+)$", lambda g: F.when(g(2).try_cast("int").between(1, 12), F.concat(F.initcap(F.element_at(F.array(*map(F.lit, MONTHS)), g(2).try_cast("int"))), F.lit(" "), g(3).try_cast("int").cast("string"), F.lit(", "), g(1))))
    return F.when(iso == "CURRENT", "Current").otherwise(F.coalesce(good, iso))


def strict_iso(text: Column) -> Column:
    """The date of a text that is one in shape and in the calendar, else null (F102)."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def axis_percent(day: Column, first_year: int, last_year: int) -> Column:
    """Place of a date on an axis of years, in percent, from 0 to 100 (F103)."""
    of_year = (F.dayofyear(day) - 1) / F.dayofyear(F.make_date(F.year(day), F.lit(12), F.lit(31)))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), (F.year(day) + of_year - first_year) / (last_year - first_year) * 100))
