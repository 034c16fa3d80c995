"""Opening hours: rule texts, periods, and the state at an instant. All JVM array expressions, no shuffle.

Hours are struct(days: array of struct(weekday, closed, intervals: array of
struct(start, end) in minutes), raw, timezone, unparsed). Weekday 0 is Sunday.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..refdata import DAY_NAMES, DAY_WORDS, HOURS_RULE, UNREAD_RULE_WORDS
from .text import BLANK, let

DAY_MINUTES = 1440
RULE = HOURS_RULE
INTERVALS = "array<struct<start:int,end:int>>"


def parse_clock(c: Column) -> Column:
    """Minutes of "9", "9:30" or "9.30"; null if it is no time up to 24:59."""
    text = F.trim(c)
    hour = F.regexp_extract(text, r"^(\d{1,2})(?:[:.](\d{2}))?$", 1)
    minute = F.coalesce(F.nullif(F.regexp_extract(text, r"^(\d{1,2})[:.](\d{2})$", 2), F.lit("")), F.lit("0"))
    h, m = F.nullif(hour, F.lit("")).cast("int"), minute.cast("int")
    return F.when((h <= 24) & (m <= 59), h * 60 + m)


def _weekday(token: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DAY_WORDS.items() for x in pair])
    return F.try_element_at(table, F.replace(F.lower(F.trim(token)), F.lit("."), F.lit("")))


def _weekdays(spec: Column) -> Column:
    """The days of "Mo-Fr, Su"; null if a part is no day or range. Ranges wrap."""

    def one(part: Column) -> Column:
        ends = F.transform(F.split(part, "-"), lambda x: _weekday(x))
        span = lambda e: F.transform(F.sequence(F.lit(0), F.pmod(e[F.size(e) - 1] - e[0], F.lit(7))), lambda k: F.pmod(e[0] + k, F.lit(7)))
        return let(ends, lambda e: F.when((F.size(e) <= 2) & F.forall(e, lambda x: x.isNotNull()), span(e)))

    parts = F.transform(F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != ""), one)
    return F.when((F.size(parts) > 0) & F.forall(parts, lambda p: p.isNotNull()), F.array_distinct(F.flatten(parts)))


def _spans(text: Column) -> Column:
    """The intervals of "9:00-12:00,14-18"; a span over midnight gives two on the same day; null if a part is no span."""

    def one(part: Column) -> Column:
        ends = F.transform(F.split(F.trim(part), "-"), lambda x: parse_clock(x))
        pair = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
        both = lambda e: F.when(e[1] <= e[0], F.array(pair(e[0], F.lit(DAY_MINUTES)), pair(F.lit(0), e[1]))).otherwise(F.array(pair(e[0], e[1])))
        return let(ends, lambda e: F.when((F.size(e) == 2) & F.forall(e, lambda x: x.isNotNull()), both(e)))

    found = F.transform(F.split(text, ","), one)
    return F.when(F.forall(found, lambda x: x.isNotNull()), F.flatten(found))


def _week(intervals_of) -> Column:
    """Seven days; ``intervals_of`` gives the unsorted intervals of a weekday. Equal starts keep their order."""

    def day(d: Column) -> Column:
        keyed = F.transform(intervals_of(d), lambda x, k: F.struct(x["start"].alias("start"), k.alias("k"), x["end"].alias("end")))
        own = F.transform(F.array_sort(keyed), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).cast(INTERVALS)
        return F.struct(d.cast("int").alias("weekday"), (F.size(own) == 0).alias("closed"), own.alias("intervals"))

    return F.transform(F.sequence(F.lit(0), F.lit(6)), day)


def parse_opening_hours(raw: Column, timezone: Column) -> Column:
    """Rule text -> hours. Rules that are not understood are kept in ``unparsed``; ``off`` clears a day's earlier rules, later rules add to it; null for blank texts."""

    def read(rule: Column) -> Column:
        unread = rule.rlike(rf"(?i)\b({'|'.join(UNREAD_RULE_WORDS)})\b")
        times = F.lower(F.trim(F.regexp_extract(rule, RULE, 2)))
        off = times.isin("off", "closed", "geschlossen")
        days = F.when(~unread & rule.rlike(RULE), _weekdays(F.regexp_extract(rule, RULE, 1)))
        spans = F.when(off, F.array().cast(INTERVALS)).otherwise(_spans(times))
        return F.struct(rule.alias("rule"), off.alias("off"), days.alias("days"), spans.alias("spans"))

    def day_of(good: Column, d: Column) -> Column:
        own = F.transform(F.filter(good, lambda r: F.array_contains(r["days"], d)), lambda r, k: F.struct(k.alias("k"), r["off"].alias("off"), r["spans"].alias("spans")))
        since = lambda o: F.coalesce(F.array_max(F.transform(F.filter(o, lambda r: r["off"]), lambda r: r["k"])), F.lit(-1))
        return let(own, lambda o: let(since(o), lambda last: F.flatten(F.transform(F.filter(o, lambda r: r["k"] > last), lambda r: r["spans"]))))

    def hours_of(text: Column, rules: Column) -> Column:
        ok = lambda r: r["days"].isNotNull() & r["spans"].isNotNull()
        days = let(F.filter(rules, ok), lambda good: _week(lambda d: day_of(good, d)))
        unparsed = F.transform(F.filter(rules, lambda r: ~ok(r)), lambda r: r["rule"])
        return F.when(F.size(rules) > 0, F.struct(days.alias("days"), text.alias("raw"), timezone.alias("timezone"), unparsed.alias("unparsed")))

    def whole(text: Column) -> Column:
        rules = F.transform(F.filter(F.transform(F.split(text, ";"), lambda r: F.trim(r)), lambda r: r != ""), read)
        every_day = _week(lambda d: F.array(F.struct(F.lit(0).alias("start"), F.lit(DAY_MINUTES).alias("end"))))
        always = F.struct(every_day.alias("days"), text.alias("raw"), timezone.alias("timezone"), F.array().cast("array<string>").alias("unparsed"))
        return F.when(text == "24/7", always).otherwise(let(rules, lambda r: hours_of(text, r)))

    return let(F.trim(F.regexp_replace(raw, f"{BLANK}+", " ")), whole)


def hours_of_periods(periods: Column, timezone: Column) -> Column:
    """Periods (array of struct(open, close) of struct(day, hour, minute)) -> hours.

    Without a close the day runs to 24:00; a period over midnight goes on in
    the close day. Periods without a valid open day go to ``unparsed``; null if
    none is valid.
    """
    minute = lambda p: F.coalesce(p["hour"], F.lit(0)) * 60 + F.coalesce(p["minute"], F.lit(0))
    pair = lambda day, a, b: F.struct(day.alias("day"), a.cast("int").alias("start"), b.cast("int").alias("end"))
    valid = F.filter(periods, lambda p: F.coalesce(p["open"]["day"].between(0, 6), F.lit(False)))

    def both(p: Column) -> Column:
        day, close, start = p["open"]["day"], p["close"]["day"], minute(p["open"])
        raw_end = F.when(p["close"].isNull(), DAY_MINUTES).otherwise(minute(p["close"]))
        end = F.when(p["close"].isNull() | F.coalesce(close == day, F.lit(False)), raw_end).otherwise(DAY_MINUTES)
        first = pair(day, start, F.when(end <= start, DAY_MINUTES).otherwise(end))
        over = F.coalesce((close != day) & (raw_end > 0), F.lit(False))
        return F.when(over, F.array(first, pair(close, F.lit(0), raw_end))).otherwise(F.array(first))

    spread = F.flatten(F.transform(valid, both))
    days = _week(lambda d: F.filter(spread, lambda x: x["day"] == d))
    unparsed = F.transform(F.filter(periods, lambda p: ~F.coalesce(p["open"]["day"].between(0, 6), F.lit(False))), lambda p: F.to_json(p))
    return F.when(F.size(valid) > 0, F.struct(days.alias("days"), F.lit(None).cast("string").alias("raw"), timezone.alias("timezone"), unparsed.alias("unparsed")))


def clock_text(minutes: Column) -> Column:
    return F.format_string("%02d:%02d", F.floor(minutes / 60).cast("int"), F.pmod(minutes, F.lit(60)).cast("int"))


def opening_status(hours: Column, at: Column) -> Column:
    """struct(state, detail, partial) at an instant, in the hours' own zone: open, closed or unknown; an interval holds its start and not its end."""
    return let(F.struct(hours.alias("hours"), at.alias("at")), lambda x: _status(x["hours"], x["at"]))


def _status(hours: Column, at: Column) -> Column:
    local = F.from_utc_timestamp(at, hours["timezone"])
    now, weekday = F.hour(local) * 60 + F.minute(local), F.dayofweek(local) - 1
    names = F.array(*[F.lit(d) for d in DAY_NAMES])
    today = hours["days"][weekday]["intervals"]
    current = F.try_element_at(F.filter(today, lambda x: (x["start"] <= now) & (now < x["end"])), F.lit(1))
    later = F.try_element_at(F.filter(today, lambda x: x["start"] > now), F.lit(1))

    def ahead(k: Column) -> Column:
        day = F.pmod(weekday + k, F.lit(7))
        start = F.try_element_at(hours["days"][day]["intervals"], F.lit(1))["start"]
        return F.when(start.isNotNull(), F.concat(F.lit("Opens "), F.when(k == 1, "tomorrow").otherwise(names[day]), F.lit(" "), clock_text(start)))

    following = F.try_element_at(F.filter(F.transform(F.sequence(F.lit(1), F.lit(7)), ahead), lambda x: x.isNotNull()), F.lit(1))
    partial = F.coalesce(F.size(hours["unparsed"]) > 0, F.lit(False))
    known = F.exists(hours["days"], lambda d: F.size(d["intervals"]) > 0)
    state = F.when(hours.isNull() | ~known, "unknown").when(current.isNotNull(), "open").otherwise("closed")
    detail = (
        F.when(hours.isNull(), F.lit(None).cast("string"))
        .when(~known, F.when(partial, "Hours could not be read"))
        .when(current.isNotNull(), F.concat(F.lit("Closes "), clock_text(current["end"])))
        .when(later.isNotNull(), F.concat(F.lit("Opens "), clock_text(later["start"])))
        .otherwise(following)
    )
    return F.struct(state.alias("state"), detail.alias("detail"), partial.alias("partial"))


def weekly_schedule(hours: Column, at: Column) -> Column:
    """Seven rows from Monday: struct(weekday, label, text, is_today); null without hours."""
    return let(F.struct(hours.alias("hours"), at.alias("at")), lambda x: _schedule(x["hours"], x["at"]))


def _schedule(hours: Column, at: Column) -> Column:
    today = F.dayofweek(F.from_utc_timestamp(at, hours["timezone"])) - 1
    names = F.array(*[F.lit(d) for d in DAY_NAMES])

    def row(d: Column) -> Column:
        spans = F.transform(hours["days"][d]["intervals"], lambda x: F.concat(clock_text(x["start"]), F.lit("-"), clock_text(x["end"])))
        return F.struct(d.alias("weekday"), names[d].alias("label"), F.when(F.size(spans) > 0, F.array_join(spans, ", ")).otherwise("Closed").alias("text"), (d == today).alias("is_today"))

    return F.when(hours.isNotNull(), F.transform(F.array(*[F.lit(d) for d in (1, 2, 3, 4, 5, 6, 0)]), row))
