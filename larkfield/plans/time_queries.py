"""Queries of geography, instants and opening hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, hours, timeutil
from ..operators.schedules import with_hours
from ..refdata import DAY_NAMES, DAY_WORDS, HOURS_RULE, UNREAD_RULE_WORDS
from . import sqltext as q
from .catalog import query
from .standins import AS_OF, view, with_views

B = with_views("v_business")


@query(f"""{B}, o AS (SELECT id, lat, lon, lat IS NOT NULL AND lon IS NOT NULL AND abs(lat) <= 90 AND abs(lon) <= 180 AS valid, {q.metres("lat", "lon", "48.2", "11.1")} AS m FROM v_business)
SELECT id, valid, round(m, 2) AS metres, round(m / 1000, 4) AS km, round(lat - 2.5 / 111.32::double, 6) AS min_lat, round(lon + 2.5 / (111.32::double * greatest(0.01, cos(radians(lat)))), 6) AS max_lon, m <= 9000 AS within FROM o""")
def g1_g3_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances, boxes, validity and radius."""
    b = view(spark, sf_dir, "v_business")
    m = geo.distance_m(F.col("lat"), F.col("lon"), F.lit(48.2), F.lit(11.1))
    box = geo.bounding_box(F.col("lat"), F.col("lon"), F.lit(2.5))
    return b.select("id", geo.is_valid_point(F.col("lat"), F.col("lon")).alias("valid"), F.round(m, 2).alias("metres"), F.round(m / 1000, 4).alias("km"), F.round(box["min_lat"], 6).alias("min_lat"), F.round(box["max_lon"], 6).alias("max_lon"), geo.is_within(F.col("lat"), F.col("lon"), F.lit(48.2), F.lit(11.1), F.lit(9)).alias("within"))


@query(f"""{B}, t AS (SELECT id, CASE k % 6 WHEN 0 THEN cast(k % 30 AS string) WHEN 1 THEN concat(cast(k % 26 AS string), ':', lpad(cast(k % 70 AS string), 2, '0')) WHEN 2 THEN concat(' ', cast(k % 24 AS string), '.30 ') WHEN 3 THEN 'noon' WHEN 4 THEN '24:00' ELSE '123' END AS x FROM v_business), p AS (SELECT *, regexp_extract(trim(x), '^(\\d{{1,2}})(?:[:.](\\d{{2}}))?$', 1) AS h, regexp_extract(trim(x), '^(\\d{{1,2}})[:.](\\d{{2}})$', 2) AS m FROM t)
SELECT id, CASE WHEN h <> '' AND h::int <= 24 AND coalesce(nullif(m, ''), '0')::int <= 59 THEN h::int * 60 + coalesce(nullif(m, ''), '0')::int END AS minutes FROM p""")
def h1_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: clock texts as minutes."""
    x = "CASE k % 6 WHEN 0 THEN cast(k % 30 AS string) WHEN 1 THEN concat(cast(k % 26 AS string), ':', lpad(cast(k % 70 AS string), 2, '0')) WHEN 2 THEN concat(' ', cast(k % 24 AS string), '.30 ') WHEN 3 THEN 'noon' WHEN 4 THEN '24:00' ELSE '123' END"
    return view(spark, sf_dir, "v_business").select("id", hours.parse_clock(F.expr(x)).alias("minutes"))


RULE = HOURS_RULE
DAY_MAP = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in DAY_WORDS.items()) + "}"
CLOCK = "CASE WHEN regexp_matches(trim({0}), '^\\d{{1,2}}([:.]\\d{{2}})?$') AND regexp_extract(trim({0}), '^(\\d{{1,2}})', 1)::int <= 24 AND coalesce(nullif(regexp_extract(trim({0}), '[:.](\\d{{2}})$', 1), ''), '0')::int <= 59 THEN regexp_extract(trim({0}), '^(\\d{{1,2}})', 1)::int * 60 + coalesce(nullif(regexp_extract(trim({0}), '[:.](\\d{{2}})$', 1), ''), '0')::int END"
START, END = CLOCK.format("string_split(s, '-')[1]"), CLOCK.format("string_split(s, '-')[2]")
# rules as rows, then their days and spans as rows, then each day's spans after its last "off"
WEEK = f"""{B}, h AS (SELECT id, timezone, trim(regexp_replace(opening_hours_raw, '\\s+', ' ', 'g')) AS raw FROM v_business), r AS (SELECT id, generate_subscripts(l, 1) AS n, unnest(l) AS rule FROM (SELECT id, list_filter(list_transform(string_split(raw, ';'), lambda x: trim(x)), lambda x: x <> '') AS l FROM h WHERE raw <> '' AND raw <> '24/7')),
p AS (SELECT *, NOT regexp_matches(rule, '(?i)\\b({"|".join(UNREAD_RULE_WORDS)})\\b') AND regexp_matches(rule, '{RULE}') AS fits, regexp_extract(rule, '{RULE}', 1) AS spec, lower(trim(regexp_extract(rule, '{RULE}', 2))) AS times FROM r),
d AS (SELECT id, n, list_transform(list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: [{DAY_MAP}[replace(lower(trim(string_split(x, '-')[1])), '.', '')], {DAY_MAP}[replace(lower(trim(coalesce(string_split(x, '-')[2], string_split(x, '-')[1]))), '.', '')]]) AS ends, times, rule, fits FROM p),
e AS (SELECT *, times IN ('off', 'closed', 'geschlossen') AS off, list_transform(string_split(times, ','), lambda s: CASE WHEN len(string_split(trim(s), '-')) = 2 THEN [{START}, {END}] END) AS spans FROM d),
g AS (SELECT *, fits AND len(ends) > 0 AND len(list_filter(ends, lambda x: x[1] IS NULL OR x[2] IS NULL)) = 0 AND (off OR len(list_filter(spans, lambda x: x IS NULL OR x[1] IS NULL OR x[2] IS NULL)) = 0) AS ok FROM e),
days AS (SELECT DISTINCT id, n, off, spans, (x.f + y.i) % 7 AS weekday FROM (SELECT id, n, off, spans, unnest(list_transform(ends, lambda e: {{'f': e[1], 't': e[2]}})) AS x FROM g WHERE ok), (SELECT unnest(range(7)) AS i) y WHERE y.i <= (x.t - x.f + 7) % 7),
since AS (SELECT id, weekday, max(CASE WHEN off THEN n ELSE 0 END) AS last_off FROM days GROUP BY 1, 2), flat AS (SELECT id, weekday, n, generate_subscripts(spans, 1) AS j, unnest(spans) AS s FROM (SELECT d.* FROM days d JOIN since USING (id, weekday) WHERE d.n > last_off AND NOT off)),
parts AS (SELECT id, weekday, n, j, 0 AS z, s[1] AS a, CASE WHEN s[2] <= s[1] THEN 1440 ELSE s[2] END AS b FROM flat UNION ALL SELECT id, weekday, n, j, 1, 0, s[2] FROM flat WHERE s[2] <= s[1] UNION ALL SELECT id, y.i, 1, 1, 0, 0, 1440 FROM h, (SELECT unnest(range(7)) AS i) y WHERE raw = '24/7'),
unread AS (SELECT id, array_to_string(list(rule ORDER BY n), '|') AS unparsed FROM g WHERE NOT ok GROUP BY id) """


@query(f"""{WEEK} SELECT h.id, coalesce(w.week, '') AS week, coalesce(u.unparsed, '') AS unparsed FROM h LEFT JOIN (SELECT id, array_to_string(list(concat(cast(weekday AS string), ' ', cast(a AS string), '-', cast(b AS string)) ORDER BY weekday, a, n, j, z), ',') AS week FROM parts GROUP BY id) w USING (id) LEFT JOIN unread u USING (id) WHERE raw <> ''""")
def h2_opening_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: rule texts as weeks."""

    def texts(h):
        week = F.flatten(F.transform(h["days"], lambda d: F.transform(d["intervals"], lambda x: F.concat(d["weekday"].cast("string"), F.lit(" "), x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))))
        return F.when(h.isNotNull(), F.struct(F.array_join(week, ",").alias("week"), F.array_join(h["unparsed"], "|").alias("unparsed")))

    return with_hours(view(spark, sf_dir, "v_business"), texts).where("h is not null").select("id", "h.week", "h.unparsed")


@query(f"""{B}, p AS (SELECT id, cast(k % 8 AS int) AS d, cast(8 + k % 5 AS int) * 60 AS a, CASE WHEN k % 4 = 0 THEN NULL ELSE cast((k + k % 2) % 7 AS int) END AS cd, CASE WHEN k % 4 = 0 THEN 1440 ELSE cast((k * 5) % 24 AS int) * 60 END AS b FROM v_business WHERE k % 8 < 7),
s AS (SELECT id, d AS w, a, CASE WHEN (CASE WHEN cd IS NULL OR cd = d THEN b ELSE 1440 END) <= a THEN 1440 WHEN cd IS NULL OR cd = d THEN b ELSE 1440 END AS e, 0 AS z FROM p UNION ALL SELECT id, cd, 0, b, 1 FROM p WHERE cd <> d AND b > 0)
SELECT id, array_to_string(list(concat(cast(w AS string), ' ', cast(a AS string), '-', cast(e AS string)) ORDER BY w, a, z), ',') AS week FROM s GROUP BY id""")
def h3_hours_of_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3: periods as weeks."""
    b = view(spark, sf_dir, "v_business")
    point = lambda d, h: F.struct(F.expr(d).cast("int").alias("day"), F.expr(h).cast("int").alias("hour"), F.lit(0).alias("minute"))
    period = F.struct(point("k % 8", "8 + k % 5").alias("open"), F.when(F.col("k") % 4 != 0, point("(k + k % 2) % 7", "(k * 5) % 24")).alias("close"))
    h = hours.hours_of_periods(F.array(period), F.col("timezone"))
    week = F.flatten(F.transform("h.days", lambda d: F.transform(d["intervals"], lambda x: F.concat(d["weekday"].cast("string"), F.lit(" "), x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))))
    return b.withColumn("h", h).where("h is not null").select("id", F.array_join(week, ",").alias("week"))


def _clock(x: str) -> str:
    return f"concat(lpad(cast({x} // 60 AS string), 2, '0'), ':', lpad(cast({x} % 60 AS string), 2, '0'))"


LOCAL = "timezone(h.timezone, make_timestamptz(({0}) * 1000))"
AT = f"{AS_OF} + (k * 7919) % 20160 * 60000"
NAMES = "[" + q.quoted(DAY_NAMES) + "]"


@query(f"""{WEEK}, c AS (SELECT h.id, isodow(l) % 7 AS w, hour(l) * 60 + minute(l) AS m FROM (SELECT h.id, {LOCAL.format(AT)} AS l FROM h JOIN v_business b ON b.id = h.id WHERE raw <> '')h),
x AS (SELECT c.id, m, w, p.weekday, a, b, n, j, z, (p.weekday - w + 7) % 7 AS ahead FROM c LEFT JOIN parts p USING (id)),
y AS (SELECT id, max(m) AS m, max(w) AS w, count(a) AS n, min(CASE WHEN ahead = 0 AND a <= m AND m < b THEN a * 10000 + b END) AS cur, min(CASE WHEN ahead = 0 AND a > m THEN a END) AS later, min(CASE WHEN ahead > 0 THEN ahead * 10000 + a ELSE 7 * 10000 + a END) AS nxt FROM x GROUP BY id)
SELECT y.id, CASE WHEN n = 0 THEN 'unknown' WHEN cur IS NOT NULL THEN 'open' ELSE 'closed' END AS state, u.unparsed IS NOT NULL AS partial,
CASE WHEN n = 0 THEN CASE WHEN u.unparsed IS NOT NULL THEN 'Hours could not be read' END WHEN cur IS NOT NULL THEN 'Closes ' || {_clock("(cur % 10000)")} WHEN later IS NOT NULL THEN 'Opens ' || {_clock("later")}
ELSE 'Opens ' || CASE WHEN nxt // 10000 = 1 THEN 'tomorrow' ELSE {NAMES}[(w + nxt // 10000) % 7 + 1] END || ' ' || {_clock("(nxt % 10000)")} END AS detail FROM y LEFT JOIN unread u USING (id)""")
def h4_opening_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: open, closed or unknown at an instant that differs by row, in the row's zone."""
    b = with_hours(view(spark, sf_dir, "v_business")).where("h is not null")
    return b.withColumn("s", hours.opening_status(F.col("h"), F.timestamp_millis(F.expr(AT)))).select("id", "s.state", "s.partial", "s.detail")


@query(f"""{WEEK}, t AS (SELECT h.id, isodow({LOCAL.format(str(AS_OF))}) % 7 AS today FROM h WHERE raw <> ''), texts AS (SELECT id, weekday, array_to_string(list(concat({_clock("a")}, '-', {_clock("b")}) ORDER BY a, n, j, z), ', ') AS text FROM parts GROUP BY 1, 2)
SELECT t.id, y.i AS weekday, {NAMES}[y.i + 1] AS label, coalesce(texts.text, 'Closed') AS text, y.i = today AS is_today FROM t, (SELECT unnest(range(7)) AS i) y LEFT JOIN texts ON texts.id = t.id AND texts.weekday = y.i""")
def h5_weekly_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: schedule rows."""
    b = with_hours(view(spark, sf_dir, "v_business"), lambda h: hours.weekly_schedule(h, F.timestamp_millis(F.lit(AS_OF)))).where("h is not null")
    rows = b.select("id", F.explode("h").alias("r"))
    return rows.select("id", "r.weekday", "r.label", "r.text", "r.is_today").withColumn("weekday", F.col("weekday").cast("long"))


@query(f"""{B}, l AS (SELECT h.id, h.timezone, x.ms, {LOCAL.format("x.ms")} AS l FROM v_business h JOIN (SELECT id, {AS_OF} - k * 7919000000 % 90000000000 AS ms FROM v_business) x USING (id)), s AS (SELECT *, ({AS_OF} - ms) / 1000.0::double AS sec FROM l)
SELECT id, year(l) AS year, month(l) AS month, day(l) AS day, hour(l) AS hour, minute(l) AS minute, isodow(l) % 7 AS weekday, hour(l) * 60 + minute(l) AS minutes, epoch_ms(timezone(timezone, date_trunc('day', l))) AS local_day_ms, ms - ms % 86400000 AS utc_day_ms, ms - 7 * 86400000 AS week_before_ms,
CASE WHEN sec >= 31536000 THEN 'year' WHEN sec >= 2592000 THEN 'month' WHEN sec >= 86400 THEN 'day' WHEN sec >= 3600 THEN 'hour' WHEN sec >= 60 THEN 'minute' ELSE 'now' END AS unit,
cast(CASE WHEN sec >= 31536000 THEN floor(sec / 31536000 + 0.5) WHEN sec >= 2592000 THEN floor(sec / 2592000 + 0.5) WHEN sec >= 86400 THEN floor(sec / 86400 + 0.5) WHEN sec >= 3600 THEN floor(sec / 3600 + 0.5) WHEN sec >= 60 THEN floor(sec / 60 + 0.5) ELSE 0 END AS bigint) AS count FROM s""")
def h6_h7_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6 and H7: zone parts, day starts, ages."""
    b = view(spark, sf_dir, "v_business").withColumn("at", F.timestamp_millis(F.expr(f"{AS_OF} - k * 7919000000 % 90000000000")))
    at, zone = F.col("at"), F.col("timezone")
    b = b.withColumns({"p": timeutil.zoned_parts(at, zone), "age": timeutil.relative_age(at, F.timestamp_millis(F.lit(AS_OF)))})
    ms = F.unix_millis
    return b.select("id", *[F.col(f"p.{c}").cast("long").alias(c) for c in ("year", "month", "day", "hour", "minute", "weekday")], timeutil.minutes_of_day(at, zone).cast("long").alias("minutes"), ms(timeutil.start_of_local_day(at, zone)).alias("local_day_ms"), ms(timeutil.start_of_utc_day(at)).alias("utc_day_ms"), ms(timeutil.days_before(at, 7)).alias("week_before_ms"), "age.unit", "age.count")
