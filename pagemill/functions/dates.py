"""Free-form dates (C17): a small grammar in Catalyst expressions.

    date  := [weekday[,]] day [time] [zone]  |  relative
    day   := Y-m-d  Y/m/d  Y-m  Ymd  |  m/d/Y  |  d-m-Y  d.m.Y  |  d month [Y]  d-mon-Y  |  month d[,] Y  |  month Y
    time  := H:M[:S[.fraction]] [am|pm]  |  H am|pm        (after a blank, 'T', ',' or 'at')
    zone  := Z, UTC, GMT, +HH[[:]MM], a name of ZONES
    relative := now, today, midnight, yesterday, tomorrow [time]  |  [+|-]N unit[s] [ago]  |  last|next unit

Case and runs of blanks do not matter; ordinals (1st, 2nd) and 'of' are allowed. Zones are taken to
UTC, fractions to microseconds. Relative dates need ``as_of``. What is none of this, or no day of the
calendar, is null; months added to a day past the end of a month end on its last day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Month names by their first three letters, zone names with their hours from UTC.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH = ("(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|"
         "nov(?:ember)?|dec(?:ember)?)")
ZONES = {"z": 0, "utc": 0, "gmt": 0, "est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7,
         "bst": 1, "cet": 1, "cest": 2, "jst": 9}
UNITS = {"sec": "SECOND", "second": "SECOND", "min": "MINUTE", "minute": "MINUTE", "hour": "HOUR", "day": "DAY", "week": "WEEK",
         "fortnight": "FORTNIGHT", "month": "MONTH", "year": "YEAR"}

_WEEKDAY = r"^(?:mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:rs(?:day)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\.?,? (?=.)"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"
_END = r"(?!\d)(.*)$"
# Forms of a day, with the groups of year, month and day; 0 is the first of the month. The rest is the last group.
FORMS = [
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})" + _END, 1, 2, 3),
    (r"^(\d{4})(\d{2})(\d{2})" + _END, 1, 2, 3),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})" + _END, 3, 1, 2),
    (r"^(\d{1,2})[-.](\d{1,2})[-.](\d{4})" + _END, 3, 2, 1),
    (r"^" + _DAY + r"[ -]?(?:of )?" + MONTH + r"\.?,?[ -](\d{4})" + _END, 3, 2, 1),
    (r"^" + MONTH + r"\.? " + _DAY + r",? (\d{4})" + _END, 3, 1, 2),
    (r"^" + MONTH + r"\.?,? (\d{4})()" + _END, 2, 1, 0),
    (r"^(\d{4})-(\d{2})()" + r"(?![-\d])(.*)$", 1, 2, 0),
]
_TIME = r"(\d{1,2})(?::(\d{2})(?::(\d{2}(?:[.,]\d{1,6})?)\d*)?)? ?([ap]\.?m\.?)?"
TAIL = r"^(?:(?:t|,? at |, ?| )" + _TIME + r")? ?(" + "|".join(ZONES) + r"|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?)?$"
_RELATIVE = r"^([+-]?\d{1,6}|an?) ?(" + "|".join(UNITS) + r")s?( ago)?$"
_NEAR = r"^(last|next) (" + "|".join(UNITS) + r")$"


def _group(s: Column, pattern: str, n: int) -> Column:
    return F.nullif(F.regexp_extract(s, pattern, n), F.lit(""))


def _number(text: Column) -> Column:
    return text.try_cast("int")


def _month(text: Column) -> Column:
    named = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(text, 1, 3)), F.lit(0))
    return F.coalesce(_number(text), named.cast("int"))


def _clock(rest: Column) -> Column:
    """(ok, hour, minute, second, offset in minutes) of what follows a day."""
    part = lambda n: _group(rest, TAIL, n)
    hour, half, zone = _number(part(1)), F.substring(part(4), 1, 1), part(5)
    sign = F.when(zone.contains("-"), -1).otherwise(1)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    hours = F.when(F.length(digits) > 2, F.substring(digits, 1, 4)).otherwise(F.concat(digits, F.lit("00")))
    hours = F.lpad(hours, 4, "0")
    named = F.lit(0)
    for name, h in ZONES.items():
        named = F.when(zone == name, F.lit(60 * h)).otherwise(named)
    offset = F.when(F.coalesce(digits, F.lit("")) != "", sign * (_number(F.substring(hours, 1, 2)) * 60 + _number(F.substring(hours, 3, 2)))).otherwise(named)
    plain = half.isNull()
    ok = rest.rlike(TAIL) & (hour.isNull() | F.when(plain, part(2).isNotNull() & (hour < 24)).otherwise(hour.between(1, 12)))
    hour = F.when(plain, hour).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    seconds = F.replace(F.coalesce(part(3), F.lit("0")), F.lit(","), F.lit("."))
    return F.struct(ok.alias("ok"), F.coalesce(hour, F.lit(0)).alias("h"), F.coalesce(_number(part(2)), F.lit(0)).alias("m"),
                    seconds.try_cast("decimal(16,6)").alias("s"), offset.alias("offset"))


def free_date(col: Column, as_of: Column | None = None) -> Column:
    """The time (UTC, without a zone) that a free-form date names, or null."""
    from pagemill.functions.text import let

    cleaned = F.regexp_replace(F.lower(F.trim(F.regexp_replace(col, r"\s+", " "))), _WEEKDAY, "")

    def absolute(s: Column) -> Column:
        found = [F.when(s.rlike(p), F.struct(
            _number(F.regexp_extract(s, p, y)).alias("y"), _month(F.regexp_extract(s, p, m)).alias("m"),
            (_number(F.regexp_extract(s, p, d)) if d else F.lit(1)).alias("d"), F.regexp_extract(s, p, 4).alias("rest"))) for p, y, m, d in FORMS]

        def timed(day: Column) -> Column:
            return let(_clock(day["rest"]), lambda c: F.when(c["ok"], F.timestamp_add("MINUTE", -c["offset"], F.try_make_timestamp_ntz(
                day["y"], day["m"], day["d"], c["h"], c["m"], c["s"]))))

        return let(F.coalesce(*found), timed)

    def relative(s: Column) -> Column:
        ts = as_of.cast("timestamp_ntz")
        n = F.regexp_extract(s, _RELATIVE, 1)
        count = F.coalesce(_number(n), F.lit(1)) * F.when(_group(s, _RELATIVE, 3).isNotNull(), -1).otherwise(1)
        unit, near = F.regexp_extract(s, _RELATIVE, 2), F.regexp_extract(s, _NEAR, 2)

        def moved(by: Column, name: Column) -> Column:
            out = F.lit(None).cast("timestamp_ntz")
            for u, spark_unit in UNITS.items():
                step = F.timestamp_add("WEEK", by * 2, ts) if spark_unit == "FORTNIGHT" else F.timestamp_add(spark_unit, by, ts)
                out = F.when(name == u, step).otherwise(out)
            return out

        word = r"^(today|midnight|yesterday|tomorrow)(.*)$"
        days = F.when(s.startswith("y"), -1).when(s.startswith("tom"), 1).otherwise(0)
        base = F.timestamp_add("DAY", days, F.date_trunc("DAY", ts).cast("timestamp_ntz"))
        at_time = let(_clock(F.regexp_extract(s, word, 2)), lambda c: F.when(c["ok"], F.timestamp_add(
            "MICROSECOND", (c["s"] * 1000000).cast("long"), F.timestamp_add("MINUTE", c["h"] * 60 + c["m"] - c["offset"], base))))
        return F.when(s == "now", ts).when(s.rlike(word), at_time).when(s.rlike(_RELATIVE), moved(count, unit)) \
            .when(s.rlike(_NEAR), moved(F.when(s.startswith("l"), -1).otherwise(1), near))

    if as_of is None:
        return let(cleaned, absolute)
    return let(cleaned, lambda s: F.coalesce(absolute(s), relative(s)))


def date_coverage(rows: DataFrame, group: list[str], raw: str, parsed: str) -> DataFrame:
    """Per group how many raw dates were empty, understood and not understood."""
    empty = F.trim(F.coalesce(F.col(raw), F.lit(""))) == ""
    return rows.groupBy(*group).agg(F.count_if(empty).alias("empty"), F.count_if(~empty & F.col(parsed).isNotNull()).alias("understood"),
                                    F.count_if(~empty & F.col(parsed).isNull()).alias("refused"))
