"""Free-form dates: vectors of every form, and every day of the calendar in two of them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagemill.functions.dates import date_coverage, free_date

D = dt.datetime
NOW = D(2024, 3, 31, 12, 30, 5)
VECTORS = {
    "2024-01-02": D(2024, 1, 2), "2024/1/2 3:04": D(2024, 1, 2, 3, 4), "2024-01-02T03:04:05Z": D(2024, 1, 2, 3, 4, 5),
    "2024-01-02T03:04:05.25+08:00": D(2024, 1, 1, 19, 4, 5, 250000), "2024-01-02 03:04:05 -0530": D(2024, 1, 2, 8, 34, 5),
    "20240102": D(2024, 1, 2), "20240102T030405": None, "2024-05": D(2024, 5, 1), "2024-13-01": None, "2024-02-30": None,
    "1/2/2024": D(2024, 1, 2), "13/1/2024": None, "2-1-2024": D(2024, 1, 2), "2.1.2024 5 pm": D(2024, 1, 2, 17),
    "2 January 2024": D(2024, 1, 2), "2nd of Jan, 2024": D(2024, 1, 2), "02-Jan-2024 03:04": D(2024, 1, 2, 3, 4),
    "January 2, 2024": D(2024, 1, 2), "Sept. 3rd 2024 at 12:00 am": D(2024, 9, 3), "Dec 31, 2024 11:59:59 P.M.": D(2024, 12, 31, 23, 59, 59),
    "March 2024": D(2024, 3, 1), "Tue, 02 Jan 2024 03:04:05 GMT": D(2024, 1, 2, 3, 4, 5), "tuesday 2 jan 2024": D(2024, 1, 2),
    "  2   JAN\t2024  10:00 EST ": D(2024, 1, 2, 15), "2 Jan 2024 10:00 UTC+2": D(2024, 1, 2, 8), "2 Jan 2024 24:00": None,
    "2 Jan 2024 13 pm": None, "2 Jan 2024 7": None, "2 Jan 2024 10:61": None, "2 Jan 20245": None, "2024-01-023": None,
    "marching 2 2024": None, "": None, "soon": None, None: None, "now": NOW, "today": D(2024, 3, 31), "Yesterday 10:30": D(2024, 3, 30, 10, 30),
    "tomorrow 9am": D(2024, 4, 1, 9), "3 days ago": D(2024, 3, 28, 12, 30, 5), "an hour ago": D(2024, 3, 31, 11, 30, 5),
    "+2 weeks": D(2024, 4, 14, 12, 30, 5), "-1 month": D(2024, 2, 29, 12, 30, 5), "a fortnight ago": D(2024, 3, 17, 12, 30, 5),
    "last year": D(2023, 3, 31, 12, 30, 5), "next min": D(2024, 3, 31, 12, 31, 5), "90 secs ago": D(2024, 3, 31, 12, 28, 35), "todays": None,
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(VECTORS)], "id int, s string")
    now = F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz")
    return rows.select("s", free_date(F.col("s"), now).alias("d"), free_date(F.col("s")).alias("no_now")).collect()


def test_vectors(parsed):
    assert {r.s: r.d for r in parsed} == VECTORS


def test_relative_needs_a_time(parsed):
    assert all(r.no_now is None for r in parsed if r.s in ("now", "today", "3 days ago", "last year", "tomorrow 9am"))
    assert {r.s: r.no_now for r in parsed}["January 2, 2024"] == D(2024, 1, 2)


def test_every_day_both_ways(spark):
    days = spark.range(3 * 366).select(F.timestamp_add("DAY", F.col("id").cast("int"), F.lit("2023-01-01").cast("timestamp_ntz")).alias("d"))
    for form in ("d MMMM yyyy", "MMM d, yyyy"):
        assert days.where(~free_date(F.date_format("d", form)).eqNullSafe(F.col("d"))).count() == 0


def test_coverage(spark):
    rows = spark.createDataFrame([(1, "now"), (1, "x"), (1, " "), (2, "May 2024"), (2, None)], "k int, s string")
    out = date_coverage(rows.withColumn("d", free_date(F.col("s"))), ["k"], "s", "d")
    assert {tuple(r) for r in out.collect()} == {(1, 1, 0, 2), (2, 1, 1, 0)}
