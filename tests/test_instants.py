"""Date notations against Python's own zone rules."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from mailloom.operators.instants import corrected_hours, normalise_instants

BOXES = [("ny", "America/New_York", False), ("lon", "Europe/London", True), ("bad", "Mars/Base", True), ("none", None, None), ("utc", "UTC", True)]


def found(spark, texts):
    emails = spark.createDataFrame([(i, t, x, None) for i, (t, x) in enumerate(texts)], "id long, date_text string, x_origin string, tz_name string")
    boxes = spark.createDataFrame(BOXES, "x_origin string, tz_name string, day_first boolean")
    rows = {r["id"]: r["utc_us"] for r in normalise_instants(emails, boxes).select("id", "utc_us").collect()}
    return [rows[i] for i in range(len(texts))]


def us(*parts, zone="UTC", micro=0):
    return int(dt.datetime(*parts, tzinfo=ZoneInfo(zone)).timestamp()) * 1_000_000 + micro


CASES = [
    ("Mon, 1 Jan 2001 09:30:00 -0500", None, us(2001, 1, 1, 14, 30)), ("tue, 18 jan 2022 08:43:57 +0530", None, us(2022, 1, 18, 3, 13, 57)),
    ("Sat, 10 Sep 2022 21:46:45 CDT", "lon", us(2022, 9, 11, 2, 46, 45)), ("Sun, 13 Mar 2022 00:36:45 -0500 (EST)", None, us(2022, 3, 13, 5, 36, 45)),
    ("  3 Jun 2023 15:42:08  Z ", None, us(2023, 6, 3, 15, 42, 8)), ("2023-09-20 07:14:06 Europe/London", "ny", us(2023, 9, 20, 6, 14, 6)),
    ("2022-06-26T21:20:53-05:00[America/Chicago]", None, us(2022, 6, 27, 2, 20, 53)), ("2023-06-24T22:23:34.572031-05", None, us(2023, 6, 25, 3, 23, 34, micro=572031)),
    ("2024-06-09T08:46", "ny", us(2024, 6, 9, 8, 46, zone="America/New_York")), ("20220105T193104", "lon", us(2022, 1, 5, 19, 31, 4)),
    ("Fri Dec 29 21:00:18 2023", "ny", us(2023, 12, 29, 21, 0, 18, zone="America/New_York")), ("05-Feb-24 00:03:09", "lon", us(2024, 2, 5, 0, 3, 9)),
    ("03/04/2023 12:37 PM", "lon", us(2023, 4, 3, 12, 37, zone="Europe/London")), ("03/04/2023 12:37 AM", "ny", us(2023, 3, 4, 0, 37, zone="America/New_York")),
    ("1667086933", None, 1667086933_000_000), ("1672258575303", None, 1672258575303_000), ("1733260893364380", None, 1733260893364380),
    ("13/02/2023 10:00", "ny", None), ("2023-13-05T10:00:00Z", None, None), ("Fri, 31 Feb 2023 10:00:00 +0000", None, None), ("2024-02-29T00:00:00Z", None, us(2024, 2, 29)),
    ("2023-02-29T00:00:00Z", None, None), ("2024-06-09T24:00:00Z", None, None), ("2024-06-09T08:46:60Z", None, None), ("0000-00-00 00:00:00", "ny", None),
    ("2024-03-10T02:30", "ny", None), ("2024-11-03T01:30", "ny", None), ("2024-11-03T00:59:59", "ny", us(2024, 11, 3, 0, 59, 59, zone="America/New_York")), ("2024-03-10T03:00", "ny", us(2024, 3, 10, 3, zone="America/New_York")),
    ("2024-06-09T08:46", None, None), ("2024-06-09T08:46", "nobody", None), ("2024-06-09T08:46", "bad", None), ("2024-06-09T08:46", "none", None), ("2024-06-09T08:46", "utc", us(2024, 6, 9, 8, 46)),
    ("Tue, 1 Feb 2022 10:00:00 XST", None, None), ("2022-01-01 10:00:00 Mars/Base", "ny", None), (None, "ny", None), ("", "ny", None), ("yesterday 9am", "ny", None), ("7", "ny", None),
]


def test_notations(spark):
    assert found(spark, [(t, x) for t, x, _ in CASES]) == [w for *_, w in CASES]


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/London", "Australia/Sydney", "Asia/Kathmandu"])
def test_every_half_hour_around_transitions(spark, zone):
    """Against brute force: a reading counts if exactly one fold of it exists."""
    tz, start = ZoneInfo(zone), dt.datetime(2024, 1, 1)
    readings = [start + dt.timedelta(minutes=30 * k) for k in range(0, 48 * 366, 7)] + [start.replace(month=m, day=d) + dt.timedelta(minutes=20 * k) for m, d in ((3, 9), (3, 30), (4, 6), (10, 5), (10, 26), (11, 2)) for k in range(150)]

    def instants(t):
        return {u for fold in (0, 1) if (u := t.replace(tzinfo=tz, fold=fold).timestamp()) is not None and dt.datetime.fromtimestamp(u, tz).replace(tzinfo=None) == t}

    emails = spark.createDataFrame([(i, t.isoformat(), "z") for i, t in enumerate(readings)], "id long, date_text string, x_origin string")
    boxes = spark.createDataFrame([("z", zone, True)], "x_origin string, tz_name string, day_first boolean")
    got = {r["id"]: r["utc_us"] for r in normalise_instants(emails, boxes).collect()}
    for i, t in enumerate(readings):
        want = instants(t)
        assert got[i] == (int(want.pop()) * 1_000_000 if len(want) == 1 else None), t


def test_keeps_rows_and_extra_columns(spark):
    emails = spark.createDataFrame([(1, "1667086933", None, "a")] * 3, "id long, date_text string, x_origin string, _zone2 string")
    boxes = spark.createDataFrame([("x", "UTC", True), ("x", "Asia/Kolkata", True)], "x_origin string, tz_name string, day_first boolean")
    assert normalise_instants(emails, boxes).count() == 3
    assert normalise_instants(emails.limit(0), boxes.limit(0)).count() == 0


def test_hours(spark):
    emails = spark.createDataFrame([(1, "<a>", "1667086933", None), (2, "a", "1667090533", None), (3, None, "1667086933", None)], "id long, message_id string, date_text string, x_origin string").withColumn("received_at", F.lit("2022-01-01").cast("timestamp"))
    meta = spark.createDataFrame([("a", 23), ("b", 1)], "message_id string, sent_hour int")
    boxes = spark.createDataFrame([], "x_origin string, tz_name string, day_first boolean")
    assert [(r["identifier"], r["sent_hour"], r["agrees"]) for r in corrected_hours(emails, boxes, meta).collect()] == [("a", 23, True)]
