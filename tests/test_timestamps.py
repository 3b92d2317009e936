"""Timestamps against the standard library, and the cases that name no instant."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keepsieve.functions.timestamps import instants, normalise_timestamps
from keepsieve.functions.zones import transitions, zone_data_version

UTC = timezone.utc


def one(text, tz=None, order=None):
    got = instants(pd.Series([text], dtype=object), pd.Series([tz], dtype=object), pd.Series([order], dtype=object))[0]
    return None if pd.isna(got) else int(got)


def ms(*args, tz=UTC):
    return int(datetime(*args, tzinfo=tz).timestamp() * 1000)


@pytest.mark.parametrize(
    "text,tz,order,want",
    [
        ("2020-01-05T10:11:12Z", None, None, ms(2020, 1, 5, 10, 11, 12)),
        ("2020-01-05T10:11:12,345Z", None, None, ms(2020, 1, 5, 10, 11, 12) + 345),
        ("2020-01-05T10:11:12.3459+01:00", None, None, ms(2020, 1, 5, 9, 11, 12) + 345),
        ("20200105T101112Z", None, None, ms(2020, 1, 5, 10, 11, 12)),
        ("Sun Jan 05 10:11:12 +0000 2020", None, None, ms(2020, 1, 5, 10, 11, 12)),
        ("Tue, 07 Jan 2020 14:48:14 PST", None, None, ms(2020, 1, 7, 22, 48, 14)),
        ("7 Jan 20 14:48 -0000", None, None, ms(2020, 1, 7, 14, 48)),
        ("January 7, 2020 3:30 am", "America/Chicago", "mdy", ms(2020, 1, 7, 9, 30)),
        ("January 7, 2020 12:05 am", "UTC", "ymd", ms(2020, 1, 7, 0, 5)),
        ("January 7, 2020 12:05 pm", "UTC", "ymd", ms(2020, 1, 7, 12, 5)),
        ("Jan 24, 2020 7:09:20 AM GMT+11:00", None, None, ms(2020, 1, 23, 20, 9, 20)),
        ("13. Oktober 2019, 14:42 Uhr", "Europe/Berlin", "dmy", ms(2019, 10, 13, 12, 42)),
        ("03/04/2020 10:00:00", "UTC", "dmy", ms(2020, 4, 3, 10)),
        ("03/04/2020 10:00:00", "UTC", "mdy", ms(2020, 3, 4, 10)),
        ("2020-01-12T04:49:05+00:00[Europe/London]", None, None, ms(2020, 1, 12, 4, 49, 5)),
        ("2018-08-25 05:37:01 Europe/Berlin", None, None, ms(2018, 8, 25, 3, 37, 1)),
        ("  1578220625  ", None, None, 1578220625000),
        ("1578220625.75", None, None, 1578220625750),
        ("1578220625123", None, None, 1578220625123),
        ("1578220625123999", None, None, 1578220625123),
        ("1578055179231120154", None, None, 1578055179231),
    ],
)
def test_named(text, tz, order, want):
    assert one(text, tz, order) == want


@pytest.mark.parametrize(
    "text,tz,order",
    [
        (None, "UTC", "ymd"), ("", "UTC", "ymd"), ("   ", "UTC", "ymd"), ("yesterday", "UTC", "ymd"), ("3 weeks ago", "UTC", "ymd"), ("2020-01-05", "UTC", "ymd"), ("January 2020", "UTC", "ymd"),
        ("2019-02-30T12:35:17Z", None, None), ("2020-01-06T25:03:45+00:00", None, None), ("0000-00-00 00:00:00", "UTC", "ymd"), ("2020-01-05 10:00", None, None), ("2020-01-05 10:00 Mars/Base", None, None),
        ("2020-01-05 10:00 IST", None, None), ("13/13/2020 10:00:00", "UTC", "dmy"), ("01/24/2020 3:45 AM", "UTC", "dmy"), ("2021-03-28 02:30:00", "Europe/Berlin", "dmy"),  # skipped
        ("2020-10-25 02:30:00", "Europe/Berlin", "dmy"), ("January 7, 2020 13:05 pm", "UTC", "ymd"), ("x" * 100_000, "UTC", "ymd"), ("1" * 70, "UTC", "ymd"),  # twice
    ],
)
def test_unnamed(text, tz, order):
    assert one(text, tz, order) is None


@settings(max_examples=150, deadline=None)
@given(st.datetimes(datetime(1971, 1, 1), datetime(2090, 1, 1)), st.sampled_from(["Europe/Berlin", "America/New_York", "Asia/Kathmandu", "Australia/Adelaide", "Africa/Casablanca", "America/Sao_Paulo"]))
def test_zone_reading_is_the_only_one(when, name):
    when = when.replace(microsecond=0)
    zone = ZoneInfo(name)
    found = set()
    for fold in (0, 1):
        at = when.replace(tzinfo=zone, fold=fold).astimezone(UTC)
        if at.astimezone(zone).replace(tzinfo=None) == when:
            found.add(int(at.timestamp()) * 1000)
    got = one(when.strftime("%Y-%m-%d %H:%M:%S"), name, "ymd")
    assert got == (found.pop() if len(found) == 1 else None)


def test_transitions_meet_the_library():
    starts, offsets = transitions("Europe/Berlin")
    for s, o in zip(starts[1:], offsets[1:], strict=True):
        for at, want in ((int(s), o),):
            assert (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=at)).astimezone(ZoneInfo("Europe/Berlin")).utcoffset().total_seconds() == want
    assert zone_data_version() and transitions("No/Where") is None


def test_table_with_clashing_columns_repeats_and_nulls(spark):
    items = spark.createDataFrame([(1, "a", "2020-01-05 10:00", "x"), (1, "a", "2020-01-05 10:00", "x"), (2, None, "2020-01-05 10:00", "y"), (3, "b", None, None)], "id int, collection string, created_at string, tz string")
    origin = spark.createDataFrame([("a", "m", "Europe/Paris", "dmy"), ("a", "m", "Europe/Paris", "dmy")], "collection string, medium string, tz string, date_order string")
    got = normalise_timestamps(items, origin).orderBy("id").collect()
    assert [r["created_ms"] for r in got] == [ms(2020, 1, 5, 9)] * 2 + [None, None]
    assert got[0]["tz"] == "x"
    assert normalise_timestamps(items.limit(0), origin.limit(0)).count() == 0
