from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lonja.operators import timestamps as ts

ZONES = ["America/Lima", "America/New_York", "Europe/Madrid", "America/Bogota"]
CASES = [
    ("28/03/2025 12:00:00 a.m.", "America/Lima", False, "2025-03-28 05:00:00.000000"), ("27/03/2025 05:57:33 p. m. ", "America/Lima", False, "2025-03-27 22:57:33.000000"),
    ("03/14/2021 02:11", "America/New_York", True, "2021-03-14 07:11:00.000000"), ("2021-11-07 01:30:35", "America/New_York", False, "2021-11-07 05:30:35.000000"),
    ("2021-11-07 01:30:35 EST", "America/New_York", False, "2021-11-07 06:30:35.000000"), ("Sun, 12 Mar 2023 07:59:26 GMT", "America/Lima", False, "2023-03-12 07:59:26.000000"),
    ("2021-03-28 02:22:59", "Europe/Madrid", False, "2021-03-28 01:22:59.000000"), ("1610138137", "America/Lima", False, "2021-01-08 20:35:37.000000"),
    ("/Date(1610370545939)/", None, False, "2021-01-11 13:09:05.939000"), ("20210104095717", "America/Lima", False, "2021-01-04 14:57:17.000000"),
    ("2021-01-05T13:13:02-05:00", None, False, "2021-01-05 18:13:02.000000"), ("2021-01-06 13:12:06.115 -0500", None, False, "2021-01-06 18:12:06.115000"),
    ("2021-01-04 12:21:07 UTC-5", None, False, "2021-01-04 17:21:07.000000"), ("01-Abr-2022 13:01:53", "America/Lima", False, "2022-04-01 18:01:53.000000"),
    ("Apr 10, 2022", "America/Lima", False, "2022-04-10 05:00:00.000000"), ("31Dic89", "America/Lima", False, "2089-12-31 05:00:00.000000"), ("1Set.98", "America/Lima", False, "1998-09-01 05:00:00.000000"),
    ("2021-01-06 05:35:09.483594", "America/Bogota", False, "2021-01-06 10:35:09.483594"),
] + [(t, "America/Lima", False, None) for t in ("31/02/2022 10:15:00", "00/00/0000 00:00:00", "32/01/2023 11:11:11 a.m.", "13/40/2024 09:00", "n.d.", "-", "", None, "05Xyz01", "x" * 100_000, "25:00", "2021-01-01 24:30:00", "01/01/2021 13:00:00 p.m.")] + [("2021-01-01 10:00:00", None, False, None), ("2021-01-01 10:00:00", "No/Zone", False, None)]


def test_cases(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, t string, z string, m boolean, w string")
    out = ts.normalise(df, F.col("t"), F.col("z"), F.col("m"), [*ZONES, "No/Zone", ""], [F.col("i"), F.col("w"), F.col("t").alias("local_texto")])
    bad = out.withColumn("g", ts.instant_text(F.col("instante"))).where("not (g <=> w)").collect()
    assert out.count() == len(CASES) and bad == []


def test_long_texts_are_read_whole_or_not_at_all(spark):
    long = "miercoles, 15 de septiembre de 2024, 12:34:56.123456 a. m. UTC+05:30"
    cases = [(long, "2024-09-14 19:04:56.123456"), ("2021-01-01" + " " * 80 + "10:00:00Z", "2021-01-01 10:00:00.000000"), (long + " x" * 40, None), ("2021-01-01 10:00:00" + "Z" * 200, None)]
    df = spark.createDataFrame(cases, "t string, w string")
    out = ts.normalise(df, F.col("t"), F.lit("America/Lima"), F.lit(False), ZONES, [F.col("t"), F.col("w")])
    assert out.withColumn("g", ts.instant_text(F.col("instante"))).where("not (g <=> w)").collect() == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "t string, z string, m boolean")
    assert ts.normalise(df, F.col("t"), F.col("z"), F.col("m"), ZONES, []).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.datetimes(datetime(1950, 1, 1), datetime(2035, 1, 1)), st.sampled_from(ZONES))
def test_tables_agree_with_the_zone_database(local, zone):
    micro = timedelta(microseconds=1)
    epoch = datetime(1970, 1, 1)
    want = local.replace(tzinfo=ZoneInfo(zone), fold=0).astimezone(timezone.utc).replace(tzinfo=None)
    got = ts.to_utc(np.array([(local - epoch) // micro]), np.array([zone], dtype=object), {zone: ts.zone_table(zone)})[0]
    assert got == (want - epoch) // micro


def test_unknown_zone_raises():
    with pytest.raises(Exception):
        ts.zone_table("No/Zone")
