"""Calendars of the caller's own: small tables that joins may broadcast."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.clock import epoch_us

#: New York release times by kind of news (fixed values).
NEWS_TIMES = {"fomc": "14:00", "nfp": "08:30", "cpi": "08:30", "ppi": "08:30", "gdp": "08:30"}


def holidays(spark: SparkSession, days: str | Iterable[str] | Mapping[str, str]) -> DataFrame:
    """session_date, name of holidays: from dates, from a mapping of dates to names, or from a JSON file of either.

    A calendar holds a few days a year; a date given twice counts once.
    """
    if isinstance(days, str):
        text = "\n".join(r.value for r in spark.read.text(days).collect())
        days = json.loads(text)
    named = dict(days) if isinstance(days, Mapping) else dict.fromkeys(days)
    table = spark.createDataFrame([(str(d), n) for d, n in named.items()], "d string, name string")
    return table.select(F.to_date("d").alias("session_date"), "name")


def news_windows(spark: SparkSession, dates: Mapping[str, Iterable[str]], times: Mapping[tuple[str, str], str] | None = None, minutes: int = 5) -> DataFrame:
    """kind, session_date, lo, hi (microseconds on the session clock) of the windows around releases.

    dates: days by kind; a release is at its kind's usual New York time unless
    ``times`` has another for (kind, day).
    """
    unknown = set(dates) - set(NEWS_TIMES)
    if unknown:
        raise ValueError(f"unknown kinds of news: {sorted(unknown)}")
    rows = [(kind, f"{day} {(times or {}).get((kind, day), NEWS_TIMES[kind])}:00") for kind, days in dates.items() for day in days]
    at = F.col("at").cast("timestamp_ntz") + F.expr("INTERVAL '6' HOUR")
    width = minutes * 60_000_000
    return spark.createDataFrame(rows, "kind string, at string").select("kind", F.to_date(at).alias("session_date"), (epoch_us(at) - width).alias("lo"), (epoch_us(at) + width).alias("hi"))


def contracts(spark: SparkSession, path: str) -> DataFrame:
    """code, instrument_id, first, last of a CSV with a header: which contract an id stood for, and when."""
    return spark.read.option("header", True).schema("code string, instrument_id int, first date, last date").csv(path)
