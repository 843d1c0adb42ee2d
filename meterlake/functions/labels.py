"""Texts that are shown: titles, sums, providers, groups."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake.functions import times

#: Code points of a session title in an option.
TITLE = 48
#: White space as the logs' writers see it: ASCII, no-break, byte order mark, Unicode separators.
SPACES = r"[\s ﻿\p{Z}]+"


def short_title(title: Column) -> Column:
    """White space collapsed, cut to TITLE code points with an ellipsis."""
    flat = F.trim(F.regexp_replace(title, SPACES, " "))
    return F.when(F.length(flat) <= TITLE, flat).otherwise(F.concat(F.substring(flat, 1, TITLE - 1), F.lit("…")))


def usd(nano: Column) -> Column:
    """Dollars with two digits, four below a cent; rounded half up from whole nanodollars."""
    tiny = (nano > 0) & (nano < 10_000_000)
    exact = nano.cast("decimal(20,0)") / F.lit(1_000_000_000).cast("decimal(20,0)")
    text = lambda scale: F.concat(F.lit("$"), F.round(exact, scale).cast(f"decimal(20,{scale})").cast("string"))
    return F.when(tiny, text(4)).otherwise(text(2))


def provider_label(provider: Column) -> Column:
    return F.when(provider == "anthropic", "Claude").when(provider == "moonshotai", "Kimi").otherwise(provider)


def recency_rank(age: Column, split_day: Column) -> Column:
    return F.when(age < 1, 0).when(age <= split_day, 1).otherwise(2)


def recency_group(age: Column, split_day: Column) -> Column:
    rank, day = recency_rank(age, split_day), split_day.cast("string")
    return F.when(rank == 0, "Last 24 hours").when((rank == 1) & (split_day == 1), "1 day ago").when(rank == 1, F.concat(F.lit("1–"), day, F.lit(" days ago"))).otherwise(F.concat((split_day + 1).cast("string"), F.lit("+ days ago")))


def session_option(updated_ms: Column, spend_nano: Column, title: Column, project: Column, now_ms: int) -> Column:
    return F.concat_ws(" · ", times.age_label(updated_ms, now_ms), usd(spend_nano), short_title(title), project)


def workspace_of(directory: Column) -> Column:
    """Last part of a path with either separator."""
    return F.regexp_extract(directory, r"([^/\\]+)[/\\]*$", 1)


def csv_field(value: Column) -> Column:
    """Quoted where a comma, quote or line break asks for it."""
    return F.when(value.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def bundled_date(source: Column) -> Column:
    return F.nullif(F.regexp_extract(source, r"(\d{4})-(\d{2})-(\d{2})", 0), F.lit(""))


def idle_duration(ms: Column) -> Column:
    """1d 2h, 3h 4m or 5m."""
    part = lambda unit, of=None: (F.floor(ms / unit) if of is None else F.floor(F.pmod(ms, F.lit(of)) / unit)).cast("string")
    return F.when(ms >= times.DAY, F.concat(part(times.DAY), F.lit("d "), part(times.HOUR, times.DAY), F.lit("h"))).when(ms >= times.HOUR, F.concat(part(times.HOUR), F.lit("h "), part(times.MINUTE, times.HOUR), F.lit("m"))).otherwise(F.concat(part(times.MINUTE), F.lit("m")))
