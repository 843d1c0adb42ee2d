"""Time expressions over epoch milliseconds; sessions run in UTC."""

import datetime
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE, HOUR, DAY = 60_000, 3_600_000, 86_400_000
FIXED = {"minute": MINUTE, "hour": HOUR}
SPACING = {"minute": MINUTE, "hour": HOUR, "day": DAY, "week": 7 * DAY}


def checked_zone(zone: str) -> str:
    """The zone's name; ValueError if there is no such zone."""
    try:
        zoneinfo.ZoneInfo(zone)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError) as e:
        raise ValueError(f"no such time zone: {zone}") from e
    return zone


def local(ms: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_millis(ms), checked_zone(zone))


def bucket_start_ms(ms: Column, bucket: str, zone: str = "UTC") -> Column:
    """Beginning of a minute, an hour, or a day or Monday week of the zone's calendar."""
    if bucket in FIXED:
        return ms - F.pmod(ms, F.lit(FIXED[bucket]))
    if bucket not in ("day", "week"):
        raise ValueError(f"no such bucket: {bucket}")
    return F.unix_millis(F.to_utc_timestamp(F.date_trunc(bucket, local(ms, zone)), zone))


def day_key(ms: Column, zone: str = "UTC") -> Column:
    return F.date_format(local(ms, zone), "yyyy-MM-dd")


def time_of_day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "HH:mm:ss")


def automatic_bucket(from_ms: int, to_ms: int) -> str:
    """The resolution that keeps a range's series short."""
    span = max(0, to_ms - from_ms)
    return "minute" if span <= 6 * HOUR else "hour" if span <= 90 * DAY else "day" if span <= 730 * DAY else "week"


def automatic_bucket_column(from_ms: Column, to_ms: Column) -> Column:
    span = F.greatest(to_ms - from_ms, F.lit(0))
    return F.when(span <= 6 * HOUR, "minute").when(span <= 90 * DAY, "hour").when(span <= 730 * DAY, "day").otherwise("week")


def midnight_ms(now_ms: int, zone: str) -> int:
    """Local midnight before a moment, on the driver."""
    tz = zoneinfo.ZoneInfo(checked_zone(zone))
    day = datetime.datetime.fromtimestamp(now_ms / 1000, tz).date()
    return int(datetime.datetime(day.year, day.month, day.day, tzinfo=tz).timestamp() * 1000)


def preset_range(preset: str, now_ms: int, zone: str) -> tuple[int | None, int | None]:
    """from and to of today, this-month, last-month, 7d, 30d or all."""
    tz = zoneinfo.ZoneInfo(checked_zone(zone))
    day = datetime.datetime.fromtimestamp(now_ms / 1000, tz).date()
    at = lambda d: int(datetime.datetime(d.year, d.month, d.day, tzinfo=tz).timestamp() * 1000)
    first = day.replace(day=1)
    if preset == "today":
        return at(day), None
    if preset == "this-month":
        return at(first), None
    if preset == "last-month":
        return at((first - datetime.timedelta(days=1)).replace(day=1)), at(first) - 1
    if preset in ("7d", "30d"):
        return now_ms - int(preset[:-1]) * DAY, None
    if preset == "all":
        return None, None
    raise ValueError(f"no such range: {preset}")


def age_days(ms: Column, now_ms: int) -> Column:
    return F.floor(F.greatest(F.lit(now_ms) - ms, F.lit(0)) / DAY).cast("long")


def age_label(ms: Column, now_ms: int) -> Column:
    """Minutes, hours or days since a moment, as 5m, 3h or 2d."""
    age = F.greatest(F.lit(now_ms) - ms, F.lit(0))
    whole = lambda unit: F.floor(age / unit).cast("string")
    return F.when(age < HOUR, F.concat(whole(MINUTE), F.lit("m"))).when(age < DAY, F.concat(whole(HOUR), F.lit("h"))).otherwise(F.concat(whole(DAY), F.lit("d")))
